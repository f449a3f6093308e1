"""All registered queries of the library; importing this module registers them."""

from __future__ import annotations

from gridfold.plans import activation, facilities, panel, proximity, relational, statistics, white_space, workbooks
from gridfold.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "activation", "facilities", "panel", "proximity", "relational", "statistics", "white_space", "workbooks"]
