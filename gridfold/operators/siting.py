"""Choosing sites: p-median per area, portfolios under a budget, Monte Carlo bands."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RADIUS = 3958.8


def miles_matrix(lat: np.ndarray, lon: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat)[:, None], np.radians(lat2)[None, :]
    a = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin((np.radians(lon2)[None, :] - np.radians(lon)[:, None]) / 2) ** 2
    return 2 * RADIUS * np.arcsin(np.sqrt(np.clip(a, 0, 1)))


class Miles:
    """Distances between the points of an area by blocks of columns; kept whole up to so many points, else worked out anew."""

    BLOCK = 256

    def __init__(self, lat: np.ndarray, lon: np.ndarray, whole: int = 3000):
        self.lat, self.lon, self.shape = lat, lon, (len(lat), len(lat))
        self.kept = miles_matrix(lat, lon, lat, lon) if len(lat) <= whole else None

    def columns(self, which) -> np.ndarray:
        return self.kept[:, which] if self.kept is not None else miles_matrix(self.lat, self.lon, self.lat[which], self.lon[which])

    def rows(self, which) -> np.ndarray:
        return self.kept[which] if self.kept is not None else miles_matrix(self.lat[which], self.lon[which], self.lat, self.lon)


class _Matrix:
    """A given distance matrix under the same interface."""

    def __init__(self, miles: np.ndarray):
        self.miles, self.shape = miles, miles.shape

    def columns(self, which) -> np.ndarray:
        return self.miles[:, which]

    def rows(self, which) -> np.ndarray:
        return self.miles[which]


def p_median(miles, weights: np.ndarray, p: int, passes: int = 12) -> np.ndarray:
    """Columns that together bring sum(weight * nearest miles) down: greedy opening, then swaps as long as one helps.

    Ties go to the lower index. miles is demand x candidates, a matrix or Miles. Each demand's nearest and second nearest open
    column are kept, and what each column would save; opening, closing or trying a column then touches only the demands whose
    nearest it is or was, so that a pass over all swaps costs as much as one over all distances.
    """
    miles = _Matrix(miles) if isinstance(miles, np.ndarray) else miles
    m, n = miles.shape
    if p >= n:
        return np.arange(n)
    if p < 1:
        return np.empty(0, np.int64)
    w, block = np.asarray(weights, float), Miles.BLOCK

    def change(which: np.ndarray, to: np.ndarray, of: np.ndarray) -> np.ndarray:
        """What all columns save more when the reach of these demands goes from of to to."""
        out = np.zeros(n)
        for lo in range(0, len(which), block):
            part = slice(lo, lo + block)
            d = miles.rows(which[part])
            out += w[which[part]] @ (np.maximum(to[part, None] - d, 0.0) - np.maximum(of[part, None] - d, 0.0))
        return out

    total = np.zeros(n)
    for lo in range(0, m, block):
        total += w[lo : lo + block] @ miles.rows(np.arange(lo, min(m, lo + block)))
    slack = 1e-12 * max(float(np.abs(total).min()), 1e-300)
    first = lambda gain: int(np.flatnonzero(gain >= gain.max() - slack)[0])
    column = lambda j: miles.columns([j])[:, 0]
    open_ = [first(-total)]
    near, next_ = column(open_[0]).astype(float), np.full(m, np.inf)
    by, then = np.zeros(m, np.int64), np.full(m, -1)  # the slots of the nearest and the second nearest open column
    every = np.arange(m)
    saved = change(every, near, np.zeros(m))

    def add(slot: int, j: int) -> None:
        """Enters column j as open in this slot."""
        nonlocal saved
        d = column(j)
        closer = np.flatnonzero(d < near)
        saved = saved + change(closer, d[closer], near[closer])
        second = np.flatnonzero((d >= near) & (d < next_))
        next_[closer], then[closer] = near[closer], by[closer]
        near[closer], by[closer] = d[closer], slot
        next_[second], then[second] = d[second], slot

    def barred(gain: np.ndarray, which: list[int]) -> np.ndarray:
        gain = gain.copy()
        gain[which] = -np.inf
        return gain

    while len(open_) < p:
        open_.append(first(barred(saved, open_)))
        add(len(open_) - 1, open_[-1])
    for _ in range(passes if p > 1 else 0):
        swapped = False
        for slot in range(p):
            now = float(w @ near)
            own = np.flatnonzero(by == slot)
            lost = float(w[own] @ (next_[own] - near[own]))
            gain = barred(saved + change(own, next_[own], near[own]), open_)
            best = first(gain)
            if gain[best] - lost > 1e-9 * max(now, 1.0):
                saved = saved + change(own, next_[own], near[own])
                near[own], by[own] = next_[own], then[own]
                kept = np.array([k for k in range(p) if k != slot])
                again = np.union1d(own, np.flatnonzero(then == slot))
                for lo in range(0, len(again), block):
                    part = again[lo : lo + block]
                    d = miles.rows(part)[:, np.array(open_)[kept]]
                    d[np.arange(len(part)), np.searchsorted(kept, by[part])] = np.inf
                    at = d.argmin(axis=1)
                    next_[part], then[part] = d[np.arange(len(part)), at], kept[at]
                open_[slot], swapped = best, True
                add(slot, best)
        if not swapped:
            break
    return np.array(sorted(open_))


def depot_network(places: DataFrame, area: str, *, parcels: str = "parcels", per_depot: float = 40_000.0, whole: int = 3000) -> DataFrame:
    """Depots per area among its places: one per so many parcels, at least one.

    An area is solved by one task, which holds its places' coordinates. Places of one point count together, and a depot goes to
    the first of them; only where there are more depots than points do points get several, from the lowest places on. The
    points' distances are held up to `whole` points, and worked out by blocks beyond that.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", ignore_index=True)
        k = int(min(len(rows), max(1, math.ceil(rows[parcels].sum() / per_depot))))
        # points in the order of their first places
        at, _ = pd.factorize(pd.MultiIndex.from_frame(rows[["lat", "lon"]]))
        first = np.flatnonzero(~pd.Series(at).duplicated().to_numpy())
        m = Miles(rows.lat.to_numpy()[first], rows.lon.to_numpy()[first], whole)
        weights = np.bincount(at, rows[parcels].to_numpy(), len(first))
        points = p_median(m, weights, k)
        cost = float(weights @ m.columns(points).min(axis=1))
        chosen = first[points]
        if k > len(first):
            chosen = np.sort(np.concatenate([chosen, np.setdiff1d(np.arange(len(rows)), chosen)[: k - len(first)]]))
        return pd.DataFrame({"area": rows[area].iloc[0], "depot": rows.place[chosen], "depots": k, "objective": cost})

    return places.select(area, "place", "lat", "lon", parcels).groupBy(area).applyInPandas(solve, "area long, depot long, depots int, objective double")


class _Exposure:
    """A portfolio with each site's exposure to the chosen ones, kept up to date as sites come and go. A site is worth fixed + value * exp(-exposure)."""

    def __init__(self, value: np.ndarray, overlap, fixed: np.ndarray | None = None):
        self.value, self.overlap, self.exposure, self.chosen = value, overlap, np.zeros(len(value)), np.zeros(len(value), bool)
        self.fixed = np.zeros(len(value)) if fixed is None else fixed

    def change(self, j: int, sign: int) -> None:
        near, by = self.overlap[j]
        self.exposure[near] += sign * by
        self.chosen[j] = sign > 0

    def total(self) -> float:
        return float((self.fixed + self.value * np.exp(-self.exposure))[self.chosen].sum())

    def gains(self) -> np.ndarray:
        """What adding each site adds: its own value less what its chosen neighbours lose. From the lists of the chosen sites alone."""
        out = self.fixed + self.value * np.exp(-self.exposure)
        for k in np.flatnonzero(self.chosen).tolist():
            near, by = self.overlap[k]
            out[near] -= self.value[k] * np.exp(-self.exposure[k]) * (1 - np.exp(-by))
        return out


class Within:
    """Each site's neighbours at most so many miles away, with what the distance makes of it; worked out when asked for, the last ones kept.

    Takes the place of a list of all sites' neighbours, which grows with the square of their density.
    """

    def __init__(self, lat: np.ndarray, lon: np.ndarray, miles: float, by, radius: float = RADIUS, kept: int = 1000):
        self.lat, self.lon, self.miles, self.by, self.radius, self.kept, self.lists = lat, lon, miles, by, radius, kept, {}

    def __getitem__(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        if j not in self.lists:
            if len(self.lists) >= self.kept:
                del self.lists[next(iter(self.lists))]
            away = miles_matrix(self.lat, self.lon, self.lat[j : j + 1], self.lon[j : j + 1])[:, 0] * (self.radius / RADIUS)
            near = np.flatnonzero(away <= self.miles)
            near = near[near != j]
            self.lists[j] = near, self.by(away[near])
        return self.lists[j]


def portfolio(value: np.ndarray, cost: np.ndarray, overlap, budget: float, swaps: int | None = None, fixed: np.ndarray | None = None) -> tuple[list[int], float]:
    """Sites of most total value within a budget: each site's value shrinks by exp(-exposure) to the chosen ones; its fixed part (if given) doesn't.

    overlap: each site's neighbours (without itself) and how far they expose each other, a list or Within. Greedy by gain per
    cost, then the best swap as long as one helps (at most so many). Only the lists of sites that are or were chosen are read.
    """
    state = _Exposure(value, overlap, fixed)
    left = budget
    while True:
        gains = state.gains()
        rate = np.where(~state.chosen & (cost <= left) & (gains > 1e-12), gains / cost, -np.inf)
        j = int(rate.argmax())
        if rate[j] == -np.inf:
            break
        state.change(j, 1)
        left -= cost[j]
    step = 0
    while swaps is None or step < swaps:
        step += 1
        best, most = None, 1e-9
        for i in np.flatnonzero(state.chosen).tolist():
            state.change(i, -1)
            gains = state.gains()
            ok = ~state.chosen & (cost <= left + cost[i])
            ok[i] = False
            more = np.where(ok, gains - gains[i], -np.inf)
            j = int(more.argmax())
            if more[j] > most:
                best, most = (i, j), float(more[j])
            state.change(i, 1)
        if best is None:
            break
        for site, sign in zip(best, (-1, 1), strict=True):
            state.change(site, sign)
            left -= sign * cost[site]
    return np.flatnonzero(state.chosen).tolist(), state.total()


def portfolio_bound(value: np.ndarray, cost: np.ndarray, budget: float) -> float:
    """No portfolio is worth more: values without cannibalisation, the last site in part."""
    order = np.argsort(-value / cost, kind="stable")
    left, out = budget, 0.0
    for j in order:
        share = min(1.0, left / cost[j])
        out += share * value[j]
        left -= share * cost[j]
        if left <= 0:
            break
    return out


@dataclass(frozen=True)
class Activation:
    """What a portfolio of activated sites is valued by: capital per site, discounting, lost parcels and shared line-haul near others."""

    capital: float = 4_000_000.0
    years: int = 10
    rate: float = 0.08
    lost: float = 0.25
    shared: float = 0.35

    @property
    def annuity(self) -> float:
        return sum((1 + self.rate) ** -t for t in range(1, self.years + 1))


def activation_value(parcels: np.ndarray, cost: np.ndarray, linehaul: np.ndarray, overlap, chosen: list[int], terms: Activation) -> dict[str, float]:
    """A portfolio's yearly parcels and cost, capital, present values and the margin per parcel at which it breaks even (infinite when empty)."""
    state = _Exposure(np.zeros(len(parcels)), overlap)
    for j in chosen:
        state.change(j, 1)
    decay = -np.expm1(-state.exposure)[state.chosen]
    sold = float((parcels[state.chosen] * (1 - terms.lost * decay)).sum())
    paid = float((cost[state.chosen] - linehaul[state.chosen] * terms.shared * decay).sum())
    capital = len(chosen) * terms.capital
    a, b = sold * terms.annuity, paid * terms.annuity + capital
    return {"n": len(chosen), "parcels": sold, "cost": paid, "capital": capital, "per_margin": a, "fixed": -b, "breakeven": b / a if a > 0 else math.inf}


def activate(parcels: np.ndarray, cost: np.ndarray, linehaul: np.ndarray, overlap, capacity: int, margin: float, terms: Activation, swaps: int | None = None) -> tuple[list[int], float]:
    """At most so many sites of most net present value at a margin, and that value.

    Per site it is fixed + value * exp(-exposure), so the portfolio search applies with unit costs: greedy, then swaps.
    """
    value = terms.annuity * (margin * parcels * terms.lost - linehaul * terms.shared)
    alone = terms.annuity * (margin * parcels - cost) - terms.capital
    return portfolio(value, np.ones(len(parcels)), overlap, float(capacity), swaps, fixed=alone - value)


def ratio_bound(rows: DataFrame, a: str, b: str, k: int, steps: int = 50) -> float:
    """The least sum(b) / sum(a) of exactly k rows, by Dinkelbach's iteration: one top list per step, two sums on the driver."""
    order = F.col(b) / F.when(F.col(a) > 0, F.col(a))
    ratio = math.inf
    for _ in range(steps):
        s = rows.orderBy(order.asc_nulls_last(), F.col(a), F.col(b)).limit(k).agg(F.sum(a).alias("a"), F.sum(b).alias("b")).first()
        if not s.a or s.a <= 0:
            return ratio
        new = s.b / s.a
        if abs(new - ratio) < 1e-12:
            return new
        ratio = new
        order = F.col(b) - ratio * F.col(a)
    return ratio


def triangular(u, low: float, mode: float, high: float):
    """Inverse distribution function, as a Column of a uniform Column."""
    cut = (mode - low) / (high - low)
    return F.when(u < cut, low + F.sqrt(u * (high - low) * (mode - low))).otherwise(high - F.sqrt((1 - u) * (high - low) * (high - mode)))


def uniform_of(draw, name: str, seed: int):
    """A uniform number that depends on the draw, the parameter and the seed alone, whatever the partitions."""
    h = F.xxhash64(draw, F.lit(name), F.lit(seed))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
