"""Connected components by DataFrame: alternating large-star and small-star steps.

Each step rewrites the edges so that nodes point at smaller ones; it ends when a step changes nothing. Every step's edges
are written to the shared folder, which cuts the lineage. A node's smallest neighbour is an aggregate that tasks combine
first, so a hub is no hot task; its edges can be split in the join. Tasks are as many as the edges need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.operators.storage import materialise, n_shuffle

#: Edges that a task should have at least.
EDGES_PER_TASK = 250_000


def components(edges: DataFrame, folder: str, most_steps: int = 60) -> DataFrame:
    """One row per node of the edges (columns a, b): node, component, the smallest node it is connected with.

    Edges of a node with itself and repeated edges do no harm; null ends are ignored. Raises if most_steps don't suffice.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), f"{folder}/edges-0")
    tasks = max(1, min(n_shuffle(edges.sparkSession), now.count() // EDGES_PER_TASK))
    seen = None
    for step in range(1, most_steps + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours above a node point at its smallest neighbour, or at itself
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(tasks)
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks)
        large = materialise(large, f"{folder}/large-{step}")
        # small star: a node and its smaller neighbours point at the smallest of them
        small_low = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
        joined = large.join(small_low, "a")
        small = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b")
        now = materialise(small.coalesce(tasks).distinct().coalesce(tasks), f"{folder}/edges-{step}")
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == seen:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        seen = sums
    raise RuntimeError(f"components: {most_steps} steps did not suffice")
