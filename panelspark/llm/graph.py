"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) of longs -> node, root (the least node reachable), for every node that has an edge to another.

    Alternating large-star and small-star steps: each node's neighbours are hung on the least of them, larger ones
    first, until only stars around the least nodes remain. Every step is two shuffles by node; no step gathers a
    component anywhere, and each round is written, so that lineage stays short.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        # large star: each node's larger neighbours go to the least of its neighbours and itself
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: each node and its smaller neighbours go to the least of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        now = written(small.select("e.hi", "e.lo").where("hi <> lo").distinct(), "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).head())
        if state == seen or not state[0]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = state
    raise RuntimeError(f"no end after {max_rounds} rounds")
