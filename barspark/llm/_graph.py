"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm._spark import cut

MAX_ROUNDS = 60


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One round over edges (u > v): each node's larger (or, small, all smaller) neighbours are tied to its least one."""
    if small:
        pairs = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    else:
        pairs = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
    least = pairs.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    near = pairs.join(least, "x")
    if small:
        tied = near.select(F.col("y").alias("u"), F.col("m").alias("v")).union(near.select("x", "m"))
    else:
        tied = near.filter(F.col("y") > F.col("x")).select(F.col("y").alias("u"), F.col("m").alias("v"))
    return tied.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links in any direction to (id, component): the least id that links reach, for every linked id.

    Self links and repeated links change nothing; an empty table gives an empty table.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        edges = cut(_star(_star(edges, small=False), small=True))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
