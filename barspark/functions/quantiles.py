"""Exact quantiles of groups, and of everything but a group, by counting ranks.

Values fall into cells that are fine near nought and coarse far out.  Counts by cell and group, a few thousand cells a
column, say in which cell a rank lies, for a group as well as for the rest (all less the group); only values of cells that
are asked for are looked at again, by distinct value.  No group's values are gathered, and no row is copied for the groups it
isn't in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.stored import stored

CELLS = 400


def exact_quantiles(rows: DataFrame, group: str, within: str, asks: list[tuple[str, str, float, bool]]) -> DataFrame:
    """(within, group, and a column for each ask).  An ask is (name, column, q, rest): the q-quantile, linear between two values, of a group's values, or with ``rest`` of the values of all other groups of ``within``; null where there are none."""
    spark = rows.sparkSession
    columns = sorted({c for _, c, _, _ in asks})
    long = rows.select(F.col(within).alias("w"), F.col(group).alias("g"), F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("x")) for c in columns))).alias("v")).select("w", "g", "v.col", "v.x").filter("x is not null")
    long = long.withColumn("cell", F.floor(F.asinh(F.col("x") * 10) * CELLS))
    counts = stored(long.groupBy("w", "col", "cell", "g").agg(F.count("*").alias("c")))
    groups = counts.select("w", "g").distinct()
    rest_of = sorted({c for _, c, _, rest in asks if rest})
    totals = counts.filter(F.col("col").isin(rest_of)).groupBy("w", "col", "cell").agg(F.sum("c").alias("t"))
    others = totals.join(groups, "w").join(counts, ["w", "col", "cell", "g"], "left").withColumn("c", F.col("t") - F.coalesce("c", F.lit(0))).filter("c > 0")
    profile = counts.select("w", "g", "col", "cell", "c", F.lit(False).alias("rest")).unionByName(others.select("w", "g", "col", "cell", "c", F.lit(True).alias("rest")))
    whole = Window.partitionBy("w", "g", "col", "rest")
    profile = profile.withColumn("n", F.sum("c").over(whole)).withColumn("below", F.sum("c").over(whole.orderBy("cell")) - F.col("c"))
    asked = spark.createDataFrame(asks, "name string, col string, q double, rest boolean")
    need = profile.join(F.broadcast(asked), ["col", "rest"]).withColumn("at", F.col("q") * (F.col("n") - 1)).withColumn("part", F.col("at") - F.floor("at"))
    need = need.withColumn("rank", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor("at").alias("k")), F.struct(F.lit(1).alias("side"), F.ceil("at").alias("k")))))
    need = need.filter((F.col("rank.k") >= F.col("below")) & (F.col("rank.k") < F.col("below") + F.col("c")))
    need = stored(need.select("w", "g", "name", "rest", "col", "cell", "part", F.col("rank.side").alias("side"), (F.col("rank.k") - F.col("below")).alias("k")))
    values = long.join(need.select("w", "col", "cell").distinct(), ["w", "col", "cell"], "left_semi").groupBy("w", "col", "cell", "x", F.col("g").alias("of")).agg(F.count("*").alias("c"))
    key = ("w", "g", "name", "side", "part", "k")
    found = need.join(values, ["w", "col", "cell"]).filter((F.col("g") == F.col("of")) != F.col("rest")).groupBy(*key, "x").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("w", "g", "name", "side").orderBy("x"))
    found = found.withColumn("upto", upto).filter(F.col("upto") > F.col("k")).groupBy(*key).agg(F.min("x").alias("x"))
    found = found.groupBy("w", "g", "name").agg(F.max("part").alias("part"), F.max(F.when(F.col("side") == 0, F.col("x"))).alias("lo"), F.max(F.when(F.col("side") == 1, F.col("x"))).alias("hi"))
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + F.col("part") * (F.col("hi") - F.col("lo")))
    wide = found.groupBy("w", "g").pivot("name", [a[0] for a in asks]).agg(F.max(value))
    return groups.join(wide, ["w", "g"], "left").withColumnsRenamed({"w": within, "g": group})
