"""Connected components of a table of edges, by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, joined, removed, stored

#: Up to so many edges one task may hold a star whole; beyond, centres with many edges are joined by broadcast.
ONE_TASK = 500_000


def _joined_to_least(pairs: DataFrame, total: int) -> DataFrame:
    """u, v, m: each pair with the smallest v of its u, if that is smaller than u. A star's centre has many pairs, so it may be hot."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    both = joined(pairs, least, ["u"], total) if total > ONE_TASK else pairs.join(least, "u")
    return both.select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component of every node of edges (u, v): the smallest node that it reaches. Nulls and loops give nothing."""
    spark = edges.sparkSession
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    path = fresh_path(spark, "edges")
    e = stored(e, "edges", path)
    seen, total = None, e.count()
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _joined_to_least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = _joined_to_least(large, total)
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        old, path = path, fresh_path(spark, "edges")
        e = stored(small.where("u <> v").distinct(), "edges", path)
        removed(spark, old)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        total = now[0]
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
