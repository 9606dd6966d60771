"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.lineage import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node of an edge with the least node it is connected with.

    Alternates large-star and small-star steps until the edges form stars around the least nodes; the rounds are
    logarithmic in the longest path. Each step is one pre-aggregated minimum and one join; no group is ever collected. Loops,
    repeated edges and NULL ends are allowed (an edge with a NULL end is ignored; a loop makes a component of one). Each
    round is a written table in the shared folder.
    """
    plain = edges.select(F.col(a).alias("p"), F.col(b).alias("q")).where("p IS NOT NULL AND q IS NOT NULL")
    nodes = plain.where("p = q").select(F.col("p").alias("node"), F.col("p").alias("component"))
    now = written(plain.where("p <> q").select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).distinct(), "edges")
    before = _state(now)
    while before[0]:
        both = now.union(now.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = written(small, "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component")).union(nodes).groupBy("node").agg(F.min("component").alias("component"))
