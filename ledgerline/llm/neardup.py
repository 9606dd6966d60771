"""Groups of texts that share most of their word shingles (problem 2).

One-permutation signatures with optimal densification are cut into bands; texts that share a band's key meet in a
bucket. A bucket of n texts first gives at most 2n candidate edges, to its least and its greatest node. Each candidate is
verified on the whole texts, and the verified edges are joined to components. The other members of a bucket that lie in
different components then meet each other, so every similar pair that shares a bucket ends in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.signatures import signed, similar
from ledgerline.operators.components import components
from ledgerline.operators.joins import bounded
from ledgerline.sources.lineage import written

#: Number of set pivots.
PIVOTS = 128


def pruned(pairs: DataFrame, table: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that the triangle inequality over the set pivots leaves.

    A similarity of at least s means a distance of at most (|A| + |B|)(1 - s)/(1 + s). The counts of an interval differ by no
    more than the sets do within it, and the intervals are disjoint, so the differences add up to a lower bound.
    """
    needed = bounded(written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "pruning"))
    return within_reach(pairs, table.select("node", "counts").join(needed, "node", "left_semi").dropDuplicates(["node"]), least)


def within_reach(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """pruned() with the distances at hand: vectors has one row (node, counts) for each node of a pair."""
    both = pairs.join(vectors.select(F.col("node").alias("a"), F.col("counts").alias("ca")), "a").join(vectors.select(F.col("node").alias("b"), F.col("counts").alias("cb")), "b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            ca, cb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(n, PIVOTS).astype(np.int32) for i in (2, 3))
            total = ca.sum(1) + cb.sum(1)
            # A count that reached its byte's limit stands for any larger one: such an interval bounds nothing.
            open_ = (ca < 255) & (cb < 255)
            good = (np.abs(ca - cb) * open_).sum(1) <= total * (1 - least) / (1 + least) + 1e-9
            good |= ~open_.all(1)
            yield batch.select([0, 1]).filter(pa.array(good))

    return both.select("a", "b", "ca", "cb").mapInArrow(keep, "a long, b long")


def buckets(table: DataFrame) -> DataFrame:
    """(key, lo, hi, n) of the buckets of a table with node and keys that hold several nodes."""
    rows = table.where("node IS NOT NULL").select("node", F.explode("keys").alias("key"))
    return written(rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi"), "buckets")


def star_edges(table: DataFrame, ends: DataFrame) -> DataFrame:
    """Distinct candidate edges (a < b) of a table with node and keys, and its buckets().

    Buckets are reduced to their ends by a pre-aggregated minimum and maximum, so copies and hot buckets cost one row a
    task. A bucket of two needs no more; only the keys of larger ones go back to the rows, in a join that is broadcast behind a
    check of its size and otherwise shuffled, where adaptive execution splits a hot key. Every member of a bucket keeps its edges.
    """
    rows = table.where("node IS NOT NULL").select("node", F.explode("keys").alias("key"))
    pairs = ends.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    large = bounded(ends.where("n > 2").select("key", "lo", "hi"))
    member = rows.join(large, "key").select("node", "lo", "hi")
    low = member.where("node > lo").select(F.col("lo").alias("a"), F.col("node").alias("b"))
    high = member.where("node < hi").select(F.col("node").alias("a"), F.col("hi").alias("b"))
    return pairs.union(low).union(high).distinct()


def inner_edges(table: DataFrame, ends: DataFrame, linked: DataFrame, least: float) -> DataFrame:
    """Distinct candidate edges (a < b) that star_edges() leaves: neither node is an end of their bucket, and they are not linked yet.

    table: node, size and keys; linked: node and component so far. Sizes too different for the similarity are no candidates. Only buckets
    of several components are opened; their pairs of different components are what is left to compare, and none is left out.
    """
    large = bounded(ends.where("n > 3").select("key", "lo", "hi"))
    rows = table.where("node IS NOT NULL").select("node", "size", F.explode("keys").alias("key"))
    rest = rows.join(large, "key").where("node > lo AND node < hi").select("key", "node", "size").distinct()
    rest = written(rest.join(linked, "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("c")), "rest")
    several = written(rest.groupBy("key").agg(F.min("c").alias("c"), F.max("c").alias("d")).where("c < d").select("key"), "open")
    a = rest.join(bounded(several), "key", "left_semi")
    b = a.select("key", F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("c").alias("c_b"))
    apart = (F.col("node") < F.col("b")) & (F.col("c") != F.col("c_b")) & (F.col("size_b") >= F.col("size") * least) & (F.col("size_b") * least <= F.col("size"))
    return a.join(b, "key").where(apart).select(F.col("node").alias("a"), "b").distinct()


def verified_edges(candidates: DataFrame, texts: DataFrame, *, words: int, least: float) -> DataFrame:
    """(a, b, similarity) of the candidates whose texts are similar. texts: node and text, one row a node at least."""
    candidates = written(candidates, "candidates")
    needed = bounded(written(candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "needed"))
    some = texts.join(needed, "node", "left_semi").dropDuplicates(["node"])
    pairs = candidates.join(some.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(some.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return similar(pairs, ["a", "b"], "ta", "tb", words=words, least=least)


def near_duplicate_groups(df: DataFrame, key: str, text: str, *, words: int = 5, least: float = 0.8, bins: int = 256, band_rows: int = 4) -> DataFrame:
    """(key, group) of every row that is linked with a row of another key; group is a number, equal for linked rows.

    Rows are linked when their texts' similarity is at least `least`, and through others. Texts of equal shingle sets
    are linked without a look at their pairs. A NULL, empty or too short text is similar to nothing. A row given twice counts
    once; rows of one key with different texts all count, and are linked through the key only if their texts are. Columns other
    than the key and the text are not read. An empty table has no groups. A text of any length counts whole.
    """
    base = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    table = written(signed(base, ["id", "text"], "text", words=words, bins=bins, band_rows=band_rows, pivots=PIVOTS).where("node IS NOT NULL"), "signatures")
    ends = buckets(table)

    def links(candidates: DataFrame) -> DataFrame:
        left = pruned(written(candidates, "pairs"), table, least)
        return written(verified_edges(left, table.select("node", "text"), words=words, least=least).select("a", "b"), "links")

    edges = links(star_edges(table, ends))
    linked = written(components(edges, "a", "b"), "linked")
    more = links(inner_edges(table, ends, linked, least))
    if not more.isEmpty():
        linked = components(edges.union(more), "a", "b")
    member = table.select("id", "node").distinct().join(linked, "node", "left").select("id", F.coalesce("component", "node").alias("group"))
    member = written(member.distinct(), "members")
    shared = member.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group")
    return written(member.join(shared, "group").select(F.col("id").alias(key), "group"), "groups")


def pairs_within(groups: DataFrame, key: str) -> DataFrame:
    """(id_a, id_b), the lesser first, of all pairs within a group. Quadratic in a group's size by definition of the result."""
    a = groups.select(F.col(key).alias("id_a"), "group")
    b = groups.select(F.col(key).alias("id_b"), "group")
    return a.join(b, "group").where("id_a < id_b").select("id_a", "id_b").distinct()
