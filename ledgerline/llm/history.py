"""Checking deliveries against everything accepted before (problem 1).

Each accepted item is a row of an append-only table of its distances from fixed pivots; a delivery is checked against the rows
in its reach, and what it has new is appended. With the metric |A sym. difference B| on shingle sets there are two kinds of pivots:

* the empty set: the distance from it is the size. A similarity of at least s puts the sizes within a factor of s, so the table is partitioned by
  ranges of this distance and a delivery reads and joins a range only with those beside it;
* the equal intervals of the hash space: the distances from them give the number of an item's shingles in each interval, and the triangle inequality,
  summed over the disjoint intervals, bounds the distance of two items from below. Pairs beyond the bound are pruned without loss.

Within a range nearly all items lie at like distances from the empty set, so a range alone would leave far too many pairs. The join within ranges has a second
condition, which is no pivot distance but hashing: an equal band of the one-permutation signature. What is left is verified by the true distance of the texts.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.urls import canonical_url
from ledgerline.llm.neardup import PIVOTS, within_reach
from ledgerline.llm.signatures import signed, similar
from ledgerline.operators.joins import BROADCAST_ROWS, bounded
from ledgerline.sources.lineage import shared_folder, written

#: Band keys of a delivery that are sent to every executor (single numbers, about 30 MB); a larger delivery is joined by a shuffle.
BROADCAST_KEYS = 2_000_000


def pivot_rows(items: DataFrame, *, words: int, bins: int = 256, band_rows: int = 4) -> DataFrame:
    """Rows of the pivot-distance table. items: id, url, source_hash, content_hash, text, batch_no, item_no."""
    keep = ["id", "url", "source_hash", "content_hash", "batch_no", "item_no"]
    return signed(items, keep, "text", words=words, bins=bins, band_rows=band_rows, pivots=PIVOTS)


class PivotTable:
    """The history's pivot-distance table in a folder that all executors share, partitioned by ranges of the size. Appending never rewrites what is there."""

    def __init__(self, spark: SparkSession, path: str, *, words: int = 3, least: float = 0.5):
        self.spark, self.path, self.words, self.least = spark, path, words, least

    def ranged(self, rows: DataFrame) -> DataFrame:
        """rows with `part`, the range of their size: sizes within the factor `least` lie in the same range or in neighbouring ones; -1 for items without a shingle."""
        return rows.withColumn("part", F.when(F.col("size") > 0, F.floor(F.ln("size") / math.log(1 / self.least) + 1e-9)).otherwise(-1).cast("int"))

    def append(self, rows: DataFrame) -> PivotTable:
        """Adds pivot_rows() of accepted items. Rows are not checked against what is there."""
        self.schema = self.ranged(rows).schema
        self.ranged(rows).write.mode("append").partitionBy("part").parquet(self.path)
        return self

    def add(self, items: DataFrame) -> PivotTable:
        """Signs and adds items."""
        return self.append(pivot_rows(items, words=self.words))

    def rows(self, parts: list[int] | None = None) -> DataFrame:
        """All rows, or those in the given ranges, whose files alone are read."""
        every = self.spark.read.schema(self.schema).parquet(self.path)
        return every if parts is None else every.where(F.col("part").isin(parts))


def as_items(df: DataFrame, batch: bool) -> DataFrame:
    """Feed rows in the operator's form; history has delivery 0. The address is canonical."""
    return df.select(
        "id",
        canonical_url(F.col("canonicalUrl")).alias("url"),
        F.col("sourceHash").alias("source_hash"),
        F.col("contentHash").alias("content_hash"),
        F.col("content").alias("text"),
        (F.coalesce(F.col("batch_no").cast("int"), F.lit(0)) if batch else F.lit(0)).alias("batch_no"),
        (F.col("item_no").cast("long") if batch else F.lit(0).cast("long")).alias("item_no"),
    )


def _classes(rows: DataFrame) -> DataFrame:
    """(class, member) of the four grounds that are equalities: members of a class refuse one another."""
    kinds = [("u", "url"), ("s", "source_hash"), ("c", "content_hash"), ("n", "node")]
    array = F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(k), F.col(c).cast("string"))) for k, c in kinds])
    return rows.select("id", "batch_no", "item_no", F.explode(array).alias("class")).where("class IS NOT NULL")


def candidates(near: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, large): candidate pairs (a new, b) of nodes from the buckets' ends, and the large buckets' keys.

    near: part, key, node, size of the history; new: the same of the delivery, in each range within its reach, and item_no. A bucket is an equal key in
    a range. It is reduced by pre-aggregated minima and maxima, so no task holds one. A bucket's new nodes are paired with its
    least and greatest old node and with its first new one; a bucket with no others is thereby done.
    """
    o = near.select("part", "key", F.col("node").alias("o"), F.lit(None).cast("long").alias("w"), F.lit(None).cast("long").alias("item_no"))
    n = new.select("part", "key", F.lit(None).cast("long").alias("o"), F.col("node").alias("w"), "item_no")
    agg = o.union(n).groupBy("part", "key").agg(
        F.min("o").alias("olo"), F.max("o").alias("ohi"), F.min("w").alias("wlo"), F.max("w").alias("whi"), F.min("item_no").alias("first"), F.count(F.lit(1)).alias("n")
    )
    ends = written(agg.where("wlo IS NOT NULL AND (olo IS NOT NULL OR wlo < whi)"), "buckets")
    few = ends.select(F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("wlo", "olo"), ("wlo", "ohi"), ("whi", "olo"), ("whi", "ohi"), ("whi", "wlo"))])).alias("p")).select("p.a", "p.b")
    small = F.coalesce((F.col("olo") != F.col("ohi")).cast("int") + 1, F.lit(0)) + (F.col("wlo") != F.col("whi")).cast("int") + 1
    large = bounded(ends.where(F.col("n") > small).select("part", "key", "olo", "ohi", "wlo", "first"))
    member = new.select("part", "key", "node", "item_no").join(large, ["part", "key"])
    star = member.select(F.col("node").alias("a"), F.explode(F.array("olo", "ohi", "wlo")).alias("b"))
    firsts = member.where("item_no = first").groupBy("part", "key").agg(F.min("node").alias("b"))
    lead = member.select("part", "key", F.col("node").alias("a")).join(firsts, ["part", "key"]).select("a", "b")
    return few.union(star).union(lead).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), large.select("part", "key")


def _resolved(members: DataFrame) -> DataFrame:
    """Plays the arrivals through: (id, by) of every member, by = the accepted member it repeats, NULL for an accepted one.

    members: class, id, batch_no, item_no; two members of one class repeat each other. In each round the members that are first
    among the undecided of all their classes are accepted and those behind an accepted one are refused; classes are only
    ever reduced to minima, so their size does not matter. The rounds are as many as the longest chain of repeats.
    """
    order = F.struct("batch_no", "item_no", "id")
    state = written(members.select("class", order.alias("o"), F.lit(False).alias("ok")).distinct(), "arrivals")
    done = None
    while not state.where("NOT ok").isEmpty():  # in each round the first undecided of all is decided
        low = state.groupBy("class").agg(F.min(F.when(F.col("ok"), F.col("o"))).alias("acc"), F.min(F.when(~F.col("ok"), F.col("o"))).alias("und"))
        seen = state.where(~F.col("ok")).join(low, "class").groupBy("o").agg(F.min(F.when(F.col("acc") < F.col("o"), F.col("acc"))).alias("by"), F.bool_and(F.col("und") == F.col("o")).alias("lead"))
        verdict = written(seen.select("o", "by", (F.col("by").isNull() & F.col("lead")).alias("lead")).where("by IS NOT NULL OR lead"), "verdicts")
        now = verdict.select(F.col("o.id").alias("id"), F.col("by.id").alias("by"))
        done = now if done is None else done.union(now)
        after = state.join(verdict, "o", "left").where("by IS NULL").select("class", "o", (F.col("ok") | F.coalesce(F.col("lead"), F.lit(False))).alias("ok"))
        state = written(after, "arrivals")
    return done if done is not None else members.select("id", F.col("id").alias("by")).limit(0)


def refused(table: PivotTable, new: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, of): each refused item of new deliveries with the accepted item it repeats.

    new: pivot_rows() of the deliveries, a written table; texts: id, text of all items, read for candidates only. Items of `new` are taken by
    batch_no and item_no (unique per item). One is refused when an accepted item, of the table or earlier, has the same
    source hash, content hash or address (NULLs are equal to nothing), an equal shingle set, or a text of the table's similarity. Refused
    items refuse nothing. With several grounds the least history id is named, else the earliest accepted item.

    A delivery's row given twice counts once. An empty table or delivery is allowed. Items with NULL text take part by their hashes
    and address. All candidates are checked: items that the buckets' ends leave accepted are compared with all members of
    their buckets in further steps, until nothing changes. Of the table only the ranges beside the delivery's are read for texts; the history is never exploded into
    a shuffle unless the delivery has more than BROADCAST_KEYS keys.
    """
    least = table.least
    new = table.ranged(new.dropDuplicates(["id"]))
    own_parts = [r.part for r in new.where("part >= 0").select("part").distinct().collect()]  # ranges grow with the logarithm of the size
    parts = sorted({p + d for p in own_parts for d in (-1, 0, 1)})
    old = table.rows(parts).where("node IS NOT NULL")
    own = new.where("node IS NOT NULL").select("part", "node", "size", "item_no", F.explode("keys").alias("key"))
    own_keys = written(own.groupBy("key").agg((F.count(F.lit(1)) > 1).alias("shared")), "keys")
    near = written(old.select("part", "node", "size", F.explode("keys").alias("key")).join(bounded(own_keys.select("key"), BROADCAST_KEYS), "key", "left_semi").select("part", "key", "node", "size"), "near")
    # Most keys stand in one item alone; only the others are spread over the ranges in reach.
    useful = written(own_keys.where("shared").select("key").union(near.select("key")).distinct(), "useful")
    reach = F.explode(F.array(*[F.col("part") + d for d in (-1, 0, 1)]))
    member = written(own.join(bounded(useful, BROADCAST_KEYS), "key", "left_semi"), "members").select(reach.alias("part"), "key", "node", "size", "item_no")
    rows = old.select("id", "node", "counts").unionByName(new.where("node IS NOT NULL").select("id", "node", "counts"))
    new_class = written(_classes(new), "classes")
    old_class = _classes(table.rows()).join(bounded(new_class.select("class").distinct()), "class", "left_semi").groupBy("class").agg(F.min("id").alias("of"))
    equal_old = written(new_class.join(old_class, "class").select("id", "of"), "equal")

    def edges_of(pairs: DataFrame) -> DataFrame:
        needed = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "needed")
        few = needed.count() <= BROADCAST_ROWS
        some = written(rows.join(F.broadcast(needed) if few else needed, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"), F.min("counts").alias("counts")), "vectors")
        left = written(within_reach(pairs, some.select("node", "counts"), least), "pairs")
        ends = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = written(some.select("node", "id").join(ends, "node", "left_semi"), "wanted")  # no more rows than `needed`
        text = texts.join(F.broadcast(wanted) if few else wanted, "id").groupBy("node").agg(F.min("text").alias("text"))
        both = left.join(text.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(text.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        return written(similar(both, ["a", "b"], "ta", "tb", words=table.words, least=least).select("a", "b"), "links")

    def play(edges: DataFrame) -> DataFrame:
        """(id, of) of all new items that have a ground or might; of NULL: accepted."""
        own = new.where("node IS NOT NULL").select("id", "node", "batch_no", "item_no")
        ends = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
        others = bounded(ends.select(F.col("b").alias("node")).distinct())
        first = old.select("id", "node").join(others, "node", "left_semi").groupBy(F.col("node").alias("b")).agg(F.min("id").alias("of"))
        of_old = ends.join(own.select("id", F.col("node").alias("a")), "a").join(first, "b").select("id", "of")
        gone = written(equal_old.union(of_old).groupBy("id").agg(F.min("of").alias("of")), "repeats")
        pair = edges.select(F.concat(F.lit("p"), F.least("a", "b").cast("string"), F.lit(":"), F.greatest("a", "b").cast("string")).alias("class"), F.explode(F.array("a", "b")).alias("node"))
        members = new_class.union(pair.join(own, "node").select("id", "batch_no", "item_no", "class")).distinct().join(gone.select("id"), "id", "left_anti")
        shared = members.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class")
        inner = _resolved(members.join(shared, "class"))
        return written(gone.select("id", "of").union(inner.select("id", F.col("by").alias("of"))), "outcome")

    pairs, large = candidates(near, member)
    tested = written(pairs, "tested")
    edges = edges_of(tested)
    outcome = play(edges)
    while not large.isEmpty():
        # Items accepted so far whose buckets have members they were not compared with.
        refused_now = outcome.where("of IS NOT NULL").select("id")
        still = new.where("node IS NOT NULL").join(refused_now, "id", "left_anti").select("node").distinct()
        open_ = member.join(large, ["part", "key"], "left_semi").join(still, "node", "left_semi").select("part", "key", F.col("node").alias("a"), "size")
        every = near.union(member.select("part", "key", "node", "size")).select("part", "key", F.col("node").alias("b"), F.col("size").alias("size_b")).join(large, ["part", "key"], "left_semi")
        in_range = (F.col("size_b") >= F.col("size") * least) & (F.col("size_b") * least <= F.col("size")) & (F.col("a") != F.col("b"))
        more = open_.join(every, ["part", "key"]).where(in_range).select("a", "b").distinct()
        more = written(more.join(tested, ["a", "b"], "left_anti"), "more")
        if more.isEmpty():
            break
        found = edges_of(more)
        if found.isEmpty():
            break
        tested = tested.union(more)
        edges = written(edges.union(found).distinct(), "links")
        outcome = play(edges)
    return outcome.where("of IS NOT NULL").select("id", "of")


def check_deliveries(history: DataFrame, deliveries: DataFrame, *, words: int = 3, least: float = 0.5, at_once: int = 1) -> DataFrame:
    """refused() for two tables of feed rows (history: as article; deliveries: with batch_no and item_no).

    The history fills a pivot table; then so many deliveries at a time are checked against it, in order of batch_no, and their accepted items appended. The rows do not
    depend on at_once, as refused() takes items in order within deliveries too; a NULL batch_no comes first. Texts are signed once.
    """
    spark = history.sparkSession
    h, d = as_items(history, False), as_items(deliveries, True)
    table = PivotTable(spark, f"{shared_folder(spark)}/pivots-{uuid.uuid4().hex}", words=words, least=least).add(h)
    new = written(pivot_rows(d, words=words).dropDuplicates(["id"]), "arrivals")
    texts = reduce(DataFrame.union, [x.select("id", "text") for x in (h, d)])
    numbers = sorted(r.batch_no for r in new.select("batch_no").distinct().collect())  # one for each delivery in turn
    out = []
    for at in range(0, len(numbers), at_once):
        some = new.where(F.col("batch_no").isin(numbers[at : at + at_once]))
        out.append(refused(table, some, texts))
        if at + at_once < len(numbers):
            table.append(some.join(out[-1].select("id"), "id", "left_anti"))
    return reduce(DataFrame.union, out) if out else refused(table, new, texts)
