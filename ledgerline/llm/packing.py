"""Filling containers of fixed capacity in a controlled mixture (problem 6).

Deficit round-robin over one queue a source: whenever room is left, the source that is furthest behind its target share and
has an item that still fits gives its largest such item. Rows are packed in parts of bounded size, and each part starts with the
deficits that the parts before it leave, so the shares hold over containers and parts alike.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tokens of one part; one task packs a part, and only its last containers can stay partly empty.
PART_TOKENS = 4_000_000
#: Parts of one block of the two-level running sum over parts.
BLOCK = 1000


class _Queue:
    """Items of one source by size; equal sizes in order of arrival."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.items: dict[int, list] = {}
        self.left = 0

    def add(self, size: int, item) -> None:
        if size not in self.items:
            insort(self.sizes, size)
            self.items[size] = []
        self.items[size].append(item)
        self.left += size

    def largest(self, room: int) -> int:
        i = bisect_right(self.sizes, room)
        return self.sizes[i - 1] if i else -1

    def take(self, size: int):
        items = self.items[size]
        item = items.pop()
        if not items:
            del self.items[size]
            self.sizes.remove(size)
        self.left -= size
        return item


def pack(items: list[tuple], shares: dict, deficits: dict, capacity: int) -> list[tuple]:
    """Places of (key, source, size) items: (key, piece, container, slot, offset, size).

    An item larger than the capacity is cut into whole containers and a rest, which is packed as an item; no other is cut. Every
    container takes from the source with the largest deficit that has something which fits, its largest such item; what is taken is
    charged to the source and credited to all by their shares, empty room to none. So whatever the order, a source ends with what it began with, plus
    its share of the tokens packed, less its own tokens: the next part's start is known without packing this one. Sizes must be positive.
    """
    queues: dict = {}
    out: list[tuple] = []
    container = 0
    owed = {s: float(deficits.get(s, 0.0)) for s in shares}

    def charge(source, size: int) -> None:
        for s, w in shares.items():
            owed[s] += w * size
        owed[source] -= size

    for key, source, size in sorted(items, key=lambda x: (str(x[1]), str(x[0])), reverse=True):
        queue = queues.setdefault(source, _Queue())
        owed.setdefault(source, float(deficits.get(source, 0.0)))
        whole = size // capacity if size > capacity else 0
        for piece in range(whole):
            out.append((key, piece, container, 0, 0, capacity))
            container += 1
            charge(source, capacity)
        rest = size - whole * capacity
        if rest:
            queue.add(rest, (key, whole))
    queues = {s: q for s, q in queues.items() if q.sizes}
    while queues:
        room, slot = capacity, 0
        while room:
            best, size = None, -1
            for s, q in queues.items():
                fit = q.largest(room)
                if fit > 0 and (best is None or owed[s] > owed[best]):
                    best, size = s, fit
            if best is None:
                break
            key, piece = queues[best].take(size)
            out.append((key, piece, container, slot, capacity - room, size))
            charge(best, size)
            room -= size
            slot += 1
            if not queues[best].sizes:
                del queues[best]
        container += 1
    return out


def _before(sums: DataFrame, keys: list[str]) -> DataFrame:
    """sums (part, block, t and the keys) with `before`, the sum of t over the earlier parts of the keys; no window is longer than a block or the number of blocks."""
    blocks = sums.groupBy(*keys, "block").agg(F.sum("t").alias("t"))
    earlier = blocks.select(*keys, "block", (F.sum("t").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("block")) - F.col("t")).alias("earlier"))
    own = F.sum("t").over(Window.partitionBy(*keys, "block").orderBy("part")) - F.col("t")
    return sums.withColumn("own", own).join(earlier, [*keys, "block"]).withColumn("before", F.col("own") + F.col("earlier")).drop("own", "earlier")


def packed(sizes: DataFrame, limits: DataFrame, key: str, source: str, *, targets: DataFrame | None = None, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Places of all rows for each limit: purpose, capacity, container, slot, offset, key, piece, source, tokens.

    sizes: key, source and tokens, a written table; limits: purpose, capacity_tokens (few rows, each a round of its own over the rows).
    container is unique within a purpose; offset is the place's first token in it; piece counts the pieces of a row, from 0, and is 0 for
    an uncut one. targets: source and weight, the wanted proportions of tokens, by default those that the rows have; a source without a target is
    wanted nowhere but still packed, one given twice counts once, and weights need no sum of 1. Rows without tokens have no place; a NULL source is a source. Rows are spread over parts by the key's hash, so
    a source or key that holds a third of all rows is spread too. An empty table gives no places.
    """
    rows = sizes.where("tokens > 0").select(F.col(key).alias("key"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col("tokens").cast("long").alias("tokens"))
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    if targets is None:
        wanted = rows.groupBy("source").agg(F.sum("tokens").alias("weight"))
    else:
        wanted = targets.select(F.coalesce(F.col("source"), F.lit("")).alias("source"), F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight")).dropDuplicates(["source"])
    of_all = wanted.agg(F.sum("weight").cast("double")).first()[0] or 1.0
    shares = wanted.select("source", (F.col("weight") / F.lit(of_all)).alias("share"))
    limit = [(r["purpose"], int(r["capacity"])) for r in limits.select("purpose", F.col("capacity_tokens").alias("capacity")).where("purpose IS NOT NULL AND capacity_tokens > 0").distinct().collect()]  # a few rows by definition
    purposes = F.array(*[F.struct(F.lit(p).alias("purpose"), F.lit(c).alias("capacity")) for p, c in sorted(limit)]) if limit else F.array().cast("array<struct<purpose:string,capacity:int>>")
    parts = max(1, -(-total // part_tokens))
    placed = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    # What each source is behind its share before each part that it has rows in: two running sums over the parts before it, each in two levels.
    have = placed.groupBy("part", "source").agg(F.sum("tokens").alias("t")).withColumn("block", F.floor(F.col("part") / BLOCK))
    packed_before = _before(have.groupBy("part", "block").agg(F.sum("t").alias("t")), []).select("part", F.col("before").alias("all_before"))
    of_source = _before(have, ["source"])
    share = F.coalesce("share", F.lit(0.0))
    carried = of_source.join(packed_before, "part").join(shares, "source", "left").select("part", "source", share.alias("share"), (share * F.col("all_before") - F.col("before")).alias("deficit"))
    kind = sizes.schema[key].dataType.simpleString()
    schema = f"purpose string, capacity int, container long, slot int, offset int, `{key}` {kind}, piece int, source string, tokens int"

    def fill(ids, docs: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        if docs.empty:
            return pd.DataFrame(columns=["purpose", "capacity", "container", "slot", "offset", key, "piece", "source", "tokens"])
        purpose, capacity, part = docs["purpose"].iloc[0], int(docs["capacity"].iloc[0]), int(docs["part"].iloc[0])
        places = pack(list(zip(docs["key"], docs["source"], docs["tokens"].astype(int))), dict(zip(carry["source"], carry["share"])), dict(zip(carry["source"], carry["deficit"])), capacity)
        of = dict(zip(docs["key"], docs["source"]))
        return pd.DataFrame([(purpose, capacity, (part << 32) | c, slot, at, k, piece, of[k] or None, n) for k, piece, c, slot, at, n in places], columns=["purpose", "capacity", "container", "slot", "offset", key, "piece", "source", "tokens"])

    left = placed.select("*", F.inline(purposes))
    right = carried.select(F.col("part").alias("to_part"), F.col("source").alias("source"), F.col("share").alias("share"), F.col("deficit").alias("deficit"), F.inline(purposes)).withColumnRenamed("purpose", "to_purpose")
    right = right.select(*[F.col(c).alias(c) for c in ("to_purpose", "to_part", "source", "share", "deficit")])
    return left.groupBy("purpose", "part").cogroup(right.groupBy("to_purpose", "to_part")).applyInPandas(fill, schema)


def fill_report(places: DataFrame) -> DataFrame:
    """For each purpose: containers, tokens, the share of room that is filled, and the least number of containers there could be."""
    per = places.groupBy("purpose", "capacity").agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return per.select("purpose", "capacity", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("filled"), F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"))


def mixture_report(places: DataFrame) -> DataFrame:
    """For each purpose and source: the share of all tokens, and the mean distance of a container's share from it."""
    one = places.groupBy("purpose", "container", "source").agg(F.sum("tokens").alias("t"))
    full = places.groupBy("purpose", "container").agg(F.sum("tokens").alias("size"))
    overall = places.groupBy("purpose", "source").agg(F.sum("tokens").alias("ts"))
    sum_ = places.groupBy("purpose").agg(F.sum("tokens").alias("ta"), F.count_distinct("container").alias("n"))
    share = overall.join(sum_, "purpose").select("purpose", "source", "n", (F.col("ts") / F.col("ta")).alias("share"))
    joined = one.join(full, ["purpose", "container"]).join(share.withColumnRenamed("source", "s"), (F.col("s").eqNullSafe(F.col("source"))) & (one["purpose"] == share["purpose"])).select(one["purpose"], "source", "share", "n", F.abs(F.col("t") / F.col("size") - F.col("share")).alias("off"))
    # A container without the source is off by the whole share.
    return joined.groupBy("purpose", "source", "share", "n").agg(F.sum("off").alias("off"), F.count(F.lit(1)).alias("with")).select("purpose", "source", "share", ((F.col("off") + (F.col("n") - F.col("with")) * F.col("share")) / F.col("n")).alias("mean_distance"))


def place_checks(places: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """For each purpose: documents placed, containers over their capacity or with gaps, documents whose pieces are not their tokens, and documents cut without need; all but the first must be 0."""
    held = places.groupBy("purpose", "capacity", "container").agg(F.sum("tokens").alias("t"), F.max(F.col("offset") + F.col("tokens")).alias("end"), F.min("offset").alias("start"))
    boxes = held.groupBy("purpose", "capacity").agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"), F.count_if((F.col("t") != F.col("end")) | (F.col("start") != 0)).alias("gaps"))
    whole = places.groupBy("purpose", "capacity", F.col(key).alias("key")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    met = whole.join(sizes.select(F.col(key).alias("key"), F.col("tokens").alias("size")), "key", "left")
    documents = met.groupBy("purpose", "capacity").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(~F.col("t").eqNullSafe(F.col("size"))).alias("wrong_pieces"), F.count_if(F.col("n") > F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity")))).alias("cut_without_need")
    )
    return documents.join(boxes, ["purpose", "capacity"]).select("purpose", "capacity", "documents", "overfull", "gaps", "wrong_pieces", "cut_without_need")
