"""Feed documents as a stream of files: each micro-batch is parsed, decided against the store and merged into it [T1, T2, S9]."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import feed, ingest
from ledgerline.operators.ranking import positions
from ledgerline.sources.snapshots import POINTER, _read_text, _write_text

DOCUMENT = "source_id string, fetched_at timestamp, base_url string, xml string"


def items_of(documents: DataFrame) -> DataFrame:
    """Items of feed documents in the form that ingest.decide() takes, in order of arrival: source, document, place in it."""
    rows = feed.items(documents, "xml", "base_url", ["source_id", "fetched_at"])
    hashed = feed.hashes(rows, "title", "excerpt", "source_id", "link", F.col("guid"))
    # One number holds the order of arrival, all sources together: the second, then the place in the whole batch (below 10^9 items).
    placed = positions(hashed, [F.asc("fetched_at"), F.asc("source_id"), F.asc("pos"), F.asc("link")], "place")
    return placed.withColumn("seq", F.unix_timestamp("fetched_at") * 1_000_000_000 + F.col("place")).select(
        F.sha2(F.concat_ws("\u0001", "source_id", F.coalesce("guid", "link"), F.col("seq").cast("string")), 256).alias("id"), "source_id", "seq", "canonical_url", "source_hash", "content_hash", "normalized_title", "story_key", F.coalesce("published_at", "fetched_at").alias("at"),
        "link", "title", "excerpt", "content_html", "author", "categories", "image",
    )


#: What a repeat changes, as stored.
CHANGE = "id string, seq long, by string, content_hash string, excerpt string, content_html string, image string"


class FeedStore:
    """The store of taken-in items, appended to only: a folder of new items and one of changes for each batch, and a pointer to the last batch that counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _upto(self, name: str, form: str, last: int | None) -> DataFrame:
        if last is None:
            return self.spark.createDataFrame([], form)
        return self.spark.read.schema(f"{form}, batch long").parquet(f"{self.root}/{name}").where(F.col("batch") <= last).drop("batch")

    def _last(self) -> tuple[int | None, int | None]:
        """The last batch that counts and the one before it."""
        now = json.loads(_read_text(self.spark, f"{self.root}/{POINTER}") or "{}")
        return now.get("batch"), now.get("before")

    def read(self, last: int | None = None) -> DataFrame:
        """The items as they are after a batch, by default the last one, with what repeats changed since they came."""
        last = self._last()[0] if last is None else last
        return ingest.applied(self._upto("items", ingest.STORED, last), self._upto("changes", CHANGE, last))

    def take_in(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Decides a batch and appends what is new. A batch that was stored already (a restart after a crash) is decided anew against the store before it."""
        now, before = self._last()
        if now != batch_id:
            before = now
        stored = self.read(before) if before is not None else self.spark.createDataFrame([], ingest.STORED)
        path = f"{self.root}/decisions/batch={batch_id}"
        ingest.decide(batch, stored).write.mode("overwrite").parquet(path)
        decisions = self.spark.read.parquet(path)
        ingest.fresh(batch, decisions).write.mode("overwrite").parquet(f"{self.root}/items/batch={batch_id}")
        ingest.changes(batch, decisions).write.mode("overwrite").parquet(f"{self.root}/changes/batch={batch_id}")
        _write_text(self.spark, f"{self.root}/{POINTER}", json.dumps({"batch": batch_id, "before": before}))
        return decisions


def start(spark: SparkSession, documents: str, store: FeedStore, checkpoint: str):
    """Takes in all documents that are there (JSON lines of DOCUMENT) and stops; the file source remembers what it has seen."""
    stream = spark.readStream.schema(DOCUMENT).json(documents)

    def each(batch: DataFrame, batch_id: int) -> None:
        from ledgerline.sources.lineage import written

        store.take_in(written(items_of(batch), "items"), batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
