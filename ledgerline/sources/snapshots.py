"""Snapshots that are written, checked and only then shown: a data set is a folder, and one small file names the folder that counts."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.text import shard
from ledgerline.operators import quality

POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """The file has the old or the new text at any moment: it is written beside and renamed."""
    jvm, fs, target = _fs(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{time.time_ns()}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, target, options)


def _read_text(spark: SparkSession, path: str) -> str | None:
    """None where there is no such file [S14]."""
    jvm, fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class Store:
    """A folder of snapshots [K12, S7]."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def publish(self, tables: dict[str, DataFrame], report: Callable[[dict[str, DataFrame]], DataFrame], name: str | None = None) -> dict:
        """Writes the tables as a snapshot, checks what was written, and shows it only if no check fails. Returns the status."""
        name = name or time.strftime("%Y%m%dT%H%M%S", time.gmtime()) + f"-{time.time_ns() % 10**9:09d}"
        folder = f"{self.root}/snapshot={name}"
        for t, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{folder}/{t}")
        read = {t: self.spark.read.parquet(f"{folder}/{t}") for t in tables}
        checked = report(read)
        checked.coalesce(1).write.parquet(f"{folder}/checks")
        bad = quality.failed(self.spark.read.parquet(f"{folder}/checks"))
        status = {"snapshot": name, "previous": self.current(), "published": not bad, "failed": bad}
        _write_text(self.spark, f"{folder}/status.json", json.dumps(status))
        if not bad:
            _write_text(self.spark, f"{self.root}/{POINTER}", name)
        return status

    def current(self) -> str | None:
        text = _read_text(self.spark, f"{self.root}/{POINTER}")
        return text.strip() if text else None

    def rollback(self) -> str | None:
        """Shows the snapshot before the current one again; None if there is none."""
        now = self.current()
        status = json.loads(_read_text(self.spark, f"{self.root}/snapshot={now}/status.json") or "{}") if now else {}
        before = status.get("previous")
        if before:
            _write_text(self.spark, f"{self.root}/{POINTER}", before)
        return before

    def read(self, table: str) -> DataFrame:
        now = self.current()
        if now is None:
            raise FileNotFoundError(f"nothing is published in {self.root}")
        return self.spark.read.parquet(f"{self.root}/snapshot={now}/{table}")


def write_sharded(df: DataFrame, key: str, path: str) -> None:
    """[K2, F26] Rows in folders by the last three characters of their id; a point look-up reads one of a thousand folders."""
    df.withColumn("shard", shard(F.col(key))).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def look_up(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """[S8] The rows of one id; only its shard is read."""
    last = value[-3:].rjust(3, "0")
    return spark.read.parquet(path).where((F.col("shard") == last) & (F.col(key) == value)).drop("shard")


def write_pages(df: DataFrame, path: str) -> None:
    """[K5] Rows in folders by their page."""
    df.repartition("page").write.mode("overwrite").partitionBy("page").json(path)


def read_page(spark: SparkSession, path: str, page: int, form: str) -> DataFrame:
    """[S11] The rows of one page, of which alone the files are read; none for a page that is not there. form: the rows' columns and types."""
    return spark.read.schema(f"{form}, page int").json(path).where(F.col("page") == page).drop("page")


def stale(existing: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """[K7] What is there but no longer published."""
    return existing.join(published.select(key).distinct(), key, "left_anti")


def valid_pictures(df: DataFrame, column: str) -> DataFrame:
    """[K4] df with `picture`, the decoded base64 picture, NULL where the text is none or no PNG."""
    raw = F.expr(f"try_to_binary(regexp_replace(`{column}`, '^data:[^,]*,', ''), 'base64')")
    return df.withColumn("picture", F.when(F.hex(F.substring(raw, 1, 4)) == "89504E47", raw))
