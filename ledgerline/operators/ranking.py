"""Positions in a total order over all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.sources.lineage import written


def positions(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """df with the 1-based position of each row in a total order.

    Rows are spread by ranges of the order, numbered within their range, and moved on by the rows of the ranges before; only one count
    a range is looked at as a whole. The order must have no ties, or ties are numbered arbitrarily.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row for each partition
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(before), "_range").withColumn(name, (within + F.col("_before")).cast("long")).drop("_range", "_before")
