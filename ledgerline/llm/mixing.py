"""Drawing documents from sources in target shares of the total size (problem 7).

Each document is due a number of copies, the same multiple of its importance within a source and never more than the source's limit.
Its whole copies are certain. For the rest, a fraction, the source's documents are ranked by Pareto order sampling, the odds of a
random number divided by the odds of inclusion, and taken in that order until the size that is still due is reached.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.sources.lineage import written

#: Ranges to a unit of the odds' logarithm; only the range in which a source's sample ends is sorted, about 0.05 % of the sample however small its share of the source is.
RANGES = 2_048


def _importance(tokens):
    """Longer documents are due more copies, slowly rising with the length."""
    import numpy as np

    return np.log1p(np.asarray(tokens, float))


def shares_available(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source, weight, max_repeats, available: targets with the tokens at hand (0 if none); listed sources only."""
    t = targets.select("source", "weight", "max_repeats").where("source IS NOT NULL").dropDuplicates(["source"])
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("a"))
    return t.join(have, "source", "left").select("source", "weight", "max_repeats", F.coalesce("a", F.lit(0)).cast("long").alias("available"))


def drawn(sizes: DataFrame, targets: DataFrame, key: str, *, total_tokens: int | None = None, seed: int = 17) -> DataFrame:
    """(key, source, tokens, copies) of every document drawn at least once.

    sizes: key, source, tokens, a written table; targets: source, weight, max_repeats (a few rows). total_tokens: the size of the mixture; by default the
    largest for which every listed source that has documents meets its share within its limit. With a larger one, a source that reaches
    its limit gives all it may, and the report shows the shares that come out. Weights of sources without documents are spread over
    the others in proportion. A source that is NULL or not listed takes no part, nor do rows without tokens. A drawn sample misses the size due
    by at most half of its last document. The same seed draws the same documents, whatever the partitioning.
    """
    rows = sizes.where("tokens > 0").select(F.col(key).alias("key"), "source", F.col("tokens").cast("long").alias("tokens"))
    plan = [r for r in shares_available(rows, targets).collect() if r["available"] and (r["weight"] or 0) > 0 and (r["max_repeats"] or 0) > 0]  # a row for each listed source
    weight = sum(r["weight"] for r in plan)
    if total_tokens is None:
        total_tokens = min((r["max_repeats"] * r["available"] * weight / r["weight"] for r in plan), default=0)
    due = sizes.sparkSession.createDataFrame(
        [(r["source"], int(r["max_repeats"]), float(min(r["weight"] / weight * total_tokens, r["max_repeats"] * r["available"]))) for r in plan], "source string, max_repeats int, due double"
    )
    due = F.broadcast(due)

    def multiple(table: pd.DataFrame) -> pd.DataFrame:
        """The multiple of importance that gives the size due; the table has one row for each length of document."""
        x, n = table["tokens"].to_numpy(float), table["n"].to_numpy(float)
        g, limit, want = _importance(x), float(table["max_repeats"].iloc[0]), float(table["due"].iloc[0])
        low, high = 0.0, limit / g.min()
        for _ in range(80):
            middle = (low + high) / 2
            if (n * x * (middle * g).clip(max=limit)).sum() < want:
                low = middle
            else:
                high = middle
        return pd.DataFrame({"source": [table["source"].iloc[0]], "multiple": [high]})

    lengths = rows.join(due, "source").groupBy("source", "max_repeats", "due", "tokens").agg(F.count(F.lit(1)).alias("n"))
    factor = F.broadcast(lengths.groupBy("source").applyInPandas(multiple, "source string, multiple double"))
    u = (F.shiftrightunsigned(F.xxhash64("key", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(2**53))
    m = F.least(F.col("max_repeats").cast("double"), F.col("multiple") * F.log1p(F.col("tokens").cast("double")))
    each = rows.join(due.select("source", "max_repeats"), "source").join(factor, "source").withColumn("m", m)
    each = each.withColumn("whole", F.floor(F.col("m") + 1e-9)).withColumn("p", F.greatest(F.col("m") - F.col("whole"), F.lit(0.0))).withColumn("u", u)
    odds = (F.col("u") / (1 - F.col("u"))) * (1 - F.col("p")) / F.col("p")
    # The logarithm keeps the order, and its ranges stay small where most odds are alike.
    each = each.withColumn("rank", F.when(F.col("p") > 1e-9, F.ln(odds))).withColumn("range", F.floor(F.col("rank") * RANGES))
    each = written(each.select("key", "source", "tokens", "whole", "p", "rank", "range"), "ranked")
    need = each.groupBy("source").agg(F.sum(F.col("p") * F.col("tokens")).alias("need"))
    ranges = each.where("rank IS NOT NULL").groupBy("source", "range").agg(F.sum("tokens").alias("t"))
    # Odds lie between 2^-54 and 2^84, so there are some 200,000 rows a source at most, however many documents.
    before = ranges.withColumn("to", F.sum("t").over(Window.partitionBy("source").orderBy("range"))).join(F.broadcast(need), "source")
    edge = before.where("to > need").groupBy("source").agg(F.min_by(F.struct("range", (F.col("to") - F.col("t")).alias("from"), "need"), "range").alias("e")).select("source", F.col("e.range").alias("edge"), F.col("e.from").alias("from"), F.col("e.need").alias("need"))
    mark = each.join(F.broadcast(edge), "source", "left")
    sure = mark.where("rank IS NULL OR edge IS NULL OR range <> edge").withColumn("copies", F.col("whole") + F.when(F.col("rank").isNotNull() & (F.col("edge").isNull() | (F.col("range") < F.col("edge"))), 1).otherwise(0))
    last = mark.where("range = edge").withColumn("run", F.sum("tokens").over(Window.partitionBy("source").orderBy("rank", "key")) + F.col("from"))
    last = last.withColumn("copies", F.col("whole") + F.when(F.col("run") - F.col("tokens") / 2 <= F.col("need"), 1).otherwise(0))
    columns = [F.col("key").alias(key), "source", "tokens", F.col("copies").cast("int").alias("copies")]
    return sure.select(*columns).union(last.select(*columns)).where("copies > 0")


def share_report(draws: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """For each listed source: target and actual share of the drawn tokens, documents, drawn tokens, mean and greatest number of copies."""
    per = draws.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens").cast("long") * F.col("copies")).alias("drawn_tokens"), F.max("copies").alias("most_copies"))
    zero = F.lit(0).cast("long")
    out = shares_available(sizes.where("tokens > 0"), targets).join(per, "source", "left").withColumn("all", F.sum("drawn_tokens").over(Window.partitionBy(F.lit(0))))  # a row for each listed source
    return out.select("source", F.col("weight").alias("target_share"), F.coalesce(F.col("drawn_tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"), "available", F.coalesce("documents", zero).alias("documents"), F.coalesce("drawn_tokens", zero).alias("drawn_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats")


def draw_checks(draws: DataFrame, sizes: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """One row, all 0 for a right draw: documents above their limit, of sources without a target, drawn in two rows, and sources with documents and a weight of which none is drawn."""
    t = targets.select("source", "weight", "max_repeats").where("source IS NOT NULL").dropDuplicates(["source"])
    met = draws.join(t, "source", "left")
    one = met.agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("over_limit"), F.count_if(F.col("max_repeats").isNull()).alias("of_unlisted_sources"))
    twice = draws.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("drawn_twice"))
    due = shares_available(sizes.where("tokens > 0"), t).where("available > 0 AND weight > 0 AND max_repeats > 0")
    missing = due.join(draws.select("source").distinct(), "source", "left_anti").agg(F.count(F.lit(1)).alias("sources_missing"))
    single = lambda df: df.withColumn("_", F.lit(0))
    return single(one).join(single(twice), "_").join(single(missing), "_").drop("_")  # three single rows
