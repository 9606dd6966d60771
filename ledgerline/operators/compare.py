"""Differences between two copies of a table: one shuffle, no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _tagged(df: DataFrame, keys: list[str], fields: list[str], side: int) -> DataFrame:
    key = [F.col(_quoted(k)).alias(f"k{i}") for i, k in enumerate(keys)]
    row = F.struct(*[F.col(_quoted(f)).alias(f"f{i}") for i, f in enumerate(fields)]) if fields else F.struct(F.lit(0).alias("none"))
    return df.select(*key, (row if side == 0 else F.lit(None).cast(df.select(row.alias("r")).schema["r"].dataType)).alias("a"), (row if side == 1 else F.lit(None).cast(df.select(row.alias("r")).schema["r"].dataType)).alias("b"))


def paired(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per key: the keys (k0..), and one struct (f0..) a side, NULL where that side lacks the key.

    The sides are tagged, put under one another and grouped once. Rows repeated in full count once; where a
    side has several different rows of one key, its greatest row (field by field, NULL first) stands for it. A NULL key
    equals a NULL key. Both sides must have the fields in the same types; columns that are neither key nor field
    may have any names. Partial aggregation runs before the shuffle, so a key repeated without end is one row
    a task by then.
    """
    both = _tagged(left, keys, fields, 0).unionByName(_tagged(right, keys, fields, 1))
    return both.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.max("a").alias("a"), F.max("b").alias("b"))


def findings_expr(fields: list[str], missing_left: str, missing_right: str) -> Column:
    """Array of findings of a paired() row, as generated SQL over the two structs."""
    tests = ", ".join(f"IF(a.f{i} <=> b.f{i}, NULL, {_text(f)})" for i, f in enumerate(fields))
    differ = f"filter(array({tests}), x -> x IS NOT NULL)" if fields else "CAST(array() AS array<string>)"
    return F.expr(f"CASE WHEN b IS NULL THEN array({_text(missing_right)}) WHEN a IS NULL THEN array({_text(missing_left)}) ELSE {differ} END")


def _shown(value: Column, kind: T.DataType) -> Column:
    """The value as text; a timestamp in UTC whatever the session's time zone, as 2024-01-31 10:20:30.5+00."""
    if not isinstance(kind, T.TimestampType):
        return value.cast("string")
    micros = F.unix_micros(value)
    seconds = F.make_dt_interval(secs=(micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))
    return F.concat((F.lit("1970-01-01").cast("timestamp_ntz") + seconds).cast("string"), F.lit("+00"))


def differences(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    fields: list[str],
    *,
    missing_left: str = "missing_in_left",
    missing_right: str = "missing_in_right",
    values: bool = False,
) -> DataFrame:
    """Key columns and `finding`: a side that lacks the key, or the name of a field whose values differ.

    NULL equals NULL and differs from empty text; everything else compares exactly as stored. With
    values=True the two values come along as text (left_value, right_value; both NULL for a missing row; timestamps in UTC). Empty
    tables are allowed on either side: every key of the other is then missing. See paired() for repeated rows.
    """
    rows = paired(left, right, keys, fields)
    found = rows.withColumn("finding", F.explode(findings_expr(fields, missing_left, missing_right)))
    out = [F.col(f"k{i}").alias(k) for i, k in enumerate(keys)] + [F.col("finding")]
    if values:
        for side, name in (("a", "left_value"), ("b", "right_value")):
            kinds = [f.dataType for f in rows.schema[side].dataType.fields]
            pick = F.coalesce(*[F.when(F.col("finding") == f, _shown(F.col(f"{side}.f{i}"), kinds[i])) for i, f in enumerate(fields)]) if fields else F.lit(None).cast("string")
            out.append(pick.alias(name))
    return found.select(*out)


def summary(found: DataFrame) -> DataFrame:
    """Number of rows of each finding."""
    return found.groupBy("finding").agg(F.count(F.lit(1)).alias("rows"))
