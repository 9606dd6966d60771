"""Queries of the problems that belong to the core: comparing two copies (p3), unpacking fields (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import compare, unpack
from ledgerline.sources.tables import once, table

PLACEMENT_FIELDS = ["relationType", "title", "statusLabel", "licenseNumber", "isCurrent", "updatedAt"]
PLACEMENT_KEYS = ["dhaUniqueId", "facilityId", "sourceSection"]


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    doctor = once(table(spark, folder, "doctor"), "id", "dhaUniqueId")
    placed = table(spark, folder, "doctor_facility").where(F.col("facilityId").isNotNull())
    register = placed.select("doctorId", "facilityId", "sourceSection", *PLACEMENT_FIELDS).join(doctor, placed["doctorId"] == doctor["id"], "left")
    return register, table(spark, folder, "doctor_facility_mirror")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    register, mirror = _sides(spark, folder)
    found = compare.differences(register, mirror, PLACEMENT_KEYS, PLACEMENT_FIELDS, missing_left="missing_in_register", missing_right="missing_in_mirror")
    return found.select(F.col("dhaUniqueId").alias("dha_unique_id"), F.col("facilityId").alias("facility_id"), F.col("sourceSection").alias("source_section"), "finding")


def p3_values(spark: SparkSession, folder: str) -> DataFrame:
    """As p3_found, with the two values as text."""
    register, mirror = _sides(spark, folder)
    found = compare.differences(register, mirror, PLACEMENT_KEYS, PLACEMENT_FIELDS, missing_left="missing_in_register", missing_right="missing_in_mirror", values=True)
    return found.select(F.col("dhaUniqueId").alias("dha_unique_id"), F.col("facilityId").alias("facility_id"), F.col("sourceSection").alias("source_section"), "finding", "left_value", "right_value")


def p3_summary(spark: SparkSession, folder: str) -> DataFrame:
    return compare.summary(p3_found(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    doctor = once(table(spark, folder, "doctor"), "id", "languages", "specialities")
    out = unpack.unpacked(doctor, ["id"], {"languages": unpack.LANGUAGES, "specialities": unpack.SPECIALITIES})
    return out.select(F.col("id").alias("doctor_id"), "field", "pos", "item")


_P3_SIDES = """
WITH d AS (SELECT DISTINCT id, dhaUniqueId FROM doctor),
a AS (SELECT DISTINCT d.dhaUniqueId AS k0, p.facilityId AS k1, p.sourceSection AS k2, relationType, title, statusLabel, licenseNumber, isCurrent, updatedAt
      FROM doctor_facility p LEFT JOIN d ON p.doctorId = d.id WHERE p.facilityId IS NOT NULL),
b AS (SELECT DISTINCT dhaUniqueId AS k0, facilityId AS k1, sourceSection AS k2, relationType, title, statusLabel, licenseNumber, isCurrent, updatedAt
      FROM doctor_facility_mirror),
j AS (SELECT coalesce(a.k0, b.k0) AS k0, coalesce(a.k1, b.k1) AS k1, coalesce(a.k2, b.k2) AS k2, a.k1 IS NULL AS no_a, b.k1 IS NULL AS no_b,
      {columns}
      FROM a FULL JOIN b ON a.k0 = b.k0 AND a.k1 = b.k1 AND a.k2 = b.k2)
"""


def _p3_sql(fields: list[str], values: bool) -> str:
    columns = ", ".join(f"a.{f} AS a_{f}, b.{f} AS b_{f}" for f in fields)
    head = "SELECT k0 AS dha_unique_id, k1 AS facility_id, k2 AS source_section"
    extra = ", CAST(NULL AS VARCHAR) AS left_value, CAST(NULL AS VARCHAR) AS right_value" if values else ""
    parts = [f"{head}, 'missing_in_mirror' AS finding{extra} FROM j WHERE no_b", f"{head}, 'missing_in_register' AS finding{extra} FROM j WHERE no_a"]
    for f in fields:
        shown = "CASE WHEN {c} IS NOT NULL THEN rtrim(rtrim(strftime(timezone('UTC', {c}), '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') || '+00' END" if f == "updatedAt" else "CAST({c} AS VARCHAR)"
        pair = f", {shown.format(c='a_' + f)} AS left_value, {shown.format(c='b_' + f)} AS right_value" if values else ""
        parts.append(f"{head}, '{f}' AS finding{pair} FROM j WHERE NOT no_a AND NOT no_b AND a_{f} IS DISTINCT FROM b_{f}")
    return _P3_SIDES.format(columns=columns) + "\nUNION ALL ".join(parts)


# A quoted text or a run without separators; quotes count only as pairs, and a JSON list is read as one.
_P5_BLANK = "'  ' || chr(9) || chr(10) || chr(13)"


def _p5_field(field: str, text: str, separators: str, single: bool) -> str:
    """Items of a field: matches of quoted stretches and letters that part nothing."""
    x = f"trim(x, {_P5_BLANK})"
    one = f"WHEN regexp_full_match({x}, '''[^'']*''') THEN {x}[2:-2]" if single else ""
    plain = f"""CASE WHEN regexp_full_match({x}, '"([^"]|"")*"') THEN replace({x}[2:-2], '""', '"') {one} ELSE x END"""
    listed = f"""CASE WHEN regexp_matches({field}, '^\\s*\\[\\s*"') AND json_valid({field}) THEN CAST(CAST({field} AS JSON) AS VARCHAR[]) END"""
    quoted = """"(?:[^"]|"")*\"""" + ("|''[^'']*''" if single else "")
    pieces = f"""regexp_extract_all({text}, '((?:{quoted}|[^"{separators}])+)')"""
    return f"""SELECT id AS doctor_id, '{field}' AS field, CAST(pos AS INTEGER) AS pos, item FROM (SELECT id, unnest(items) AS item, unnest(range(1, len(items) + 1)) AS pos FROM (
 SELECT id, list_filter(list_transform(coalesce({listed}, list_transform({pieces}, lambda x: {plain})), lambda x: trim(x, {_P5_BLANK})), lambda x: x <> '') AS items FROM (SELECT DISTINCT id, languages, specialities FROM doctor)))"""


_P5_AND = "regexp_replace({c}, '(?i)([  \"])(and|[-–—])([  \"])', '\\1,\\3', 'g')"
_P5 = _p5_field("languages", _P5_AND.format(c=_P5_AND.format(c="languages")), ",;|/+&\t\n\r،؛、，；", True) + "\nUNION ALL\n" + _p5_field("specialities", "replace(specialities, '//', '|')", "|;\t\n\r", False)

QUERIES = {"p3_found": p3_found, "p3_values": p3_values, "p3_summary": p3_summary, "p5_found": p5_found}
SQL = {
    "p5_found": _P5,
    "p3_found": _p3_sql(PLACEMENT_FIELDS, False),
    "p3_values": _p3_sql(PLACEMENT_FIELDS, True),
    "p3_summary": f"SELECT finding, count(*) AS rows FROM ({_p3_sql(PLACEMENT_FIELDS, False)}) GROUP BY finding",
}
