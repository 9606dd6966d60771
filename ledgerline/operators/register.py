"""From the register's tables to people, facilities and the links between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions.text import blank_to_null, facility_key, short_hours, slug, squeezed
from ledgerline.operators.ranking import positions

# Licence scalars and the names they stand for.
LICENCE_NAMES = {"FTL": "Full-time License", "PTL": "Part-time License", "REG": "Registered", "TRL": "Trainee License"}
# Days in the order they are shown.
DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def active(doctors: DataFrame) -> DataFrame:
    """[P8] People not removed; all of them where the column is missing."""
    return doctors.where("removedAt IS NULL") if "removedAt" in doctors.columns else doctors


def category(c: Column) -> Column:
    """[P2] Part before the first dash, unless the text begins with it."""
    at = F.locate("-", c)
    return F.when(at > 1, F.trim(F.substring_index(c, "-", 1))).otherwise(c)


def specialty(c: Column) -> Column:
    """[P2] Part behind the first dash, NULL if there is none."""
    at = F.locate("-", c)
    return F.nullif(F.when(at > 1, F.trim(c.substr(at + 1, F.length(c)))).otherwise(""), F.lit(""))


def printed_facilities(c: Column) -> Column:
    """[P11] Keys of the facility names that licence text prints; those behind "and N others" are not printed."""
    entries = F.transform(F.split(F.coalesce(c, F.lit("")), r" \| "), lambda e: F.get(F.split(e, " · "), F.lit(1)))
    names = F.transform(F.filter(entries, lambda x: x.isNotNull()), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"(?i)\s+and\s+\d+\s+others?\b.*$", ""), r"(?i)\s*Show All\s*$", "")))
    return F.array_distinct(F.filter(F.transform(names, facility_key), lambda x: x != ""))


def links(doctors: DataFrame, placements: DataFrame, facilities: DataFrame) -> DataFrame:
    """[J1, J2, P9-P13, P16, W7] One row for each active person and known facility.

    doctor_id, facility_id, is_current, is_past, is_primary, is_licensed (an active licence that the printed text, a present job or
    the primary placement bears out), roles (titles of active licences, sorted; empty where they say only the person's own specialty) and
    first_at, current placements before past ones. Rows repeated in full count once; placements of unknown people or facilities are left out.
    """
    people = active(doctors).select(F.col("id").alias("doctor_id"), specialty(squeezed("speciality")).alias("own"), printed_facilities(F.col("specialities")).alias("printed")).dropDuplicates(["doctor_id"])
    places = facilities.select(F.col("id").alias("facility_id"), facility_key(F.col("nameTrimmed")).alias("facility_key")).dropDuplicates(["facility_id"])
    kind = F.col("relationType")
    now = (F.col("isCurrent") == 1) | kind.isin("current_license", "search_stage")
    licence = (kind == "current_license") & (F.col("statusLabel") == "Active License")
    yes = lambda c: F.coalesce(c, F.lit(False))
    grouped = placements.groupBy(F.col("doctorId").alias("doctor_id"), F.col("facilityId").alias("facility_id")).agg(
        F.max(yes(now)).alias("is_current"),
        F.max(yes(kind == "search_stage")).alias("is_primary"),
        F.max(yes(licence)).alias("licence"),
        F.max(yes((kind == "employment_history") & (F.col("isCurrent") == 1))).alias("present"),
        F.array_sort(F.collect_set(F.when(licence, blank_to_null(F.col("title"))))).alias("titles"),
        F.min(F.when(yes(now), F.col("createdAt"))).alias("current_at"),
        F.min("createdAt").alias("any_at"),
    )
    all_ = grouped.join(people, "doctor_id").join(places, "facility_id")
    named = F.array_contains("printed", F.col("facility_key"))
    return all_.select(
        "doctor_id",
        "facility_id",
        "is_current",
        (~F.col("is_current")).alias("is_past"),
        "is_primary",
        (F.col("licence") & (named | F.col("present") | F.col("is_primary"))).alias("is_licensed"),
        F.when((F.size("titles") == 1) & F.array_contains("titles", F.coalesce("own", F.lit(""))), F.array().cast("array<string>")).otherwise(F.col("titles")).alias("roles"),
        F.coalesce("current_at", "any_at").alias("first_at"),
    )


def facility_counts(link: DataFrame) -> DataFrame:
    """[A1-A3] People of each facility: linked at all, current, primary, licensed. One pass."""
    count = lambda c: F.count_if(c).alias
    return link.groupBy("facility_id").agg(F.count(F.lit(1)).alias("all_count"), count(F.col("is_current"))("doctor_count"), count(F.col("is_primary"))("primary_count"), count(F.col("is_licensed"))("licensed_count"))


def facility_positions(facilities: DataFrame, counts: DataFrame) -> DataFrame:
    """[O24] Facilities with their counts and a position: most people first, then by name."""
    f = facilities.select(F.col("id").alias("facility_id"), "nameTrimmed").dropDuplicates(["facility_id"])
    joined = f.join(counts, "facility_id", "left").fillna(0, ["all_count", "doctor_count", "primary_count", "licensed_count"])
    return positions(joined, [F.desc("all_count"), F.asc("nameTrimmed"), F.asc("facility_id")], "facility_pos")


def unique_slugs(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """[P6, W1] df with `slug`: the second of equal slugs gets -2 and so on, in the given order, past the numbers that other names have by nature, so no two are equal."""
    base = df.withColumn("_slug", slug(F.col(name)))
    n = F.row_number().over(Window.partitionBy("_slug").orderBy(*order))
    rows = base.withColumn("_n", n)
    # Names that end in a number take it away from the name before it.
    ends = rows.where("_n = 1").select(F.regexp_extract("_slug", r"^(.+)-([0-9]{1,9})$", 1).alias("_slug"), F.regexp_extract("_slug", r"^(.+)-([1-9][0-9]{0,8})$", 2).try_cast("int").alias("_taken")).where("_taken >= 2")
    ends = ends.withColumn("_at", F.col("_taken") - F.row_number().over(Window.partitionBy("_slug").orderBy("_taken")) + 1).groupBy("_slug", "_at").agg(F.count(F.lit(1)).alias("_k"))
    wanted = rows.withColumnsRenamed({"_n": "_at"}).withColumn("_k", F.lit(0).cast("long")).withColumn("_row", F.lit(True))
    every = wanted.unionByName(ends.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    shift = F.sum("_k").over(Window.partitionBy("_slug").orderBy("_at", "_row").rowsBetween(Window.unboundedPreceding, 0))
    number = F.when(F.col("_at") > 1, F.col("_at") + F.col("_shift"))
    out = every.withColumn("_shift", shift).where("_row")
    return out.withColumn("slug", F.concat("_slug", F.coalesce(F.concat(F.lit("-"), number.cast("string")), F.lit("")))).select(*df.columns, "slug")


def licence_names(doctors: DataFrame, licences: DataFrame) -> DataFrame:
    """[P14, J3] id and licence_types: the membership rows if there are any, else the scalar's name, else none. Sorted."""
    members = licences.groupBy(F.col("doctorId").alias("id")).agg(F.array_sort(F.collect_set(blank_to_null(F.col("licenceType")))).alias("members"))
    long = F.create_map(*[F.lit(x) for kv in LICENCE_NAMES.items() for x in kv])
    scalar = blank_to_null(F.col("licenseType"))
    joined = active(doctors).select("id", "licenseType").distinct().join(members, "id", "left")
    return joined.select("id", F.when(F.size(F.coalesce("members", F.array())) > 0, F.col("members")).when(scalar.isNotNull(), F.array(F.coalesce(F.try_element_at(long, scalar), scalar))).otherwise(F.array().cast("array<string>")).alias("licence_types"))


def static_facets(doctors: DataFrame, licences: DataFrame, link: DataFrame | None = None, facilities: DataFrame | None = None) -> DataFrame:
    """[A5] (facet, label, cnt) over active people; with links and facilities (facility_id, facility, type) also where they work now, once for each place and for each kind of place."""
    people = active(doctors).select("id", squeezed("speciality").alias("s"), blank_to_null(F.col("nationality")).alias("nationality"), "languages").distinct()
    held = licence_names(doctors, licences)
    one = lambda facet, c: F.struct(F.lit(facet).alias("facet"), c.alias("label"))
    spoken = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(squeezed("languages"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))
    scalars = F.array(one("category", F.nullif(category(F.col("s")), F.lit(""))), one("specialty", specialty(F.col("s"))), one("nationality", F.col("nationality")))
    out = people.select(F.explode(F.concat(scalars, F.transform(spoken, lambda x: one("language", x)))).alias("x")).select("x.*")
    out = out.union(held.select(F.lit("licence").alias("facet"), F.explode("licence_types").alias("label")))
    if link is not None and facilities is not None:
        at = link.where("is_current").select("doctor_id", "facility_id").join(facilities.select("facility_id", "facility", "type").dropDuplicates(["facility_id"]), "facility_id")
        out = out.union(at.select(F.lit("facility"), "facility")).union(at.where("type IS NOT NULL").select("doctor_id", "type").distinct().select(F.lit("facility_type"), "type"))
    return out.where("label IS NOT NULL").groupBy("facet", "label").agg(F.count(F.lit(1)).alias("cnt"))


def top_specialties(link: DataFrame, doctors: DataFrame, n: int = 3) -> DataFrame:
    """[A8, W2] The n most frequent specialties of each facility's current people; ties by name."""
    own = active(doctors).select(F.col("id").alias("doctor_id"), specialty(squeezed("speciality")).alias("specialty")).distinct().where("specialty IS NOT NULL")
    counted = link.where("is_current").join(own, "doctor_id").groupBy("facility_id", "specialty").agg(F.count(F.lit(1)).alias("cnt"))
    rank = F.row_number().over(Window.partitionBy("facility_id").orderBy(F.desc("cnt"), "specialty"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= n)


def opening_hours(c: Column) -> Column:
    """[P5] Array of (day, label) from the JSON text, Sunday first; NULL where it is broken or no day has anything."""
    interval = "struct<StartDropDown:string,EndDropDown:string>"
    day = f"struct<is24Hours:string,isClosed:string,timeIntervals:array<{interval}>>"
    parsed = F.from_json(c, f"map<string,{day}>")
    def label(d: Column) -> Column:
        spans = F.transform(F.filter(d["timeIntervals"], lambda x: x["StartDropDown"].isNotNull() & x["EndDropDown"].isNotNull()), lambda x: F.concat(short_hours(x["StartDropDown"]), F.lit(" – "), short_hours(x["EndDropDown"])))
        return F.when(F.lower(d["is24Hours"]) == "true", "24 hours").when(F.lower(d["isClosed"]) == "true", "Closed").when(F.size(spans) > 0, F.array_join(spans, ", "))
    rows = F.filter(F.array(*[F.struct(F.lit(n).alias("day"), label(F.try_element_at(parsed, F.lit(n))).alias("label")) for n in DAYS]), lambda x: x["label"].isNotNull())
    return F.when(F.size(rows) > 0, rows)


# How parts of profile entries are told apart.
_DATES = r"(?i)^(\d{1,2}\s+[A-Za-z]+\s+\d{4})\s*-\s*(\d{1,2}\s+[A-Za-z]+\s+\d{4}|Present|Current)\s*(?:\(([^)]*)\))?$"
_LICENCE = r"(?i)^Licen[cs]e\s*:\s*(.+)$"
_PRESENT = r"(?i)\s*\((?:Present|Current)\)\s*$"
_GRADUATED = r"(?i)^Graduated\s+(\d{4})$"
_VERIFIED = r"(?i)\s*\(([^)]*verified[^)]*)\)\s*$"
_LEVEL = r"(?i)^(?:pre[- ]?university|higher secondary|secondary|high school|intermediate|matriculation|primary|foundation)$"
_INSTITUTION = (
    r"(?i)(?<![A-Za-z0-9_])(?:universit(?:y|e|ies|à|ä|é)|univ|college|colleges|institute|institutes|institut|school|schools|academy|faculty|hospital|board|council|society|royal college|department|directorate|"
    r"centre|center|polytechnic|seminary|conservatory|escuela|escola|universidad|universidade|universita|universitas|universitat|universite)(?![A-Za-z0-9_])"
)
_QUALIFICATION = (
    r"(?i)(?<![A-Za-z0-9_])(?:diploma|diplome|certificate|certification|certified|degree|bachelor|bachelors|master|masters|doctorate|doctoral|doctor of|fellowship|membership|residency|internship|licentiate|associate|"
    r"higher secondary|pre[- ]?university|post[- ]?graduate|postgraduate|undergraduate|specialization|specialisation|m\.?b\.?b\.?s|b\.?d\.?s|m\.?d\.?s|m\.?d|m\.?sc|b\.?sc|m\.?s|b\.?s|b\.?a|m\.?a|m\.?ph|d\.?d\.?s|"
    r"d\.?m\.?d|ph\.?d|pharm\.?d|b\.?pharm|m\.?pharm|d\.?n\.?b|f\.?r\.?c\.?[a-z]|m\.?r\.?c\.?[a-z]|d\.?c\.?h|b\.?p\.?t|m\.?p\.?t|dip)(?![A-Za-z0-9_])"
)


def _parts(entry: Column) -> Column:
    return F.filter(F.transform(F.split(entry, "·"), lambda x: F.trim(x)), lambda p: p != "")


def _entries(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(squeezed(c), F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def experience(c: Column) -> Column:
    """Array of work entries. Parts are known by their form (licence number, range of dates); of the others the first is the title, and
    with three or more the second is the facility and the last the place; a second of two is the facility if there is a licence, else the place. An entry that ends
    in "(Present)" is current."""
    def entry(e: Column) -> Column:
        parts = _parts(F.regexp_replace(e, _PRESENT, ""))
        lic, dates = F.filter(parts, lambda p: p.rlike(_LICENCE)), F.filter(parts, lambda p: p.rlike(_DATES))
        rest = F.filter(parts, lambda p: ~p.rlike(_LICENCE) & ~p.rlike(_DATES))
        n, date = F.size(rest), F.get(dates, F.lit(0))
        part = lambda i: F.nullif(F.regexp_extract(date, _DATES, i), F.lit(""))
        second = F.get(rest, F.lit(1))
        return F.struct(
            F.get(rest, F.lit(0)).alias("title"),
            F.when((n > 2) | ((n == 2) & (F.size(lic) > 0)), second).alias("facility"),
            F.when(n > 2, F.get(rest, F.size(rest) - 1)).when((n == 2) & (F.size(lic) == 0), second).alias("place"),
            F.regexp_extract(F.get(lic, F.lit(0)), _LICENCE, 1).alias("licence_number"),
            part(1).alias("start"), part(2).alias("end"), part(3).alias("duration"), e.rlike(_PRESENT).alias("is_current"),
        )
    return F.transform(_entries(c), entry)


def education(c: Column) -> Column:
    """Array of education entries: qualification, institution, heading, graduated (year), country, location, verification, extra.

    With three values and more the first is the qualification, the second the institution, the last the place and the rest extra. Of two the first is an institution, a
    qualification or, where neither is told by its words, a heading, and the second the place. A single one is an institution or a place.
    """
    def entry(e: Column) -> Column:
        parts = _parts(e)
        graduated = F.filter(parts, lambda p: p.rlike(_GRADUATED))
        rest = F.filter(parts, lambda p: ~p.rlike(_GRADUATED))
        n, first = F.size(rest), F.get(rest, F.lit(0))
        school = first.rlike(_INSTITUTION) & ~first.rlike(_LEVEL)
        degree = ~school & (first.rlike(_LEVEL) | first.rlike(_QUALIFICATION))
        place = F.when((n > 1) | ((n == 1) & ~school), F.get(rest, F.size(rest) - 1))
        bare = F.nullif(F.trim(F.regexp_replace(place, _VERIFIED, "")), F.lit(""))
        split = bare.rlike(r"^[^,]+,\s*.+$")
        return F.struct(
            F.when((n > 2) | ((n == 2) & degree), first).alias("qualification"),
            F.when(n > 2, F.get(rest, F.lit(1))).when((n > 0) & school, first).alias("institution"),
            F.when((n == 2) & ~school & ~degree, first).alias("heading"),
            F.regexp_extract(F.get(graduated, F.size(graduated) - 1), _GRADUATED, 1).alias("graduated"),
            F.when(split, F.trim(F.regexp_extract(bare, r"^([^,]+),\s*(.+)$", 1))).alias("country"),
            F.when(split, F.trim(F.regexp_extract(bare, r"^([^,]+),\s*(.+)$", 2))).otherwise(bare).alias("location"),
            F.nullif(F.trim(F.regexp_extract(place, _VERIFIED, 1)), F.lit("")).alias("verification"),
            F.when(n > 3, F.slice(rest, 3, F.greatest(n - 3, F.lit(0)))).otherwise(F.array().cast("array<string>")).alias("extra"),
        )
    return F.transform(_entries(c), entry)


def resolved_by_unique_name(names: DataFrame, key: str, value: str) -> DataFrame:
    """[J9, A18] (key, value) of keys that name exactly one value; ambiguous ones are left out."""
    return names.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("n"), F.min(value).alias(value)).where("n = 1").select(key, value)
