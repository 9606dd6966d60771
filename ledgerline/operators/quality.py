"""Checks of a built data set against its source, as one DataFrame of results [V1-V42]."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import register as R

COLUMNS = ["name", "level", "bad"]


def _check(name: str, bad: DataFrame) -> DataFrame:
    """A check that passes when `bad` has no row; bad is how many it has."""
    return bad.agg(F.count(F.lit(1)).alias("bad")).select(F.lit(name).alias("name"), F.when(F.col("bad") == 0, "PASS").otherwise("FAIL").alias("level"), "bad")


def _note(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("bad")).select(F.lit(name).alias("name"), F.lit("NOTE").alias("level"), "bad")


def _repeats(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def checks(people: DataFrame, facilities: DataFrame, link: DataFrame, counts: DataFrame, licences: DataFrame, facets: DataFrame, profiles: DataFrame, source: dict[str, DataFrame], meta: DataFrame | None = None) -> DataFrame:
    """(name, level, bad) of every check; any FAIL must keep the data set from being published.

    people: id; facilities: facility_id, type and, if they were classified, type_source; meta: what, n (all, active, pairs: published totals); link: as register.links(); counts: as register.facility_counts(); licences: id, licence_types; facets: facet, label, cnt;
    profiles: id, work, education (numbers of entries). source: doctor, facility, doctor_facility, doctor_licence_type as read. What the build made is
    derived again here from the source by other means (sets of pairs, anti-joins in both directions), never compared by counts alone.
    """
    doctor, place = source["doctor"].distinct(), source["doctor_facility"].distinct()
    active = doctor.where("removedAt IS NULL").select("id")
    removed = doctor.where("removedAt IS NOT NULL").select("id")
    known = source["facility"].select(F.col("id").alias("facility_id")).distinct()
    held = place.join(active.withColumnRenamed("id", "doctorId"), "doctorId", "left_semi").where("facilityId IS NOT NULL")
    held = held.select(F.col("doctorId").alias("doctor_id"), F.col("facilityId").alias("facility_id"), "isCurrent", "relationType", "statusLabel", "title", "sourceSection").join(known, "facility_id", "left_semi")
    pair = ["doctor_id", "facility_id"]
    now = held.where("isCurrent = 1 OR relationType IN ('current_license', 'search_stage')").select(*pair).distinct()
    primary = held.where("relationType = 'search_stage'").select(*pair).distinct()
    licensed = held.where("relationType = 'current_license' AND statusLabel = 'Active License'").select(*pair).distinct()
    present = held.where("relationType = 'employment_history' AND isCurrent = 1").select(*pair).distinct()
    # Who works where, once more: printed names are matched as rows, not inside arrays.
    names = source["facility"].select(F.col("id").alias("facility_id"), R.facility_key(F.col("nameTrimmed")).alias("key")).distinct()
    printed = doctor.select(F.col("id").alias("doctor_id"), F.explode(F.split(F.coalesce("specialities", F.lit("")), r" \| ")).alias("e")).select("doctor_id", F.get(F.split("e", " · "), F.lit(1)).alias("n")).where("n IS NOT NULL")
    printed = printed.select("doctor_id", R.facility_key(F.regexp_replace(F.regexp_replace(F.trim("n"), r"(?i)\s+and\s+\d+\s+others?\b.*$", ""), r"(?i)\s*Show All\s*$", "")).alias("key")).where("key <> ''").join(names, "key").select(*pair)
    staff = licensed.join(printed.union(present).union(primary).distinct(), pair, "left_semi")
    mine = lambda c: link.where(F.col(c)).select(*pair)
    both = lambda a, b: a.join(b, pair, "left_anti").union(b.join(a, pair, "left_anti"))
    again = staff.groupBy("facility_id").agg(F.count(F.lit(1)).alias("n"))
    member = source["doctor_licence_type"].where("trim(licenceType) <> ''").select(F.col("doctorId").alias("id"), F.trim("licenceType").alias("label")).distinct().join(active, "id", "left_semi")
    exported = licences.select("id", F.explode("licence_types").alias("label"))
    facet = facets.where("facet = 'licence'").select("label", "cnt")
    rebuilt = exported.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    entries = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x) != ""))
    prof = profiles.join(doctor.select("id", entries(F.col("experience")).alias("w"), entries(F.col("education")).alias("e")), "id")
    titles = held.where("relationType = 'current_license' AND statusLabel = 'Active License' AND trim(title) <> ''").select(*pair, F.regexp_replace(F.trim("title"), r"\s+", " ").alias("role")).distinct()
    roles = link.select(*pair, F.explode("roles").alias("role"))
    # Licence names once more, from the source's rows alone.
    scalar = doctor.join(active, "id", "left_semi").join(source["doctor_licence_type"].where("trim(licenceType) <> ''").select(F.col("doctorId").alias("id")), "id", "left_anti").where("trim(licenseType) <> ''")
    names_of = F.create_map(*[F.lit(x) for kv in R.LICENCE_NAMES.items() for x in kv])
    fallback = scalar.select("id", F.coalesce(F.try_element_at(names_of, F.trim("licenseType")), F.trim("licenseType")).alias("label"))
    expected = member.union(fallback).groupBy("label").agg(F.count(F.lit(1)).alias("e"))
    any_licence = held.where("relationType = 'current_license'").select(*pair).distinct()
    own = doctor.select(F.col("id").alias("doctor_id"), R.specialty(F.trim(F.regexp_replace("speciality", r"\s+", " "))).alias("own"))
    several = titles.groupBy(*pair).agg(F.count(F.lit(1)).alias("titles"), F.min("role").alias("only")).join(own, "doctor_id").where("titles > 1 OR NOT (only <=> own)")
    due = titles.join(several.select(*pair), pair, "left_semi")
    classified = "type_source" in facilities.columns
    staffed = mine("is_current").join(facilities.select("facility_id", "type"), "facility_id").select(F.col("type").alias("label")).distinct()
    offered = facets.where("facet = 'facility_type'").select("label")
    empty = lambda df: df.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    out = [
        _check("no removed person is exported", people.select("id").join(removed, "id", "left_semi")),
        _check("every active person is exported", active.join(people, "id", "left_anti")),
        _check("no person is invented", people.select("id").join(doctor, "id", "left_anti")),
        _check("no person is exported twice", _repeats(people, "id")),
        _check("every facility is exported", known.join(facilities, "facility_id", "left_anti")),
        _check("no facility is invented", facilities.select("facility_id").join(known, "facility_id", "left_anti")),
        _check("no facility is exported twice", _repeats(facilities, "facility_id")),
        _check("no pair is listed twice", _repeats(link, *pair)),
        _check("every link is of an exported person", link.select(F.col("doctor_id").alias("id")).join(people, "id", "left_anti")),
        _check("every link is of an exported facility", link.select("facility_id").join(facilities, "facility_id", "left_anti")),
        _check("identity of placements is unique", _repeats(held, *pair, "relationType", "sourceSection", "title")),
        _check("current pairs equal the source's", both(mine("is_current"), now)),
        _check("primary pairs equal the source's", both(mine("is_primary"), primary)),
        _check("primary pairs are current", mine("is_primary").join(mine("is_current"), pair, "left_anti")),
        _check("licensed facilities are linked", licensed.join(link, pair, "left_anti")),
        _check("staff equals its second derivation", both(mine("is_licensed"), staff)),
        _check("licensed counts equal the pairs", counts.join(again, "facility_id", "left").where("licensed_count <> coalesce(n, 0)")),
        _check("licensed is at most linked", counts.where("licensed_count > doctor_count")),
        _check("primary is at most linked", counts.where("primary_count > doctor_count")),
        _check("every counted facility has a count", counts.where("all_count IS NULL OR all_count = 0")),
        _check("roles are titles of the source", roles.join(titles, [*pair, "role"], "left_anti")),
        _check("licence facet equals a rebuild", facet.join(rebuilt, "label", "full_outer").where("NOT (cnt <=> n)")),
        _check("licence facet equals the source's", facet.join(expected, "label", "full_outer").where("NOT (cnt <=> e)")),
        _check("people without membership have their own licence", fallback.join(exported, ["id", "label"], "left_anti")),
        _check("licences are lists", licences.where(F.lit(dict(licences.dtypes).get("licence_types") != "array<string>"))),
        _check("some people are at several facilities", empty(mine("is_current").groupBy("doctor_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))),
        _check("every present licence's facility is linked", any_licence.join(link, pair, "left_anti")),
        _check("no licensed facility twice", _repeats(link.where("is_licensed"), *pair)),
        _check("every primary facility is known", mine("is_primary").join(known, "facility_id", "left_anti")),
        _check("roles are complete", due.join(roles, [*pair, "role"], "left_anti")),
        _check("roles are counted", roles.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).join(due.groupBy(*pair).agg(F.count(F.lit(1)).alias("m")), pair, "full_outer").where("NOT (n <=> m)")),
        _check("memberships are all exported", member.join(exported, ["id", "label"], "left_anti")),
        _check("some memberships come from the filter pass", source["doctor_licence_type"].agg(F.count_if(F.col("source") == "filter_pass").alias("n")).where("n = 0")),
        _check("every facility has a type", facilities.where("type IS NULL")),
        _check("work entries are all preserved", prof.where("work <> w")),
        _check("education entries are all preserved", prof.where("education <> e")),
        _check("people with education are all preserved", prof.where("(education > 0) <> (e > 0)")),
        _check("every profile is of a person", profiles.select("id").join(doctor, "id", "left_anti")),
        _note("people without any facility", people.join(mine("is_current").select(F.col("doctor_id").alias("id")).distinct(), "id", "left_anti")),
        _note("facilities of the catch-all type", facilities.where("type = 'other'")),
        _note("people at several facilities", mine("is_current").groupBy("doctor_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")),
    ]
    if classified:
        evidence = facilities.where("type = 'other'").join(mine("is_current").select("facility_id").distinct(), "facility_id", "left_semi")
        out.append(_check("no facility with staff is of the catch-all type", evidence))
        out.append(_check("not all kinds are the register's own guess", empty(facilities.where("type_source <> 'dha_type'"))))
    if not offered.isEmpty():
        out.append(_check("every staffed kind is offered", staffed.where("label IS NOT NULL").join(offered, "label", "left_anti")))
    if meta is not None:
        total = lambda what, df: meta.where(F.col("what") == what).withColumn("_", F.lit(0)).join(df.agg(F.count(F.lit(1)).alias("have")).withColumn("_", F.lit(0)), "_", "full_outer").where("NOT (n <=> have)")
        out += [
            _check("published number of people", total("active", people)),
            _check("published number of people ever", total("all", doctor.select("id").distinct())),
            _check("published removals", meta.where("what IN ('all', 'active')").agg(F.sum(F.when(F.col("what") == "all", F.col("n")).otherwise(-F.col("n"))).alias("gone")).withColumn("_", F.lit(0)).join(removed.distinct().agg(F.count(F.lit(1)).alias("have")).withColumn("_", F.lit(0)), "_").where("NOT (gone <=> have)")),
            _check("published number of pairs", total("pairs", link)),
        ]
    out.append(_check("number of facilities", facilities.agg(F.count(F.lit(1)).alias("n")).withColumn("_", F.lit(0)).join(known.agg(F.count(F.lit(1)).alias("m")).withColumn("_", F.lit(0)), "_").where("n <> m")))
    nowhere = people.join(mine("is_current").select(F.col("doctor_id").alias("id")).distinct(), "id", "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("_", F.lit(0))
    out.append(_check("people without a facility as in the source", nowhere.join(active.join(now.select(F.col("doctor_id").alias("id")).distinct(), "id", "left_anti").agg(F.count(F.lit(1)).alias("m")).withColumn("_", F.lit(0)), "_").where("n <> m")))
    return reduce(DataFrame.union, out).select(*COLUMNS)


def failed(report: DataFrame) -> list[str]:
    """Names of the checks that fail."""
    return [r["name"] for r in report.where("level = 'FAIL'").select("name").collect()]
