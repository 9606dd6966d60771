"""Queries over the register."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.text import COMPANY_WORDS, FACILITY_SPELLINGS, shard, squeezed
from ledgerline.operators import classify, quality
from ledgerline.operators import register as R
from ledgerline.sources.lineage import written
from ledgerline.sources.tables import once, table


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return R.links(table(spark, folder, "doctor"), table(spark, folder, "doctor_facility"), table(spark, folder, "facility"))


def links(spark: SparkSession, folder: str) -> DataFrame:
    return _links(spark, folder).select("doctor_id", "facility_id", "is_current", "is_past", "is_primary", "is_licensed", F.array_join("roles", "||").alias("roles"))


def facility_counts(spark: SparkSession, folder: str) -> DataFrame:
    return R.facility_positions(table(spark, folder, "facility"), R.facility_counts(_links(spark, folder)))


def top_specialties(spark: SparkSession, folder: str) -> DataFrame:
    return R.top_specialties(_links(spark, folder), table(spark, folder, "doctor"))


def licence_names(spark: SparkSession, folder: str) -> DataFrame:
    out = R.licence_names(table(spark, folder, "doctor"), table(spark, folder, "doctor_licence_type"))
    return out.select("id", F.array_join("licence_types", "|").alias("licence_types"))


def category_split(spark: SparkSession, folder: str) -> DataFrame:
    d = once(table(spark, folder, "doctor"), "id", "speciality")
    return d.select("id", R.category(squeezed("speciality")).alias("category"), R.specialty(squeezed("speciality")).alias("specialty"))


def static_facets(spark: SparkSession, folder: str) -> DataFrame:
    f = once(table(spark, folder, "facility"), "id", "nameTrimmed", "typeGuess").select(F.col("id").alias("facility_id"), F.col("nameTrimmed").alias("facility"), F.col("typeGuess").alias("type"))
    return R.static_facets(table(spark, folder, "doctor"), table(spark, folder, "doctor_licence_type"), _links(spark, folder), f)


def slug_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    d = once(table(spark, folder, "doctor"), "id", "name").where("name IS NOT NULL").withColumn("first", F.regexp_extract("name", r"^\s*(\S+)", 1))
    return R.unique_slugs(d, "first", ["id"]).select("id", "slug")


def lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    """[J4, J17] Placements of active people, and active people without one."""
    people = once(table(spark, folder, "doctor"), "id", "removedAt").where("removedAt IS NULL").select("id")
    placed = once(table(spark, folder, "doctor_facility"))
    a = placed.join(people.withColumnRenamed("id", "doctorId"), "doctorId", "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit("placements of active people").alias("what"), "n")
    b = people.join(placed.select(F.col("doctorId").alias("id")), "id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("active people without placement").alias("what"), "n")
    return a.union(b)


def unique_facility_names(spark: SparkSession, folder: str) -> DataFrame:
    """[J9] Work-history facility names that name exactly one facility."""
    f = once(table(spark, folder, "facility"), "id", "nameTrimmed").select(F.lower(F.trim("nameTrimmed")).alias("key"), "id")
    known = R.resolved_by_unique_name(f, "key", "id")
    work = once(table(spark, folder, "doctor"), "id", "experience").select(F.col("id").alias("doctor_id"), F.posexplode(R.experience(F.col("experience"))).alias("pos", "e"))
    # Entries here print title, facility and dates; the facility is the second part.
    named = work.select("doctor_id", "pos", F.lower(F.trim(F.coalesce("e.facility", "e.place"))).alias("key"))
    return named.join(known, "key").select("doctor_id", "pos", F.col("id").alias("facility_id"))


def profile_totals(spark: SparkSession, folder: str) -> DataFrame:
    """[A14] Entries of work and education, and people with any."""
    d = once(table(spark, folder, "doctor"), "id", "experience", "education")
    w, e = F.size(R.experience(F.col("experience"))), F.size(R.education(F.col("education")))
    return d.agg(F.sum(w).alias("work_entries"), F.sum(e).alias("education_entries"), F.count_if(w > 0).alias("with_work"), F.count_if(e > 0).alias("with_education"))


def education_years(spark: SparkSession, folder: str) -> DataFrame:
    d = once(table(spark, folder, "doctor"), "id", "education").select("id", F.explode(R.education(F.col("education"))).alias("e"))
    return d.where("e.graduated <> ''").groupBy(F.col("e.institution").alias("institution"), F.col("e.graduated").alias("graduated")).agg(F.count(F.lit(1)).alias("cnt"))


def opening_hours(spark: SparkSession, folder: str) -> DataFrame:
    f = once(table(spark, folder, "facility"), "id", "operatingHours")
    return f.select("id", F.explode(R.opening_hours(F.col("operatingHours"))).alias("h")).select("id", "h.day", "h.label")


def type_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """[A9, J6] Facilities of each kind, and people once for each kind they are placed at."""
    f = once(table(spark, folder, "facility"), "id", "typeGuess").select(F.col("id").alias("facility_id"), F.col("typeGuess").alias("type"))
    people = _links(spark, folder).where("is_current").join(f, "facility_id").groupBy("type").agg(F.count_distinct("doctor_id").alias("professionals"))
    return f.groupBy("type").agg(F.count(F.lit(1)).alias("facilities")).join(people, "type", "left").fillna(0, ["professionals"])


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """[A12, A13, A30] Figures of the whole register, one aggregation for each table."""
    d = once(table(spark, folder, "doctor"), "id", "removedAt", "mobileNumber", "personalEmail")
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    people = d.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("removedAt").isNull()).alias("active"), F.count_if(F.col("removedAt").isNull() & (has("mobileNumber") | has("personalEmail"))).alias("contact"))
    link = _links(spark, folder).agg(F.count(F.lit(1)).alias("pairs"), F.count_if("is_current").alias("current_pairs"), F.count_if("is_primary").alias("primary_pairs"), F.count_if("is_licensed").alias("licensed_pairs"))
    long = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in df.columns])).alias("x")).select("x.*")
    return long(people).union(long(link))


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """[F26, K2] People in each shard."""
    return once(table(spark, folder, "doctor"), "id").groupBy(shard(F.col("id")).alias("shard")).agg(F.count(F.lit(1)).alias("profiles"))


def printed_keys(spark: SparkSession, folder: str) -> DataFrame:
    d = once(table(spark, folder, "doctor"), "id", "specialities")
    return d.select("id", F.explode(R.printed_facilities(F.col("specialities"))).alias("facility_key"))


def past_only(spark: SparkSession, folder: str) -> DataFrame:
    """[U2, P13] Facilities a person has only been at."""
    return _links(spark, folder).where("is_past").groupBy("doctor_id").agg(F.count(F.lit(1)).alias("past_facilities"), F.min("facility_id").alias("first_id"))


def _kinds(spark: SparkSession, folder: str) -> DataFrame:
    people = R.active(table(spark, folder, "doctor")).select(F.col("id").alias("doctor_id"), R.specialty(squeezed("speciality")).alias("specialty")).distinct()
    f = once(table(spark, folder, "facility"), "id", "nameTrimmed", "typeGuess").select(F.col("id").alias("facility_id"), F.col("nameTrimmed").alias("name"), F.col("typeGuess").alias("guess"))
    return classify.facility_types(f, classify.staff_tally(_links(spark, folder), people))


def facility_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """[A10, C1]"""
    return _kinds(spark, folder)


def kind_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """[A11]"""
    return classify.type_statistics(_kinds(spark, folder))


def quality_checks(spark: SparkSession, folder: str) -> DataFrame:
    """[V1-V42] What the builders make of these tables (the directory's people, classified facilities, links, totals), checked against the tables."""
    from ledgerline.operators import directory

    source = {t: table(spark, folder, t) for t in ("doctor", "facility", "doctor_facility", "doctor_licence_type")}
    link = written(_links(spark, folder), "links")
    people = written(directory.professionals(source["doctor"], source["doctor_facility"], source["facility"], source["doctor_licence_type"]).select("id", "specialty"), "people")
    profiles = R.active(source["doctor"]).distinct().select("id", F.size(R.experience(F.col("experience"))).alias("work"), F.size(R.education(F.col("education"))).alias("education"))
    kinds = written(_kinds(spark, folder), "kinds")
    licences = written(R.licence_names(source["doctor"], source["doctor_licence_type"]), "licences")
    f = kinds.join(once(source["facility"], "id", "nameTrimmed").select(F.col("id").alias("facility_id"), F.col("nameTrimmed").alias("facility")), "facility_id")
    facets = R.static_facets(source["doctor"], source["doctor_licence_type"], link, f)
    return quality.checks(people, kinds, link, R.facility_counts(link), licences, facets, profiles, source | {"doctor_facility": source["doctor_facility"].distinct()}, totals(spark, folder))


_SQUEEZE = "trim(regexp_replace(speciality, '\\s+', ' ', 'g'))"
_SPLIT = f"""SELECT DISTINCT id, {_SQUEEZE} AS s,
 CASE WHEN strpos({_SQUEEZE}, '-') > 1 THEN trim(split_part({_SQUEEZE}, '-', 1)) ELSE {_SQUEEZE} END AS category,
 CASE WHEN strpos({_SQUEEZE}, '-') > 1 THEN nullif(trim(substr({_SQUEEZE}, strpos({_SQUEEZE}, '-') + 1)), '') END AS specialty FROM doctor"""
_KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_PRINTED = f"""SELECT DISTINCT id, {_KEY.format("trim(regexp_replace(regexp_replace(trim(split_part(e, ' · ', 2)), '(?i)\\s+and\\s+[0-9]+\\s+others?\\b.*$', ''), '(?i)\\s*Show All\\s*$', ''))")} AS facility_key
 FROM (SELECT id, unnest(string_split(specialities, ' | ')) AS e FROM (SELECT DISTINCT id, specialities FROM doctor WHERE specialities IS NOT NULL)) WHERE contains(e, ' · ')"""
_LINKS = f"""WITH sp AS ({_SPLIT}), pr AS ({_PRINTED}), dd AS (SELECT DISTINCT id FROM doctor WHERE removedAt IS NULL),
g AS (SELECT doctorId AS doctor_id, facilityId AS facility_id,
 bool_or(coalesce(isCurrent = 1 OR relationType IN ('current_license', 'search_stage'), false)) AS is_current,
 bool_or(coalesce(relationType = 'search_stage', false)) AS is_primary,
 bool_or(coalesce(relationType = 'current_license' AND statusLabel = 'Active License', false)) AS licence,
 bool_or(coalesce(relationType = 'employment_history' AND isCurrent = 1, false)) AS present,
 list_sort(list(DISTINCT nullif(trim(regexp_replace(title, '\\s+', ' ', 'g')), '')) FILTER (WHERE relationType = 'current_license' AND statusLabel = 'Active License' AND nullif(trim(title), '') IS NOT NULL)) AS titles
 FROM doctor_facility WHERE facilityId IS NOT NULL GROUP BY 1, 2),
l AS (SELECT g.doctor_id, g.facility_id, is_current, NOT is_current AS is_past, is_primary,
 licence AND (is_primary OR present OR EXISTS (SELECT 1 FROM pr WHERE pr.id = g.doctor_id AND pr.facility_key = {_KEY.format("f.nameTrimmed")})) AS is_licensed,
 CASE WHEN len(titles) = 1 AND titles[1] = coalesce(sp.specialty, '') THEN '' ELSE coalesce(array_to_string(titles, '||'), '') END AS roles
 FROM g JOIN dd ON dd.id = g.doctor_id JOIN (SELECT DISTINCT id, nameTrimmed FROM facility) f ON f.id = g.facility_id JOIN sp ON sp.id = g.doctor_id)
"""
_COUNTS = "SELECT facility_id, count(*) AS all_count, count(*) FILTER (WHERE is_current) AS doctor_count, count(*) FILTER (WHERE is_primary) AS primary_count, count(*) FILTER (WHERE is_licensed) AS licensed_count FROM l GROUP BY 1"
_LICENCES = """WITH m AS (SELECT doctorId AS id, list_sort(list(DISTINCT nullif(trim(licenceType), ''))) AS members FROM doctor_licence_type GROUP BY 1),
t AS (SELECT DISTINCT d.id, CASE WHEN len(m.members) > 0 THEN array_to_string(m.members, '|') ELSE coalesce(CASE trim(d.licenseType) WHEN 'FTL' THEN 'Full-time License' WHEN 'PTL' THEN 'Part-time License' WHEN 'REG' THEN 'Registered' WHEN 'TRL' THEN 'Trainee License' ELSE nullif(trim(d.licenseType), '') END, '') END AS licence_types
FROM doctor d LEFT JOIN m ON m.id = d.id WHERE d.removedAt IS NULL)
"""
_ENTRIES = "list_filter(list_transform(string_split(coalesce({}, ''), '|'), lambda x: trim(x)), lambda x: x <> '')"

_RULES = " ".join(f"WHEN regexp_matches(w, '(^| )({p})( |$)') THEN '{t}'" for t, p in classify.NAME_RULES)
_WORDS = "string_split(regexp_replace(trim(regexp_replace(strip_accents(lower(coalesce(nameTrimmed, ''))), '[^a-z0-9]+', ' ', 'g')), '\\b([a-z]) ([a-z]) ([a-z])\\b', '\\1\\2\\3', 'g'), ' ')"
_UNIFIED = "list_transform(" + _WORDS + ", lambda x: CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in FACILITY_SPELLINGS.items()) + " ELSE x END)"
_TELLING = f"list_filter({_UNIFIED}, lambda x: NOT list_contains([" + ", ".join(f"'{w}'" for w in COMPANY_WORDS) + "], x))"
_SHARES = " ".join(f"WHEN coalesce(sum(cnt) FILTER (WHERE regexp_matches(specialty, '(?i){p}')), 0) / sum(cnt) >= {share} THEN '{t}'" for t, share, p in classify.STAFF_RULES)
_DAYS = "[" + ", ".join(f"'{d}'" for d in R.DAYS) + "]"
_HOUR = "CASE WHEN CAST({h} AS INTEGER) IN (0, 24) THEN '12 AM' WHEN CAST({h} AS INTEGER) = 12 THEN '12 PM' WHEN CAST({h} AS INTEGER) > 12 THEN (CAST({h} AS INTEGER) - 12) || ' PM' ELSE CAST({h} AS INTEGER) || ' AM' END"
_EDU = f"SELECT id, unnest({_ENTRIES.format('education')}) AS e FROM (SELECT DISTINCT id, trim(regexp_replace(education, '\\s+', ' ', 'g')) AS education FROM doctor)"
_PARTS = "list_filter(list_transform(string_split({e}, '·'), lambda x: trim(x)), lambda x: x <> '')"
_JS = lambda p: p.replace("(?<![A-Za-z0-9_])", "\\b").replace("(?![A-Za-z0-9_])", "\\b")
_EDUCATION = f"""WITH e AS ({_EDU}), q AS (SELECT id, list_filter({_PARTS.format(e='e')}, lambda p: NOT regexp_matches(p, '{R._GRADUATED}')) AS r, list_filter({_PARTS.format(e='e')}, lambda p: regexp_matches(p, '{R._GRADUATED}')) AS g FROM e),
k AS (SELECT id, r, len(r) AS n, regexp_extract(g[len(g)], '{R._GRADUATED}', 1) AS graduated, regexp_matches(r[1], '{_JS(R._INSTITUTION)}') AND NOT regexp_matches(r[1], '{R._LEVEL}') AS school FROM q)
"""

QUERIES = {
    f"register_{f.__name__}": f
    for f in (links, facility_counts, top_specialties, licence_names, category_split, static_facets, slug_ordinals, lifecycle, unique_facility_names, profile_totals, education_years, opening_hours, type_rollup, totals, shards, printed_keys, past_only, facility_kinds, kind_statistics, quality_checks)
}
_KINDS = _LINKS + f""", fw AS (SELECT DISTINCT id AS facility_id, lower(typeGuess) AS g, array_to_string(CASE WHEN len({_TELLING}) > 0 THEN {_TELLING} ELSE {_UNIFIED} END, ' ') AS w FROM facility),
ta AS (SELECT facility_id, specialty, count(*) AS cnt FROM l JOIN sp ON sp.id = l.doctor_id WHERE is_current AND specialty IS NOT NULL GROUP BY 1, 2), st AS (SELECT facility_id, CASE {_SHARES} ELSE 'center' END AS s FROM ta GROUP BY 1),
kd AS (SELECT fw.facility_id, CASE {_RULES} END AS n, CASE WHEN g IN ({", ".join(f"'{x}'" for x in classify.GUESSES)}) THEN g END AS g, s FROM fw LEFT JOIN st USING (facility_id)),
kinds AS (SELECT facility_id, coalesce(n, g, s, 'other') AS type, CASE WHEN n IS NOT NULL THEN 'name' WHEN g IS NOT NULL THEN 'dha_type' WHEN s IS NOT NULL THEN 'staff' ELSE 'unclassified' END AS type_source FROM kd)
"""
SQL = {
    "register_facility_kinds": _KINDS + "SELECT * FROM kinds",
    "register_kind_statistics": _KINDS + "SELECT type, type_source, count(*) AS facilities FROM kinds GROUP BY GROUPING SETS ((type), (type_source))",
    "register_education_years": _EDUCATION + "SELECT institution, graduated, count(*) AS cnt FROM (SELECT CASE WHEN n > 2 THEN r[2] WHEN school THEN r[1] END AS institution, graduated FROM k) WHERE graduated <> '' GROUP BY 1, 2",
    "register_opening_hours": f"WITH f AS (SELECT DISTINCT id, CAST(operatingHours AS JSON) AS j FROM facility WHERE json_valid(operatingHours)), d AS (SELECT id, day, json_extract(j, '$.' || day) AS o FROM f, (SELECT unnest({_DAYS}) AS day)), s AS (SELECT id, day, o, list_filter(list_transform(CAST(json_extract(o, '$.timeIntervals') AS JSON[]), lambda x: {_HOUR.format(h="json_extract_string(x, '$.StartDropDown')")} || ' – ' || {_HOUR.format(h="json_extract_string(x, '$.EndDropDown')")}), lambda x: x IS NOT NULL) AS spans FROM d), t AS (SELECT id, day, CASE WHEN lower(json_extract_string(o, '$.is24Hours')) = 'true' THEN '24 hours' WHEN lower(json_extract_string(o, '$.isClosed')) = 'true' THEN 'Closed' WHEN len(spans) > 0 THEN array_to_string(spans, ', ') END AS label FROM s) SELECT * FROM t WHERE label IS NOT NULL",
    "register_unique_facility_names": f"WITH w AS (SELECT id, {_ENTRIES.format('experience')} AS es FROM (SELECT DISTINCT id, trim(regexp_replace(experience, '\\s+', ' ', 'g')) AS experience FROM doctor)), x AS (SELECT id, unnest(range(len(es))) AS pos, unnest(es) AS e FROM w), y AS (SELECT id, pos, {_PARTS.format(e="regexp_replace(e, '" + R._PRESENT + "', '')")} AS ps FROM x), z AS (SELECT id, pos, list_filter(ps, lambda p: NOT regexp_matches(p, '{R._LICENCE}') AND NOT regexp_matches(p, '{R._DATES}')) AS r, len(list_filter(ps, lambda p: regexp_matches(p, '{R._LICENCE}'))) AS lic FROM y), u AS (SELECT lower(trim(nameTrimmed)) AS key, min(id) AS fid FROM (SELECT DISTINCT id, nameTrimmed FROM facility) GROUP BY 1 HAVING count(DISTINCT id) = 1) SELECT z.id AS doctor_id, CAST(pos AS INTEGER) AS pos, fid AS facility_id FROM z JOIN u ON u.key = lower(trim(CASE WHEN len(r) > 1 THEN r[2] END))",
    "register_links": _LINKS + "SELECT * FROM l",
    "register_facility_counts": _LINKS + f", c AS ({_COUNTS}), f AS (SELECT DISTINCT id AS facility_id, nameTrimmed FROM facility) SELECT f.facility_id, nameTrimmed, coalesce(all_count, 0) AS all_count, coalesce(doctor_count, 0) AS doctor_count, coalesce(primary_count, 0) AS primary_count, coalesce(licensed_count, 0) AS licensed_count, row_number() OVER (ORDER BY coalesce(all_count, 0) DESC, nameTrimmed, f.facility_id) AS facility_pos FROM f LEFT JOIN c USING (facility_id)",
    "register_top_specialties": _LINKS + "SELECT * FROM (SELECT facility_id, specialty, count(*) AS cnt, row_number() OVER (PARTITION BY facility_id ORDER BY count(*) DESC, specialty) AS rank FROM l JOIN sp ON sp.id = l.doctor_id WHERE is_current AND specialty IS NOT NULL GROUP BY 1, 2) WHERE rank <= 3",
    "register_licence_names": _LICENCES + "SELECT id, licence_types FROM t",
    "register_category_split": f"SELECT id, category, specialty FROM ({_SPLIT})",
    "register_static_facets": _LINKS + ", " + _LICENCES.replace("WITH m AS", "m AS") + f", fx AS (SELECT DISTINCT id, nameTrimmed, typeGuess FROM facility), a AS (SELECT DISTINCT id, nullif(trim(nationality), '') AS nationality FROM doctor WHERE removedAt IS NULL) SELECT facet, label, count(*) AS cnt FROM (SELECT 'category' AS facet, nullif(category, '') AS label FROM sp JOIN a USING (id) UNION ALL SELECT 'specialty', specialty FROM sp JOIN a USING (id) UNION ALL SELECT 'nationality', nationality FROM a UNION ALL SELECT 'language', unnest(list_distinct(list_filter(list_transform(string_split(trim(regexp_replace(languages, '\\s+', ' ', 'g')), ','), lambda x: trim(x)), lambda x: x <> ''))) FROM (SELECT DISTINCT id, languages FROM doctor WHERE removedAt IS NULL) UNION ALL SELECT 'facility', nameTrimmed FROM l JOIN fx ON fx.id = l.facility_id WHERE is_current UNION ALL SELECT 'facility_type', typeGuess FROM (SELECT DISTINCT doctor_id, typeGuess FROM l JOIN fx ON fx.id = l.facility_id WHERE is_current) UNION ALL SELECT 'licence', unnest(string_split(licence_types, '|')) FROM t WHERE licence_types <> '') WHERE label IS NOT NULL GROUP BY 1, 2",
    "register_slug_ordinals": "WITH s AS (SELECT id, trim(regexp_replace(strip_accents(lower(regexp_extract(name, '^\\s*(\\S+)', 1))), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM (SELECT DISTINCT id, name FROM doctor WHERE name IS NOT NULL)) SELECT id, CASE WHEN row_number() OVER (PARTITION BY s ORDER BY id) = 1 THEN s ELSE s || '-' || row_number() OVER (PARTITION BY s ORDER BY id) END AS slug FROM s",
    "register_lifecycle": "SELECT 'placements of active people' AS what, count(*) AS n FROM (SELECT DISTINCT * FROM doctor_facility) WHERE doctorId IN (SELECT id FROM doctor WHERE removedAt IS NULL) UNION ALL SELECT 'active people without placement', count(*) FROM (SELECT DISTINCT id FROM doctor WHERE removedAt IS NULL AND id NOT IN (SELECT doctorId FROM doctor_facility WHERE doctorId IS NOT NULL))",
    "register_profile_totals": f"SELECT sum(w) AS work_entries, sum(e) AS education_entries, count(*) FILTER (WHERE w > 0) AS with_work, count(*) FILTER (WHERE e > 0) AS with_education FROM (SELECT len({_ENTRIES.format('experience')}) AS w, len({_ENTRIES.format('education')}) AS e FROM (SELECT DISTINCT id, experience, education FROM doctor))",
    "register_type_rollup": _LINKS + ", f AS (SELECT DISTINCT id AS facility_id, typeGuess AS type FROM facility), p AS (SELECT type, count(DISTINCT doctor_id) AS professionals FROM l JOIN f USING (facility_id) WHERE is_current GROUP BY 1) SELECT a.type, a.facilities, coalesce(p.professionals, 0) AS professionals FROM (SELECT type, count(*) AS facilities FROM f GROUP BY 1) a LEFT JOIN p ON p.type = a.type",
    "register_totals": _LINKS + ", d AS (SELECT DISTINCT id, removedAt, mobileNumber, personalEmail FROM doctor) SELECT unnest(['all', 'active', 'contact']) AS what, unnest([count(*), count(*) FILTER (WHERE removedAt IS NULL), count(*) FILTER (WHERE removedAt IS NULL AND (trim(mobileNumber) <> '' OR trim(personalEmail) <> ''))]) AS n FROM d UNION ALL SELECT unnest(['pairs', 'current_pairs', 'primary_pairs', 'licensed_pairs']), unnest([count(*), count(*) FILTER (WHERE is_current), count(*) FILTER (WHERE is_primary), count(*) FILTER (WHERE is_licensed)]) FROM l",
    "register_shards": "SELECT lpad(right(id, 3), 3, '0') AS shard, count(*) AS profiles FROM (SELECT DISTINCT id FROM doctor) GROUP BY 1",
    "register_printed_keys": f"SELECT * FROM ({_PRINTED}) WHERE facility_key <> ''",
    "register_past_only": _LINKS + "SELECT doctor_id, count(*) AS past_facilities, min(facility_id) AS first_id FROM l WHERE is_past GROUP BY 1",
}
