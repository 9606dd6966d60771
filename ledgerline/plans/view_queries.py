"""Queries over what is shown of the directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.text import squeezed
from ledgerline.operators import directory as D
from ledgerline.operators import register as R
from ledgerline.operators import views as V
from ledgerline.plans.directory_queries import _FIRST, _FOLD, _PEOPLE, facets_all, people
from ledgerline.plans.register_queries import _COUNTS, _ENTRIES, _links
from ledgerline.sources.tables import once, table

HOSPITALS = D.DirectoryQuery(q="hospital", mode="facilities")
HOSPITALS_INDIA = D.DirectoryQuery(q="hospital", mode="facilities", sort="name-asc", chosen={"nationality": ("India",), "facility_type": ("hospital", "clinic")})
OF_INDIA = D.DirectoryQuery(sort="name-desc", chosen={"nationality": ("India",)})


def _facilities(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "facility"), "nameTrimmed", "typeGuess").select(F.col("nameTrimmed").alias("facility"), F.col("typeGuess").alias("type"))


def facilities_by_text(spark: SparkSession, folder: str) -> DataFrame:
    return V.facility_list(people(spark, folder), _facilities(spark, folder), HOSPITALS)


def facilities_by_text_and_people(spark: SparkSession, folder: str) -> DataFrame:
    return V.facility_list(people(spark, folder), _facilities(spark, folder), HOSPITALS_INDIA)


def facilities_of_people(spark: SparkSession, folder: str) -> DataFrame:
    return V.facility_list(people(spark, folder), _facilities(spark, folder), OF_INDIA)


def facilities_staffed(spark: SparkSession, folder: str) -> DataFrame:
    """The first 60 of the unfiltered list, for a selection box [O6, O13]."""
    return V.facility_list(people(spark, folder), _facilities(spark, folder), D.DirectoryQuery()).limit(60)


def options_of_specialty(spark: SparkSession, folder: str) -> DataFrame:
    """Options that have "med" in what is shown, one of them selected."""
    return V.filter_options(facets_all(spark, folder), "specialty", selected=("General Practitioner", "No such specialty"), search="med")


def options_of_nationality(spark: SparkSession, folder: str) -> DataFrame:
    return V.filter_options(facets_all(spark, folder), "nationality", selected=("Egypt",))


def facet_order(spark: SparkSession, folder: str) -> DataFrame:
    """[O9] The first 20 labels of each static facet, most frequent first."""
    from pyspark.sql.window import Window

    counts = R.static_facets(table(spark, folder, "doctor"), table(spark, folder, "doctor_licence_type"))
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("cnt"), "label"))
    return counts.withColumn("place", place).where("place <= 20")


def explorer(spark: SparkSession, folder: str) -> DataFrame:
    """[O13, W4] Eighteen specialties in three columns."""
    counts = R.static_facets(table(spark, folder, "doctor"), table(spark, folder, "doctor_licence_type")).where("facet = 'specialty'").select("label", "cnt")
    return V.in_columns(V.ranked_top(counts, [F.desc("cnt"), F.asc("label")], 18), 3, 18)


def featured_facilities(spark: SparkSession, folder: str) -> DataFrame:
    """[O11] Six facilities with the most licensed people."""
    counts = R.facility_counts(_links(spark, folder)).select("facility_id", "licensed_count")
    return V.ranked_top(counts, [F.desc("licensed_count"), F.asc("facility_id")], 6)


def network(spark: SparkSession, folder: str) -> DataFrame:
    """[O12, O26, A9] Seven kinds of facilities that have people, most people first."""
    f = once(table(spark, folder, "facility"), "id", "typeGuess").select(F.col("id").alias("facility_id"), F.col("typeGuess").alias("type"))
    per = _links(spark, folder).where("is_current").join(f, "facility_id").where("type IS NOT NULL").groupBy("type").agg(F.count_distinct("doctor_id").alias("people"))
    return V.ranked_top(per, [F.desc("people"), F.asc("type")], 7).withColumn("label", V.type_label(F.col("type")))


def person_cards(spark: SparkSession, folder: str) -> DataFrame:
    return V.person_cards(people(spark, folder)).drop("name")


def facility_cards(spark: SparkSession, folder: str) -> DataFrame:
    f = once(table(spark, folder, "facility"), "id", "nameTrimmed", "typeGuess", "telephone", "website")
    f = f.select(F.col("id").alias("facility_id"), F.col("nameTrimmed").alias("name"), F.col("typeGuess").alias("type"), "telephone", "website")
    link = _links(spark, folder)
    return V.facility_cards(f, R.facility_counts(link), R.top_specialties(link, table(spark, folder, "doctor")))


def relations(spark: SparkSession, folder: str) -> DataFrame:
    f = once(table(spark, folder, "facility"), "id", "nameTrimmed", "typeGuess").select(F.col("id").alias("facility_id"), F.col("nameTrimmed").alias("name"), F.col("typeGuess").alias("type"))
    own = R.active(table(spark, folder, "doctor")).select(F.col("id").alias("doctor_id"), R.specialty(squeezed("speciality")).alias("specialty")).distinct()
    link = _links(spark, folder)
    return V.relations(link, own, f, R.facility_counts(link)).drop("place")


def licence_cards(spark: SparkSession, folder: str) -> DataFrame:
    return V.licence_cards(*[table(spark, folder, t) for t in ("doctor", "doctor_facility", "facility")]).drop("at")


def rosters(spark: SparkSession, folder: str) -> DataFrame:
    """[J5] Every facility with its roster; the day it was last seen."""
    f = once(table(spark, folder, "facility"), "id").select(F.col("id").alias("facility_id"))
    out = f.join(V.rosters(table(spark, folder, "doctor_facility")), "facility_id", "left")
    return out.select("facility_id", F.coalesce("people", F.lit(0)).alias("people"), F.date_format("seen", "yyyy-MM-dd").alias("seen"))


def contacts(spark: SparkSession, folder: str) -> DataFrame:
    d = once(table(spark, folder, "doctor"), "id", "mobileNumber", "mobileNumber2", "personalEmail", "linkedIn", "extraFields")
    rows = V.contact_channels(*[F.col(c) for c in ("mobileNumber", "mobileNumber2", "personalEmail", "linkedIn", "extraFields")])
    return d.select("id", F.explode(rows).alias("x")).select("id", "x.kind", "x.value", "x.href")


def facility_contacts(spark: SparkSession, folder: str) -> DataFrame:
    f = once(table(spark, folder, "facility"), "id", "telephone", "website", "dhaArea")
    rows = V.facility_contacts(F.col("telephone"), F.lit(None).cast("string"), F.col("website"), F.col("dhaArea"))
    return f.select("id", F.explode(rows).alias("x")).select("id", "x.kind", "x.value", "x.href")


def coordinates(spark: SparkSession, folder: str) -> DataFrame:
    f = once(table(spark, folder, "facility"), "id", "latitude", "longitude").select("id", V.coordinates(F.col("latitude"), F.col("longitude")).alias("c"))
    return f.where("c IS NOT NULL").select("id", F.round("c.west", 6).alias("west"), F.round("c.south", 6).alias("south"), F.round("c.east", 6).alias("east"), F.round("c.north", 6).alias("north"))


def add_ons(spark: SparkSession, folder: str) -> DataFrame:
    f = once(table(spark, folder, "facility"), "id", "addOns")
    return f.select("id", F.explode(V.add_on_names(F.lit(None).cast("string"), F.col("addOns"))).alias("name"))


def sections(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles are at hand for the people whose number is even."""
    d = R.active(table(spark, folder, "doctor")).select("id", "experience", "education").distinct()
    has = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    flags = d.select("id", has("experience").alias("has_experience"), has("education").alias("has_education"))
    loaded = d.where(F.right("id", F.lit(1)).isin("0", "2", "4", "6", "8")).select("id", F.size(R.experience(F.col("experience"))).alias("work"), F.size(R.education(F.col("education"))).alias("education"))
    return V.profile_sections(flags, loaded)


def profile_index(spark: SparkSession, folder: str) -> DataFrame:
    d = once(table(spark, folder, "doctor"), "id", "experience", "education")
    return V.profile_index(d.select("id", F.size(R.experience(F.col("experience"))).alias("work"), F.size(R.education(F.col("education"))).alias("education")))


def export_statistics(spark: SparkSession, folder: str) -> DataFrame:
    licences = R.licence_names(table(spark, folder, "doctor"), table(spark, folder, "doctor_licence_type"))
    return V.export_statistics(_links(spark, folder), licences, R.active(table(spark, folder, "doctor")).distinct())


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """[F4, F5, F31, J21] Kinds and specialties as shown, with their address."""
    kinds = once(table(spark, folder, "facility"), "typeGuess").select(F.lit("type").alias("what"), F.coalesce("typeGuess", F.lit("")).alias("value"), V.type_label(F.col("typeGuess")).alias("shown"), F.lit(None).cast("string").alias("route")).distinct()
    own = R.active(table(spark, folder, "doctor")).select(R.specialty(squeezed("speciality")).alias("value")).where("value IS NOT NULL").distinct()
    return kinds.union(own.select(F.lit("specialty"), "value", V.specialty_label(F.col("value")), V.specialty_route(F.col("value"))))


_TYPE = "coalesce(CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.TYPE_LABELS.items()) + " END, nullif({c}, ''), 'Other healthcare provider')"
_GLOSS = "CASE " + " ".join(f"WHEN contains(lower({{c}}), '{p}') THEN CASE WHEN contains({{c}}, ' - {g}') THEN {{c}} ELSE {{c}} || ' - {g}' END" for p, g in V.GLOSSES) + " ELSE {c} END"
_FAC = ", fa AS (SELECT DISTINCT nameTrimmed AS facility, typeGuess AS type FROM facility WHERE nameTrimmed IS NOT NULL), every AS (SELECT u AS facility, count(*) AS doctor_count FROM (SELECT unnest(linked) AS u FROM p) GROUP BY 1)"
_HIT = f"contains({_FOLD.format('facility')} || ' ' || {_FOLD.format(_TYPE.format(c='type'))}, 'hospital')"
_HITS = f", h AS (SELECT * FROM fa WHERE {_HIT})"


def _list(at: str, where: str) -> str:
    """Facilities with the people of `at` (id, linked), under a condition."""
    return f", per AS (SELECT u AS facility, count(*) AS matching FROM (SELECT unnest(linked) AS u FROM ({at})) GROUP BY 1) SELECT fa.facility, fa.type, coalesce(doctor_count, 0) AS doctor_count, matching FROM fa LEFT JOIN every USING (facility) LEFT JOIN per USING (facility) WHERE {where}"


_AT_HIT = "len(list_intersect(linked, (SELECT list(facility) FROM h))) > 0"
_PEOPLE2 = _PEOPLE.replace("per AS (", "pf AS (").replace("LEFT JOIN per ON per.id", "LEFT JOIN pf ON pf.id").replace("coalesce(per.", "coalesce(pf.")
_FACETS = "SELECT {e} AS label, count(*) AS cnt FROM p WHERE {e} IS NOT NULL GROUP BY 1"


def _options(column: str, shown: str, selected: list[str], search: str) -> str:
    picked = "(" + ", ".join(f"'{s}'" for s in selected) + ")"
    text = _FOLD.format("shown")
    rank = f"CASE WHEN shown <> label AND contains({_FOLD.format('substr(shown, len(label) + 1)')}, '{search}') THEN -2 WHEN starts_with({text}, '{search}') OR contains({text}, ' {search}') THEN -1 ELSE 0 END" if search else "0"
    all_ = f"SELECT label, cnt FROM ({_FACETS.format(e=column)}) UNION ALL SELECT * FROM (SELECT unnest([{', '.join(repr(s) for s in selected)}]) AS label, 0 AS cnt) WHERE label NOT IN (SELECT {column} FROM p WHERE {column} IS NOT NULL)"
    return _PEOPLE + f", o AS (SELECT label, {shown.format(c='label')} AS shown, cnt, label IN {picked} AS pinned FROM ({all_})), r AS (SELECT *, {rank} AS rank FROM o WHERE contains({text}, '{search}')), k AS (SELECT *, row_number() OVER (PARTITION BY pinned ORDER BY rank, cnt DESC, shown COLLATE NOCASE, label) AS n FROM r) SELECT label, shown, cnt, pinned, row_number() OVER (ORDER BY pinned DESC, rank, cnt DESC, shown COLLATE NOCASE, label) AS place FROM k WHERE pinned OR n <= 8"


_SCALARS = _PEOPLE + ", s AS (SELECT 'category' AS facet, category AS label FROM p UNION ALL SELECT 'specialty', specialty FROM p UNION ALL SELECT 'nationality', nationality FROM p UNION ALL SELECT 'language', unnest(languages) FROM p UNION ALL SELECT 'licence', unnest(string_split(nullif(licence_types, ''), '|')) FROM p), c AS (SELECT facet, label, count(*) AS cnt FROM s WHERE label IS NOT NULL GROUP BY 1, 2)"
_TEL = "'tel:' || regexp_replace({c}, '[^0-9+]', '', 'g')"
_BLANK = "nullif(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '')"
_X = "CASE WHEN json_valid(extraFields) THEN nullif(trim(json_extract_string(extraFields, '$.{k}')), '') END"
_TITLE = _BLANK.format(c="regexp_replace(split_part(coalesce(sourceText, ''), ' · ', 1), '(?i)[ ]+(Active|Inactive)(,[^·]*)?$', '')")
_BADGES = "array_to_string(list_filter([CASE WHEN is_primary THEN 'Primary registration' END, CASE WHEN is_licensed THEN 'Active licence here' END, CASE WHEN NOT is_primary AND NOT is_licensed THEN 'Linked facility' END], lambda x: x IS NOT NULL), ', ')"
_N = _ENTRIES

QUERIES = {
    f"view_{f.__name__}": f
    for f in (facilities_by_text, facilities_by_text_and_people, facilities_of_people, facilities_staffed, options_of_specialty, options_of_nationality, facet_order, explorer, featured_facilities, network, person_cards, facility_cards, relations, licence_cards, rosters, contacts, facility_contacts, coordinates, add_ons, sections, profile_index, export_statistics, labels)
}
SQL = {
    "view_facilities_by_text": _PEOPLE2 + _FAC + _HITS + _list(f"SELECT * FROM p WHERE {_AT_HIT}", _HIT.replace("facility", "fa.facility").replace("type", "fa.type")),
    "view_facilities_by_text_and_people": _PEOPLE2 + _FAC + _HITS + _list(f"SELECT * FROM p WHERE {_AT_HIT} AND nationality = 'India' AND list_has_any(types, ['hospital', 'clinic'])", _HIT.replace("facility", "fa.facility").replace("type", "fa.type") + " AND matching IS NOT NULL AND fa.type IN ('hospital', 'clinic')"),
    "view_facilities_of_people": _PEOPLE2 + _FAC + _list("SELECT * FROM p WHERE nationality = 'India'", "matching IS NOT NULL"),
    "view_facilities_staffed": _PEOPLE2 + _FAC + _list("SELECT * FROM p", "doctor_count > 0") + " ORDER BY doctor_count DESC, lower(fa.facility), fa.facility LIMIT 60",
    "view_options_of_specialty": _options("specialty", _GLOSS, ["General Practitioner", "No such specialty"], "med"),
    "view_options_of_nationality": _options("nationality", "{c}", ["Egypt"], ""),
    "view_facet_order": _SCALARS + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY cnt DESC, label) AS place FROM c) WHERE place <= 20",
    "view_explorer": _SCALARS + ", tt AS (SELECT label, cnt, row_number() OVER (ORDER BY cnt DESC, label) AS place FROM c WHERE facet = 'specialty') SELECT *, CAST((place - 1) // 6 AS INTEGER) AS col, CAST((place - 1) % 6 AS INTEGER) AS row FROM tt WHERE place <= 18",
    "view_featured_facilities": _PEOPLE + "SELECT * FROM (SELECT facility_id, count(*) FILTER (WHERE is_licensed) AS licensed_count, row_number() OVER (ORDER BY count(*) FILTER (WHERE is_licensed) DESC, facility_id) AS place FROM l GROUP BY 1) WHERE place <= 6",
    "view_network": _PEOPLE + f"SELECT type, people, place, {_TYPE.format(c='type')} AS label FROM (SELECT type, count(DISTINCT doctor_id) AS people, row_number() OVER (ORDER BY count(DISTINCT doctor_id) DESC, type) AS place FROM l JOIN fx USING (facility_id) WHERE is_current AND type IS NOT NULL GROUP BY 1) WHERE place <= 7",
    "view_facility_cards": _PEOPLE + f", c AS ({_COUNTS}), w AS (SELECT facility_id, specialty, row_number() OVER (PARTITION BY facility_id ORDER BY count(*) DESC, specialty) AS k FROM l JOIN sp ON sp.id = l.doctor_id WHERE is_current AND specialty IS NOT NULL GROUP BY 1, 2), t3 AS (SELECT facility_id, string_agg(specialty, ' · ' ORDER BY k) AS specialties FROM w WHERE k <= 3 GROUP BY 1), f AS (SELECT DISTINCT id AS facility_id, nameTrimmed AS name, typeGuess AS type, {_BLANK.format(c='telephone')} AS tel, {_BLANK.format(c='website')} AS web FROM facility) SELECT f.facility_id, f.name, {_TYPE.format(c='f.type')} AS type, coalesce(licensed_count, doctor_count, 0) AS people, specialties, concat_ws(' ', {_TEL.format(c='tel')}, CASE WHEN regexp_matches(web, '(?i)^https?://') THEN web ELSE 'https://' || web END) AS links FROM f LEFT JOIN c USING (facility_id) LEFT JOIN t3 USING (facility_id)",
    "view_relations": _PEOPLE + f", c AS ({_COUNTS}), f AS (SELECT DISTINCT id AS facility_id, nameTrimmed AS name, typeGuess AS type FROM facility) SELECT l.doctor_id, l.facility_id, f.name, {_TYPE.format(c='f.type')} AS type, {_BADGES} AS badges, array_to_string(list_transform(CASE WHEN roles <> '' THEN string_split(roles, '||') WHEN sp.specialty IS NOT NULL THEN [sp.specialty] ELSE [] END, lambda x: {_GLOSS.format(c='x')}), ', ') AS roles, coalesce(licensed_count, doctor_count, 0) AS people FROM l JOIN f USING (facility_id) LEFT JOIN c USING (facility_id) JOIN sp ON sp.id = l.doctor_id WHERE is_current AND trim(f.name) <> ''",
    "view_licence_cards": f"WITH x AS (SELECT DISTINCT * FROM doctor_facility WHERE relationType = 'current_license' AND doctorId IN (SELECT id FROM doctor WHERE removedAt IS NULL)), f AS (SELECT DISTINCT id, nameTrimmed FROM facility) SELECT doctorId AS doctor_id, {_TITLE} AS title, f.nameTrimmed AS facility, nullif(licenseNumber, '') AS number, nullif(statusLabel, '') AS status FROM x JOIN f ON f.id = x.facilityId",
    "view_rosters": "SELECT f.facility_id, coalesce(r.people, 0) AS people, r.seen FROM (SELECT DISTINCT id AS facility_id FROM facility) f LEFT JOIN (SELECT facilityId, count(DISTINCT doctorId) AS people, strftime(timezone('UTC', max(updatedAt)), '%Y-%m-%d') AS seen FROM doctor_facility WHERE sourceSection = 'facility_roster' AND facilityId IS NOT NULL GROUP BY 1) r ON r.facilityId = f.facility_id",
    "view_contacts": f"WITH d AS (SELECT DISTINCT id, {_BLANK.format(c='mobileNumber')} AS a, coalesce({_BLANK.format(c='mobileNumber2')}, {_X.format(k='contact_details_office_number')}) AS b, {_BLANK.format(c='personalEmail')} AS m, coalesce({_X.format(k='secondary_email')}, {_X.format(k='contact_details_work_email')}) AS m2, {_BLANK.format(c='linkedIn')} AS i FROM doctor) SELECT id, 'phone' AS kind, a AS value, {_TEL.format(c='a')} AS href FROM d WHERE a IS NOT NULL UNION ALL SELECT id, 'phone2', b, {_TEL.format(c='b')} FROM d WHERE b IS NOT NULL UNION ALL SELECT id, 'email', m, 'mailto:' || m FROM d WHERE m IS NOT NULL UNION ALL SELECT id, 'email2', m2, 'mailto:' || m2 FROM d WHERE m2 IS NOT NULL AND lower(m2) <> lower(coalesce(m, '')) UNION ALL SELECT id, 'linkedin', i, i FROM d WHERE i IS NOT NULL",
    "view_facility_contacts": f"WITH f AS (SELECT DISTINCT id, {_BLANK.format(c='telephone')} AS t, {_BLANK.format(c='website')} AS w, {_BLANK.format(c='dhaArea')} AS a FROM facility) SELECT id, 'telephone' AS kind, t AS value, {_TEL.format(c='t')} AS href FROM f WHERE t IS NOT NULL UNION ALL SELECT id, 'website', w, CASE WHEN regexp_matches(w, '(?i)^https?://') THEN w ELSE 'https://' || w END FROM f WHERE w IS NOT NULL UNION ALL SELECT id, 'address', a, NULL FROM f WHERE a IS NOT NULL",
    "view_coordinates": "SELECT DISTINCT id, round(longitude - 0.004, 6) AS west, round(latitude - 0.004, 6) AS south, round(longitude + 0.004, 6) AS east, round(latitude + 0.004, 6) AS north FROM facility WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0)",
    "view_add_ons": "SELECT id, unnest(CAST(json(addOns) AS VARCHAR[])) AS name FROM (SELECT DISTINCT id, addOns FROM facility WHERE json_valid(addOns))",
    "view_sections": f"WITH d AS (SELECT DISTINCT id, experience, education FROM doctor WHERE removedAt IS NULL), n AS (SELECT id, right(id, 1) IN ('0', '2', '4', '6', '8') AS loaded, len({_N.format('experience')}) AS w, len({_N.format('education')}) AS e, coalesce(trim(experience) <> '', false) AS hw, coalesce(trim(education) <> '', false) AS he FROM d) SELECT id, 'experience' AS section, CASE WHEN loaded AND w > 0 THEN w || ' entries' WHEN NOT loaded AND hw THEN 'available' ELSE 'absent' END AS state FROM n UNION ALL SELECT id, 'education', CASE WHEN loaded AND e > 0 THEN e || ' entries' WHEN NOT loaded AND he THEN 'available' ELSE 'absent' END FROM n",
    "view_profile_index": f"SELECT 'last 3 characters of the id, filled with 0' AS shard_rule, count(DISTINCT lpad(right(id, 3), 3, '0')) AS shards, count(*) AS profiles, sum(w) AS work_entries, sum(e) AS education_entries, count(*) FILTER (WHERE w > 0) AS with_work, count(*) FILTER (WHERE e > 0) AS with_education FROM (SELECT id, len({_N.format('experience')}) AS w, len({_N.format('education')}) AS e FROM (SELECT DISTINCT id, experience, education FROM doctor))",
    "view_export_statistics": _PEOPLE + "SELECT (SELECT count(*) FROM l WHERE is_current) AS pairs, (SELECT max(n) FROM (SELECT count(*) AS n FROM l WHERE is_current GROUP BY doctor_id)) AS most_facilities, (SELECT count(*) FROM (SELECT 1 FROM l WHERE is_current GROUP BY doctor_id HAVING count(*) > 1)) AS at_several, (SELECT count(*) FROM t WHERE contains(licence_types, '|')) AS several_licences, 0 AS repeated_ids",
    "view_person_cards": _PEOPLE + _FIRST + f"SELECT p.id, category, {_GLOSS.format(c='specialty')} AS specialty, nationality, ff.first_facility || CASE WHEN len(linked) > 1 THEN ' +' || (len(linked) - 1) ELSE '' END AS facility, CASE WHEN len(languages) > 0 THEN array_to_string(languages[1:3], ' · ') || CASE WHEN len(languages) > 3 THEN ' +' || (len(languages) - 3) ELSE '' END END AS languages, CASE WHEN licence_types <> '' THEN 'verified' WHEN has_mobile OR has_email THEN 'contactable' END AS mark FROM p LEFT JOIN ff ON ff.id = p.id",
    "view_labels": _PEOPLE + f"SELECT DISTINCT 'type' AS what, coalesce(typeGuess, '') AS value, {_TYPE.format(c='typeGuess')} AS shown, CAST(NULL AS VARCHAR) AS route FROM facility UNION ALL SELECT DISTINCT 'specialty', specialty, {_GLOSS.format(c='specialty')}, '/?smode=professionals&spec=' || url_encode(specialty) FROM p WHERE specialty IS NOT NULL",
}
