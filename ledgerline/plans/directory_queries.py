"""Queries over the directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import directory as D
from ledgerline.operators import register as R
from ledgerline.plans.register_queries import _LICENCES, _LINKS, _SPLIT
from ledgerline.sources.tables import table

CHOSEN = D.DirectoryQuery(chosen={"nationality": ("India", "Egypt"), "licence": ("Full-time License",), "language": ("Arabic", "English")}, toggles=("has_email",))
TEXT = D.DirectoryQuery(q="consult card")
ONE = D.DirectoryQuery(q="robert", sort="relevance")


def people(spark: SparkSession, folder: str) -> DataFrame:
    return D.professionals(*[table(spark, folder, t) for t in ("doctor", "doctor_facility", "facility", "doctor_licence_type")])


def rows(spark: SparkSession, folder: str) -> DataFrame:
    lists = [F.array_join(c, "|").alias(c) for c in ("licence_types", "languages", "linked_facilities", "licensed_facilities", "facility_types")]
    return people(spark, folder).select("id", "category", "specialty", "nationality", "has_contact", "has_facility", "has_languages", *lists)


def facets_all(spark: SparkSession, folder: str) -> DataFrame:
    return D.facet_counts(people(spark, folder), D.DirectoryQuery())


def facets_self_excluding(spark: SparkSession, folder: str) -> DataFrame:
    return D.facet_counts(people(spark, folder), CHOSEN)


def toggles(spark: SparkSession, folder: str) -> DataFrame:
    return D.toggle_counts(people(spark, folder), D.DirectoryQuery(chosen={"nationality": ("India",)}))


def filtered(spark: SparkSession, folder: str) -> DataFrame:
    return D.matched(people(spark, folder), CHOSEN).select("id")


def searched(spark: SparkSession, folder: str) -> DataFrame:
    return D.matched(people(spark, folder), TEXT).select("id", "name")


def searched_by_id(spark: SparkSession, folder: str) -> DataFrame:
    return D.matched(people(spark, folder), D.DirectoryQuery(q="0007")).select("id")


def first_page_by_relevance(spark: SparkSession, folder: str) -> DataFrame:
    return D.page(people(spark, folder), ONE).select("id", "name")


def first_page_by_specialty(spark: SparkSession, folder: str) -> DataFrame:
    return D.page(people(spark, folder), D.DirectoryQuery(sort="specialty", page=2)).select("id", "specialty")


def first_page_by_facility(spark: SparkSession, folder: str) -> DataFrame:
    return D.page(people(spark, folder), D.DirectoryQuery(sort="facility")).select("id", "first_facility")


def facilities_matching(spark: SparkSession, folder: str) -> DataFrame:
    return D.facility_results(people(spark, folder), table(spark, folder, "facility"), D.DirectoryQuery(chosen={"nationality": ("India",)}))


def suggested(spark: SparkSession, folder: str) -> DataFrame:
    return D.suggestions(people(spark, folder), table(spark, folder, "facility"), "ra")


def facility_roles(spark: SparkSession, folder: str) -> DataFrame:
    link = R.links(table(spark, folder, "doctor"), table(spark, folder, "doctor_facility"), table(spark, folder, "facility"))
    return D.facility_roles(link, people(spark, folder))


def facility_people(spark: SparkSession, folder: str) -> DataFrame:
    link = R.links(table(spark, folder, "doctor"), table(spark, folder, "doctor_facility"), table(spark, folder, "facility"))
    return D.facility_people(link, people(spark, folder), "F-000001").select("id", F.array_join("roles", "||").alias("roles"))


_FOLD = "trim(regexp_replace(strip_accents(lower({})), '[^a-z0-9]+', ' ', 'g'))"
_PEOPLE = (
    _LINKS
    + ", "
    + _LICENCES.replace("WITH m AS", "m AS")
    + f""", fx AS (SELECT DISTINCT id AS facility_id, nameTrimmed AS facility, typeGuess AS type FROM facility),
per AS (SELECT doctor_id AS id, list_sort(list(DISTINCT facility)) AS linked, list_sort(list(DISTINCT facility) FILTER (WHERE is_licensed)) AS licensed, list_sort(list(DISTINCT type) FILTER (WHERE type IS NOT NULL)) AS types FROM l JOIN fx USING (facility_id) WHERE is_current GROUP BY 1),
dr AS (SELECT DISTINCT id, name, nationality, languages, mobileNumber, personalEmail, linkedIn, experience, education FROM doctor WHERE removedAt IS NULL),
lang AS (SELECT id, list_filter(list_transform(string_split(trim(regexp_replace(coalesce(languages, ''), '\\s+', ' ', 'g')), ','), lambda x: trim(x)), lambda x: x <> '') AS ls FROM dr),
ld AS (SELECT id, [ls[i] FOR i IN range(1, len(ls) + 1) IF list_position(ls, ls[i]) = i] AS languages FROM lang),
p AS (SELECT dr.id, dr.name, {_FOLD.format("coalesce(dr.name, '')")} AS name_folded, nullif(sp.category, '') AS category, sp.specialty, {_FOLD.format("coalesce(sp.category, '')")} AS category_folded, {_FOLD.format("coalesce(sp.specialty, '')")} AS specialty_folded,
 nullif(trim(dr.nationality), '') AS nationality, t.licence_types, ld.languages, coalesce(per.linked, []) AS linked, coalesce(per.licensed, []) AS licensed, coalesce(per.types, []) AS types,
 coalesce(trim(mobileNumber) <> '', false) AS has_mobile, coalesce(trim(personalEmail) <> '', false) AS has_email, coalesce(trim(linkedIn) <> '', false) AS has_linkedin, coalesce(trim(experience) <> '', false) AS has_experience, coalesce(trim(education) <> '', false) AS has_education
 FROM dr JOIN sp ON sp.id = dr.id JOIN t ON t.id = dr.id JOIN ld ON ld.id = dr.id LEFT JOIN per ON per.id = dr.id)
"""
)
_C = "coalesce(nationality IN ('India', 'Egypt'), false)"
_L = "list_contains(string_split(licence_types, '|'), 'Full-time License')"
_G = "list_has_any(languages, ['Arabic', 'English'])"
_LABELS = {"category": "category", "specialty": "specialty", "nationality": "nationality", "licence": "unnest(string_split(nullif(licence_types, ''), '|'))", "language": "unnest(languages)", "facility": "unnest(linked)", "facility_type": "unnest(types)"}


def _facets(where: dict[str, str]) -> str:
    parts = [f"SELECT '{f}' AS facet, {e} AS label FROM p WHERE {where.get(f, where['*'])}" for f, e in _LABELS.items()]
    return _PEOPLE + "SELECT facet, label, count(*) AS cnt FROM (" + " UNION ALL ".join(parts) + ") WHERE label IS NOT NULL GROUP BY 1, 2"


def _term(t: str) -> str:
    return f"(contains(name_folded, '{t}') OR contains(specialty_folded, '{t}') OR contains(category_folded, '{t}') OR EXISTS (SELECT 1 FROM (SELECT unnest(p.linked) AS u) WHERE contains({_FOLD.format('u')}, '{t}')))"


# A person's facility for sorting: the earliest placement, present ones first.
_FIRST = """, fst AS (SELECT doctorId AS doctor_id, facilityId AS facility_id, coalesce(min(createdAt) FILTER (WHERE isCurrent = 1 OR relationType IN ('current_license', 'search_stage')), min(createdAt)) AS first_at FROM doctor_facility GROUP BY 1, 2),
ff AS (SELECT l.doctor_id AS id, arg_min(facility, (first_at, facility_id)) AS first_facility FROM l JOIN fx USING (facility_id) JOIN fst USING (doctor_id, facility_id) WHERE is_current GROUP BY 1) """


def _suggested(kind: str, place: int, source: str, value: str, folded: str, n: int, q: str) -> str:
    late = f"CASE WHEN starts_with(f, '{q}') THEN 0 ELSE 1 END"
    return f"SELECT * FROM (SELECT '{kind}' AS kind, {place} AS place, {late} AS late, f, value FROM (SELECT DISTINCT {value} AS value, {folded} AS f FROM {source}) WHERE contains(f, '{q}') ORDER BY late, f, value LIMIT {n})"


_SUGGESTED = " UNION ALL ".join(
    _suggested(*x, "ra")
    for x in (("facility", 1, "facility", "nameTrimmed", _FOLD.format("nameTrimmed"), 4), ("specialty", 2, "p", "specialty", "specialty_folded", 3), ("category", 3, "p", "category", "category_folded", 1), ("professional", 4, "p", "name", "name_folded", 4))
)

QUERIES = {
    f"directory_{f.__name__}": f
    for f in (rows, facets_all, facets_self_excluding, toggles, filtered, searched, searched_by_id, first_page_by_relevance, first_page_by_specialty, first_page_by_facility, facilities_matching, suggested, facility_roles, facility_people)
}
SQL = {
    "directory_rows": _PEOPLE + "SELECT id, category, specialty, nationality, has_mobile OR has_email AS has_contact, len(linked) > 0 AS has_facility, len(languages) > 0 AS has_languages, licence_types, array_to_string(languages, '|') AS languages, array_to_string(linked, '|') AS linked_facilities, array_to_string(licensed, '|') AS licensed_facilities, array_to_string(types, '|') AS facility_types FROM p",
    "directory_facets_all": _facets({"*": "true"}),
    "directory_facets_self_excluding": _facets({"*": f"has_email AND {_C} AND {_L} AND {_G}", "nationality": f"has_email AND {_L} AND {_G}", "licence": f"has_email AND {_C} AND {_G}", "language": f"has_email AND {_C} AND {_L}"}),
    "directory_toggles": _PEOPLE + "SELECT count(*) AS matches, " + ", ".join(f"count(*) FILTER (WHERE {t}) AS {t}" for t in D.TOGGLES[:5]) + ", count(*) FILTER (WHERE len(linked) > 0) AS has_facility, count(*) FILTER (WHERE len(languages) > 0) AS has_languages, count(*) FILTER (WHERE has_mobile OR has_email) AS has_contact FROM p WHERE nationality = 'India'",
    "directory_filtered": _PEOPLE + f"SELECT id FROM p WHERE has_email AND {_C} AND {_L} AND {_G}",
    "directory_searched": _PEOPLE + f"SELECT id, name FROM p WHERE {_term('consult')} AND {_term('card')}",
    "directory_searched_by_id": _PEOPLE + f"SELECT id FROM p WHERE contains(id, '0007') OR {_term('0007')}",
    "directory_first_page_by_relevance": _PEOPLE + f"SELECT id, name FROM p WHERE {_term('robert')} ORDER BY CASE WHEN starts_with(name_folded, 'robert') THEN 0 WHEN contains(name_folded, 'robert') THEN 1 ELSE 2 END, name_folded, name NULLS LAST, id LIMIT 24",
    "directory_first_page_by_specialty": _PEOPLE + "SELECT id, specialty FROM p ORDER BY nullif(specialty_folded, '') NULLS LAST, name_folded, name NULLS LAST, id LIMIT 48",
    "directory_first_page_by_facility": _PEOPLE + _FIRST + f"SELECT p.id, first_facility FROM p LEFT JOIN ff USING (id) ORDER BY {_FOLD.format('first_facility')} NULLS LAST, name_folded, name NULLS LAST, p.id LIMIT 24",
    "directory_suggested": _PEOPLE + f"SELECT kind, value, rank FROM (SELECT kind, value, CAST(row_number() OVER (ORDER BY place, late, f, value) AS INTEGER) AS rank FROM ({_SUGGESTED})) WHERE rank <= 8",
    "directory_facilities_matching": _PEOPLE + ", e AS (SELECT u AS facility, count(*) AS doctor_count, nullif(count(*) FILTER (WHERE nationality = 'India'), 0) AS matching FROM (SELECT unnest(linked) AS u, nationality FROM p) GROUP BY 1) SELECT fx.facility, fx.type, coalesce(doctor_count, 0) AS doctor_count, matching FROM fx LEFT JOIN e ON e.facility = fx.facility",
    "directory_facility_roles": _PEOPLE + "SELECT facility_id, role, count(*) AS people FROM (SELECT facility_id, unnest(CASE WHEN roles <> '' THEN string_split(roles, '||') WHEN sp.specialty IS NOT NULL THEN [sp.specialty] ELSE [] END) AS role FROM l JOIN sp ON sp.id = l.doctor_id WHERE is_licensed) GROUP BY 1, 2",
    "directory_facility_people": _PEOPLE + "SELECT doctor_id AS id, CASE WHEN roles <> '' THEN roles ELSE coalesce(sp.specialty, '') END AS roles FROM l JOIN sp ON sp.id = l.doctor_id WHERE is_licensed AND facility_id = 'F-000001'",
}
