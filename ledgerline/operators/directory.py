"""The directory: multi-select filters, text search, live facet counts, orders, pages, suggestions."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions.text import blank_to_null, fold, squeezed
from ledgerline.operators import register as R

#: Facets that hold one value a row, and those that hold several.
SINGLE = ("category", "specialty", "nationality")
SEVERAL = ("licence", "language", "facility", "facility_type")
FACETS = SINGLE + SEVERAL
TOGGLES = ("has_mobile", "has_email", "has_linkedin", "has_experience", "has_education", "has_facility", "has_languages", "has_contact")
_FILTERED = {"licence": "licence_types", "language": "languages", "facility": "licensed_facilities", "facility_type": "facility_types"}
_COUNTED = {**_FILTERED, "facility": "linked_facilities"}
MODES = ("all", "professionals", "facilities")
SORTS = ("relevance", "name-asc", "name-desc", "specialty", "facility")


@dataclass(frozen=True)
class DirectoryQuery:
    """A query's whole state [S13, K17]: text, mode, order, page, chosen labels of each facet and toggles."""

    q: str = ""
    mode: str = "all"
    sort: str = "relevance"
    page: int = 1
    chosen: dict[str, tuple[str, ...]] = field(default_factory=dict)
    toggles: tuple[str, ...] = ()

    @classmethod
    def from_params(cls, text: str) -> DirectoryQuery:
        """From a query string; what is unknown or malformed is left out."""
        p = parse_qs(text.lstrip("?"))
        one = lambda k, allowed, default: p.get(k, [default])[0] if p.get(k, [default])[0] in allowed else default
        page = p.get("page", ["1"])[0]
        chosen = {f: tuple(x for x in p.get(f, []) if x) for f in FACETS}
        return cls(p.get("q", [""])[0], one("mode", MODES, "all"), one("sort", SORTS, "relevance"), max(1, int(page)) if page.isdigit() else 1, {k: v for k, v in chosen.items() if v}, tuple(t for t in TOGGLES if p.get(t, ["0"])[0] == "1"))

    def to_params(self) -> str:
        """As a query string without what is default."""
        pairs = [("q", self.q)] * bool(self.q) + [("mode", self.mode)] * (self.mode != "all") + [("sort", self.sort)] * (self.sort != "relevance")
        pairs += [(f, x) for f in FACETS for x in self.chosen.get(f, ())] + [(t, "1") for t in TOGGLES if t in self.toggles] + [("page", str(self.page))] * (self.page > 1)
        return urlencode(pairs)

    def with_mode(self, mode: str) -> DirectoryQuery:
        """[P43] Another mode; the facility list knows no order of its own by specialty, and the list of people none by facility kind."""
        drop = {"professionals": ("facility", "facility_type"), "facilities": (), "all": ()}[mode]
        return replace(self, mode=mode, page=1, chosen={k: v for k, v in self.chosen.items() if k not in drop})

    def active_filters(self) -> int:
        """[A33] Number of chosen labels and toggles, one more for a text."""
        return sum(len(v) for v in self.chosen.values()) + len(self.toggles) + bool(self.q.strip())


def professionals(doctors: DataFrame, placements: DataFrame, facilities: DataFrame, licences: DataFrame) -> DataFrame:
    """One row for each active person with all that is searched, filtered, counted and sorted by [P7, P23, P29, J6, J7].

    Labels stand in the row, lists are distinct. base_name is the order of the unsorted list.
    """
    link = R.links(doctors, placements, facilities)
    place = facilities.select(F.col("id").alias("facility_id"), F.col("nameTrimmed").alias("facility"), F.col("typeGuess").alias("type")).dropDuplicates(["facility_id"])
    per = link.where("is_current").join(place, "facility_id").groupBy(F.col("doctor_id").alias("id")).agg(
        F.array_sort(F.collect_set("facility")).alias("linked_facilities"),
        F.array_sort(F.collect_set(F.when(F.col("is_licensed"), F.col("facility")))).alias("licensed_facilities"),
        F.array_sort(F.collect_set("type")).alias("facility_types"),
        F.min_by("facility", F.struct(F.col("first_at"), F.col("facility_id"))).alias("first_facility"),
    )
    has = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    base = R.active(doctors).distinct().join(R.licence_names(doctors, licences), "id", "left").join(per, "id", "left")
    empty = F.array().cast("array<string>")
    text = squeezed("speciality")
    base = base.withColumn("category", F.nullif(R.category(text), F.lit(""))).withColumn("specialty", R.specialty(text))
    languages = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(squeezed("languages"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))
    return base.select(
        "id", "name", fold(F.coalesce("name", F.lit(""))).alias("name_folded"), "category", "specialty", blank_to_null(F.col("nationality")).alias("nationality"),
        fold(F.coalesce("category", F.lit(""))).alias("category_folded"), fold(F.coalesce("specialty", F.lit(""))).alias("specialty_folded"),
        F.coalesce("licence_types", empty).alias("licence_types"), languages.alias("languages"),
        *[F.coalesce(c, empty).alias(c) for c in ("linked_facilities", "licensed_facilities", "facility_types")],
        F.transform(F.coalesce("linked_facilities", empty), fold).alias("facilities_folded"), "first_facility",
        has("mobileNumber").alias("has_mobile"), has("personalEmail").alias("has_email"), has("linkedIn").alias("has_linkedin"), has("experience").alias("has_experience"), has("education").alias("has_education"),
        (F.size(F.coalesce("linked_facilities", empty)) > 0).alias("has_facility"), (F.size(languages) > 0).alias("has_languages"), (has("mobileNumber") | has("personalEmail")).alias("has_contact"),
    )


def folded_query(text: str) -> str:
    """The text of a query as the rows are folded."""
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not "̀" <= c <= "ͯ")
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in plain).split())


def text_match(q: str, mode: str = "all") -> Column:
    """[P24, P25] Every word is part of the name, specialty, category or (mode all) a linked facility's name; four digits and more are an id first."""
    raw, terms = q.strip(), folded_query(q).split()
    if not terms:
        return F.lit(True)
    def term(t: str) -> Column:
        hit = F.col("name_folded").contains(t) | F.col("specialty_folded").contains(t) | F.col("category_folded").contains(t)
        return hit | F.exists("facilities_folded", lambda f: f.contains(t)) if mode == "all" else hit
    found = reduce(lambda a, b: a & b, [term(t) for t in terms])
    return F.col("id").contains(raw) | found if len(raw) >= 4 and raw.isdigit() else found


def facet_predicate(facet: str, labels: tuple[str, ...]) -> Column:
    """[P17-P21] Whether a row has any of the labels; null-safe."""
    if facet in SINGLE:
        return F.coalesce(F.col(facet).isin(*labels), F.lit(False))
    return F.coalesce(F.arrays_overlap(F.col(_FILTERED[facet]), F.array(*[F.lit(x) for x in labels])), F.lit(False))


def always_on(query: DirectoryQuery) -> Column:
    """Text and toggles [P22, P23]."""
    return reduce(lambda a, b: a & b, [F.col(t) for t in query.toggles], text_match(query.q, query.mode))


def matched(people: DataFrame, query: DirectoryQuery) -> DataFrame:
    """Rows under all filters."""
    return people.where(reduce(lambda a, b: a & b, [facet_predicate(f, v) for f, v in query.chosen.items()], always_on(query)))


def facet_counts(people: DataFrame, query: DirectoryQuery, facets: tuple[str, ...] = FACETS) -> DataFrame:
    """[A6] (facet, label, cnt): each facet counted under all filters but its own, in one scan and one shuffle.

    A row counts for a facet if it passes everything, or fails nothing but that facet. Lists count each of their labels once.
    """
    missed = F.array_compact(F.array(*[F.when(~facet_predicate(f, v), F.lit(f)) for f, v in query.chosen.items()])) if query.chosen else F.array().cast("array<string>")
    rows = people.where(always_on(query)).withColumn("_missed", missed).where(F.size("_missed") <= 1)
    def labels(f: str) -> Column:
        source = F.array(F.col(f)) if f in SINGLE else F.col(_COUNTED[f])
        counts = (F.size("_missed") == 0) | (F.get(F.col("_missed"), F.lit(0)) == f)
        return F.when(counts, F.transform(F.filter(source, lambda x: x.isNotNull()), lambda x: F.struct(F.lit(f).alias("facet"), x.alias("label")))).otherwise(F.array().cast("array<struct<facet:string,label:string>>"))
    pairs = rows.select(F.explode(F.concat(*[labels(f) for f in facets])).alias("p"))
    return pairs.select("p.facet", "p.label").groupBy("facet", "label").agg(F.count(F.lit(1)).alias("cnt"))


def toggle_counts(people: DataFrame, query: DirectoryQuery) -> DataFrame:
    """[A7] One row: matches, and how many of them have each toggle."""
    return matched(people, query).agg(F.count(F.lit(1)).alias("matches"), *[F.count_if(F.col(t)).alias(t) for t in TOGGLES])


def order_by(query: DirectoryQuery) -> list[Column]:
    """[O1-O5] A total order; missing values last, ties by name and id."""
    base = [F.asc("name_folded"), F.asc_nulls_last("name"), F.asc("id")]
    if query.sort == "name-asc":
        return base
    if query.sort == "name-desc":
        return [F.desc("name_folded"), F.asc_nulls_last("name"), F.asc("id")]
    if query.sort == "specialty":
        return [F.asc_nulls_last(F.nullif(F.col("specialty_folded"), F.lit(""))), *base]
    if query.sort == "facility":
        return [F.asc_nulls_last(fold(F.col("first_facility"))), *base]
    q = folded_query(query.q)
    if not q:
        return [F.asc_nulls_last("name"), F.asc("id")]
    return [F.when(F.col("name_folded").startswith(q), 0).when(F.col("name_folded").contains(q), 1).otherwise(2).asc(), *base]


def page(people: DataFrame, query: DirectoryQuery, size: int = 24) -> DataFrame:
    """[O8] The rows shown after so many pages, in order."""
    return matched(people, query).orderBy(*order_by(query)).limit(query.page * size)


def facility_results(people: DataFrame, facilities: DataFrame, query: DirectoryQuery) -> DataFrame:
    """[J16, A28, O6] Facilities with the number of matching people linked to them; no match is NULL, which is not 0."""
    per = matched(people, query).select(F.explode("linked_facilities").alias("facility")).groupBy("facility").agg(F.count(F.lit(1)).alias("matching"))
    every = people.select(F.explode("linked_facilities").alias("facility")).groupBy("facility").agg(F.count(F.lit(1)).alias("doctor_count"))
    f = facilities.select(F.col("nameTrimmed").alias("facility"), F.col("typeGuess").alias("type")).where("facility IS NOT NULL").dropDuplicates(["facility"])
    return f.join(every, "facility", "left").join(per, "facility", "left").select("facility", "type", F.coalesce("doctor_count", F.lit(0)).alias("doctor_count"), "matching")


def suggestions(people: DataFrame, facilities: DataFrame, text: str, mode: str = "all", limit: int = 8) -> DataFrame:
    """[O14] At most `limit` suggestions (kind, value, rank): facilities, specialties and categories, then names; beginnings before other finds.

    Nothing for fewer than two letters. Each kind is a top-k of its own; only their few rows are put in order together.
    """
    q = folded_query(text)
    none = people.select(F.lit("").alias("kind"), F.col("name").alias("value"), F.lit(0).alias("rank")).limit(0)
    if len(q) < 2:
        return none
    per = limit // 2 if mode == "all" else limit
    def top(df: DataFrame, kind: str, value: str, folded: Column, n: int, place: int) -> DataFrame:
        hits = df.select(F.col(value).alias("value"), folded.alias("f")).where(F.col("f").contains(q)).distinct()
        hits = hits.orderBy(F.when(F.col("f").startswith(q), 0).otherwise(1), "f", "value").limit(n)
        return hits.select(F.lit(kind).alias("kind"), F.lit(place).alias("place"), F.when(F.col("f").startswith(q), 0).otherwise(1).alias("late"), "f", "value")
    parts = []
    if mode in ("all", "facilities"):
        parts.append(top(facilities, "facility", "nameTrimmed", fold(F.col("nameTrimmed")), per, 1))
    if mode in ("all", "professionals"):
        parts.append(top(people, "specialty", "specialty", F.col("specialty_folded"), 3, 2))
        parts.append(top(people, "category", "category", F.col("category_folded"), 1, 3))
        parts.append(top(people, "professional", "name", F.col("name_folded"), per, 4))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("place", "late", "f", "value"))  # a few rows
    return reduce(DataFrame.union, parts).withColumn("rank", rank).where(F.col("rank") <= limit).select("kind", "value", "rank")


def facility_people(link: DataFrame, people: DataFrame, facility_id: str, role: str | None = None, text: str = "") -> DataFrame:
    """[P28, P30] People licensed at a facility, with their roles there: the titles of their licences, else their specialty."""
    here = link.where((F.col("facility_id") == facility_id) & F.col("is_licensed")).select(F.col("doctor_id").alias("id"), "roles")
    own = F.when(F.col("specialty").isNotNull(), F.array("specialty")).otherwise(F.array().cast("array<string>"))
    out = here.join(people.select("id", "name", "name_folded", "specialty"), "id").withColumn("roles", F.when(F.size("roles") > 0, F.col("roles")).otherwise(own))
    out = out.where(F.array_contains("roles", role)) if role else out
    return out.where(F.col("name_folded").contains(text.lower())).select("id", "name", "roles") if text else out.select("id", "name", "roles")


def facility_roles(link: DataFrame, people: DataFrame) -> DataFrame:
    """[A29] (facility_id, role, people) of licensed people."""
    licensed = link.where("is_licensed").join(people.select(F.col("id").alias("doctor_id"), "specialty"), "doctor_id")
    own = F.when(F.col("specialty").isNotNull(), F.array("specialty")).otherwise(F.array().cast("array<string>"))
    roles = licensed.select("facility_id", "doctor_id", F.explode(F.when(F.size("roles") > 0, F.col("roles")).otherwise(own)).alias("role"))
    return roles.groupBy("facility_id", "role").agg(F.count(F.lit(1)).alias("people"))
