"""Queries over the news feed and its archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.functions.text import squeezed
from ledgerline.functions.urls import canonical_url
from ledgerline.operators import feed
from ledgerline.operators import register as R
from ledgerline.plans.register_queries import _SPLIT
from ledgerline.sources.tables import once, table

#: The moment that stands for now.
NOW = "2025-06-30 12:00:00"


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Stored articles, each once, with `at`, the time they are placed by."""
    a = once(table(spark, folder, "article"))
    return a.withColumn("at", F.coalesce("originalPublishedAt", "retrievedAt"))


def canonical(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "article"), "id", "canonicalUrl").select("id", canonical_url(F.col("canonicalUrl")).alias("url"))


def titles(spark: SparkSession, folder: str) -> DataFrame:
    a = once(table(spark, folder, "article"), "id", "title", "excerpt")
    return a.select("id", T.normalized_title(F.col("title")).alias("normalized_title"), T.story_key(F.col("title")).alias("story_key"), T.content_hash(F.col("title"), F.col("excerpt")).alias("content_hash"))


def categories(spark: SparkSession, folder: str) -> DataFrame:
    a = once(table(spark, folder, "article"), "id", "title", "excerpt", "sourceId")
    s = F.broadcast(once(table(spark, folder, "feed_source"), "id", "region", "defaultCategory").withColumnRenamed("id", "sourceId"))  # the registry of sources, a fixed dozen
    out = feed.classified(a.join(s, "sourceId", "left"), F.concat_ws(" ", "title", "excerpt"), F.col("defaultCategory"), F.col("region"))
    return out.select("id", "category", "content_type", "item_region", "clinical")


def _keys(df: DataFrame) -> DataFrame:
    return df.select(
        "id", F.col("sourceId").alias("source_id"), canonical_url(F.col("canonicalUrl")).alias("canonical_url"), F.col("sourceHash").alias("source_hash"), F.col("contentHash").alias("content_hash"),
        F.col("normalizedTitle").alias("normalized_title"), F.col("simHash").alias("story_key"), F.coalesce("originalPublishedAt", "retrievedAt").alias("at"),
    ).distinct()


def duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return feed.duplicate_of(_keys(table(spark, folder, "article_batch")), _keys(table(spark, folder, "article")))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    a = once(table(spark, folder, "article"), "id", "title", "excerpt", "content")
    return a.select("id", F.concat_ws(" ", "title", "excerpt", F.regexp_replace("content", "<[^>]*>", " ")).alias("text"))


def _specialties(spark: SparkSession, folder: str) -> DataFrame:
    return R.active(table(spark, folder, "doctor")).select(R.specialty(squeezed("speciality")).alias("label")).where("length(label) >= 5").distinct()


def _names(spark: SparkSession, folder: str) -> DataFrame:
    """People's names of two words and eight letters at least."""
    return R.active(table(spark, folder, "doctor")).select("id", F.trim("name").alias("label")).where((F.length("label") >= 8) & F.col("label").rlike(r"\s")).distinct()


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """[J10, A18] Facilities, specialties of the register and its people of a name that no other has; facility names of two words and ten letters at least."""
    f = once(table(spark, folder, "facility"), "id", "nameTrimmed")
    phrases = f.select(F.lit("facility").alias("entity_type"), F.col("id").alias("entity_id"), F.regexp_replace("nameTrimmed", r"(?i)\s+(L\.?L\.?C|L L C|FZ-LLC|Co)\.?(?= |$)", "").alias("label"))
    phrases = phrases.where((F.length("label") >= 10) & (F.size(F.split(F.trim(F.regexp_replace("label", "[^A-Za-z0-9]+", " ")), " ")) >= 2))
    specialties = _specialties(spark, folder).select(F.lit("specialty").alias("entity_type"), F.col("label").alias("entity_id"), "label")
    people = _names(spark, folder).select(F.lit("doctor").alias("entity_type"), F.col("id").alias("entity_id"), "label")
    found = feed.entity_links(_texts(spark, folder), phrases.union(specialties).union(people), letters={"specialty": 1, "doctor": 1, "facility": 1}, shared=("specialty",))
    return found.withColumn("confidence", F.round("confidence", 6))


def due(spark: SparkSession, folder: str) -> DataFrame:
    return feed.due_sources(table(spark, folder, "feed_source"), F.lit(NOW).cast("timestamp")).select("id")


def reading_time(spark: SparkSession, folder: str) -> DataFrame:
    a = once(table(spark, folder, "article"), "id", "content", "summary", "excerpt")
    return a.select("id", T.reading_minutes(F.coalesce("content", "summary", "excerpt")).alias("minutes"))


def archive_counts(spark: SparkSession, folder: str) -> DataFrame:
    """[A26] Articles of each category under all filters but the category's own."""
    a = feed.archive(articles(spark, folder), category="medical-news", kind="news", since=F.date_trunc("YEAR", F.lit(NOW).cast("timestamp")), words="clinic", skip="category")
    return a.groupBy("category").agg(F.count(F.lit(1)).alias("cnt"))


def calendar(spark: SparkSession, folder: str) -> DataFrame:
    """[P33] Articles since the beginning of the day, week (Monday), month and year of now."""
    now = F.lit(NOW).cast("timestamp")
    one = articles(spark, folder).where(F.col("at") <= now).agg(*[F.count_if(F.col("at") >= F.date_trunc(unit, now)).alias(unit.lower()) for unit in ("DAY", "WEEK", "MONTH", "YEAR")])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("since"), F.col(c).alias("cnt")) for c in ("day", "week", "month", "year")])).alias("x")).select("x.*")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return feed.paged(articles(spark, folder)).select("id", "page", "pos")


def featured(spark: SparkSession, folder: str) -> DataFrame:
    return feed.featured(articles(spark, folder))


def related(spark: SparkSession, folder: str) -> DataFrame:
    return feed.related(articles(spark, folder))


def rollup(spark: SparkSession, folder: str) -> DataFrame:
    """[A21] By category, content type and region in one aggregation over grouping sets."""
    a = articles(spark, folder).select("category", "contentType", "region")
    return a.groupingSets([["category"], ["contentType"], ["region"]], "category", "contentType", "region").agg(F.count(F.lit(1)).alias("cnt"))


def status(spark: SparkSession, folder: str) -> DataFrame:
    """[A20, A23]"""
    return articles(spark, folder).groupBy("status").agg(F.count(F.lit(1)).alias("cnt"), F.count_distinct("sourceName").alias("sources"), F.max("updatedAt").alias("last_update"))


def tags(spark: SparkSession, folder: str) -> DataFrame:
    """[P4, U7] Articles of each tag; broken lists count as none."""
    a = once(table(spark, folder, "article"), "id", "tags").select("id", F.explode(F.array_distinct(F.from_json("tags", "array<string>"))).alias("tag"))
    return a.groupBy("tag").agg(F.count(F.lit(1)).alias("cnt"))


def sitemap(spark: SparkSession, folder: str) -> DataFrame:
    """[K8] A line for each published article."""
    a = articles(spark, folder).where("status = 'PUBLISHED'")
    return a.select("slug", F.concat(F.lit("<url><loc>/intelligence/"), T.html_escaped(F.col("slug")), F.lit("</loc><lastmod>"), F.date_format("updatedAt", "yyyy-MM-dd"), F.lit("</lastmod></url>")).alias("line"))


def plain_text(spark: SparkSession, folder: str) -> DataFrame:
    """[F13, F16] Lengths of contents without markup."""
    a = once(table(spark, folder, "article"), "id", "content").where("content IS NOT NULL")
    return a.select("id", F.length(T.stripped(T.sanitised(F.col("content")))).alias("letters"))


def view_gate(spark: SparkSession, folder: str) -> DataFrame:
    return feed.view_counts(table(spark, folder, "events"), "event_type", "user_id", "ts")


def json_fields(spark: SparkSession, folder: str) -> DataFrame:
    """[P4, S2] A field of the events' JSON."""
    e = table(spark, folder, "events")
    return e.select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("event_type").agg(F.sum("k").alias("total"), F.count("k").alias("with_k"))


_A = "WITH a AS (SELECT DISTINCT * FROM article), x AS (SELECT *, coalesce(originalPublishedAt, retrievedAt) AS placed FROM a) "
_URL = """CASE WHEN regexp_matches(trim({c}), '(?i)^https?://') THEN lower(regexp_extract(trim({c}), '(?i)^(https?)://', 1)) || '://' || regexp_replace(lower(regexp_extract(trim({c}), '(?i)^https?://([^/?#]+)', 1)), '^www\\.', '')
 || coalesce(nullif(regexp_replace(regexp_extract(trim({c}), '(?i)^https?://[^/?#]+([^?#]*)', 1), '/+$', ''), ''), '/')
 || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(trim({c}), '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_|fbclid|gclid|mc_|ref|source)')), '&'), ''), '') ELSE trim({c}) END"""
_NORM = "trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), '\\b(" + "|".join(T.TITLE_STOP) + ")\\b', ' ', 'g'), ' +', ' ', 'g'))"


def _phrase(c: str) -> str:
    return _ENT.format(_american(c))


def _re(p: str) -> str:
    return "'(?i)\\b(" + p.replace("'", "''") + ")\\b'"


def _bounded(p: str) -> str:
    return "'" + p.replace(r"(?<![A-Za-z0-9_])", r"\b").replace(r"(?![A-Za-z0-9_])", r"\b").replace(r"|u\.a\.e\.(?=\w)", "").replace("'", "''") + "'"


_CATEGORY = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(t, {_re(p)}) THEN '{n}' END" for n, p in feed.CATEGORIES) + ", defaultCategory, 'medical-news')"
_LOCAL = f"(regexp_matches(t, '{feed.HEALTH}') AND (regexp_matches(t, {_bounded(feed.BODIES)}) OR len(regexp_extract_all(t, {_bounded(feed.PLACES)})) >= 2 OR (len(regexp_extract_all(t, {_bounded(feed.PLACES)})) >= 1 AND coalesce(region = 'uae', false))))"
_KEYS = "SELECT DISTINCT id, sourceId, {url} AS url, sourceHash, contentHash, normalizedTitle, simHash, coalesce(originalPublishedAt, retrievedAt) AS at FROM {t}"
_ENT = "trim(regexp_replace({}, '[^a-z0-9]+', ' ', 'g'))"


def _american(c: str) -> str:
    c = f"lower({c})"
    for a, b in T.AMERICAN:
        c = f"regexp_replace({c}, '\\b{a}', '{b}', 'g')"
    return c


_SPECIALTIES = f"SELECT DISTINCT specialty AS label FROM ({_SPLIT.replace(' FROM doctor', ' FROM doctor WHERE removedAt IS NULL')}) WHERE len(specialty) >= 5"
_NAMES = "SELECT DISTINCT id, trim(name) AS label FROM doctor WHERE removedAt IS NULL AND len(trim(name)) >= 8 AND regexp_matches(trim(name), '\\s')"
_HAY = f"SELECT id AS article_id, text, ' ' || {_phrase('text')} || ' ' AS t FROM (SELECT DISTINCT id, concat_ws(' ', title, excerpt, regexp_replace(content, '<[^>]*>', ' ', 'g')) AS text FROM article)"
_ENTITIES = f"""WITH f AS (SELECT DISTINCT id AS entity_id, regexp_replace(nameTrimmed, '(?i)\\s+(L\\.?L\\.?C|L L C|FZ-LLC|Co)\\.?( |$)', '\\2', 'g') AS label FROM facility), nm AS ({_NAMES}), spc AS ({_SPECIALTIES}),
p AS (SELECT 'facility' AS entity_type, entity_id, label, {_phrase('label')} AS phrase FROM f WHERE len(label) >= 10 AND len(string_split(trim(regexp_replace(label, '[^A-Za-z0-9]+', ' ', 'g')), ' ')) >= 2 UNION ALL SELECT 'doctor', id, label, {_phrase('label')} FROM nm),
q AS (SELECT entity_type, phrase, min(entity_id) AS entity_id, min(label) AS label FROM p WHERE phrase <> '' GROUP BY 1, 2 HAVING count(DISTINCT entity_id) = 1 UNION ALL SELECT 'specialty', {_phrase('label')}, label, label FROM spc),
hay AS ({_HAY}),
m AS (SELECT article_id, entity_type, entity_id, label, round(least(1.0, 0.55 + least(len(phrase), 60) / 120.0), 6) AS confidence, row_number() OVER (PARTITION BY article_id, entity_type ORDER BY label, entity_id) AS n FROM hay JOIN q ON contains(t, ' ' || phrase || ' ')),
ents AS (SELECT * FROM m WHERE n <= 8)
"""

QUERIES = {
    f"feed_{f.__name__}": f
    for f in (canonical, titles, categories, duplicates, entities, due, reading_time, archive_counts, calendar, pages, featured, related, rollup, status, tags, sitemap, plain_text, view_gate, json_fields)
}
SQL = {
    "feed_canonical": f"SELECT DISTINCT id, {_URL.format(c='canonicalUrl')} AS url FROM article",
    "feed_titles": f"WITH n AS (SELECT DISTINCT id, excerpt, {_NORM} AS nt FROM article), w AS (SELECT *, list_distinct(list_filter(string_split(nt, ' '), lambda x: len(x) > 3)) AS ws FROM n), k AS (SELECT *, array_to_string(list_sort(list_transform(list_sort(list_transform(ws, lambda x: lpad(CAST(1000 - len(x) AS VARCHAR), 4, '0') || x))[1:5], lambda x: substr(x, 5))), ' ') AS k FROM w) SELECT id, nt AS normalized_title, CASE WHEN len(ws) > 0 THEN substr(sha256(k), 1, 16) END AS story_key, sha256(nt || chr(1) || substr(coalesce(excerpt, ''), 1, 400)) AS content_hash FROM k",
    "feed_categories": f"WITH s AS (SELECT DISTINCT id AS sid, region, defaultCategory FROM feed_source), t AS (SELECT DISTINCT a.id, concat_ws(' ', title, excerpt) AS t, region, defaultCategory FROM (SELECT DISTINCT id, title, excerpt, sourceId FROM article) a LEFT JOIN s ON s.sid = a.sourceId), c AS (SELECT id, {_CATEGORY} AS c, {_LOCAL} AS l, regexp_matches(t, {_re(feed.CLINICAL)}) AS clinical, regexp_matches(t, {_re(feed.RESEARCH)}) AS r, regexp_matches(t, {_re(feed.BREAKING)}) AS b, region FROM t) SELECT id, CASE WHEN l AND c IN ('medical-news', 'doctors-and-clinics', 'health-and-wellness') THEN 'uae-healthcare-news' ELSE c END AS category, CASE WHEN clinical THEN 'medical' WHEN r THEN 'research' WHEN b THEN 'breaking-news' ELSE 'news' END AS content_type, CASE WHEN l THEN 'uae' WHEN region = 'gcc' THEN 'gcc' ELSE 'global' END AS item_region, clinical FROM c",
    "feed_duplicates": f"WITH n AS ({_KEYS.format(url=_URL.format(c='canonicalUrl'), t='article_batch')}), o AS ({_KEYS.format(url=_URL.format(c='canonicalUrl'), t='article')}), h AS (SELECT n.id, 1 AS rank, min(o.id) AS duplicate_of, 'canonical_url' AS reason FROM n JOIN o ON n.url = o.url GROUP BY n.id UNION ALL SELECT n.id, 2, min(o.id), 'source_hash' FROM n JOIN o ON n.sourceHash = o.sourceHash GROUP BY n.id UNION ALL SELECT n.id, 3, min(o.id), 'content_hash' FROM n JOIN o ON n.contentHash = o.contentHash GROUP BY n.id UNION ALL SELECT n.id, 4, min(o.id), 'normalized_title' FROM n JOIN o ON n.normalizedTitle = o.normalizedTitle AND n.normalizedTitle <> '' AND abs(epoch_us(n.at) - epoch_us(o.at)) < 86400000000 GROUP BY n.id UNION ALL SELECT n.id, 5, min(o.id), 'same_story' FROM n JOIN o ON n.simHash = o.simHash AND n.simHash <> '' AND n.sourceId <> o.sourceId AND abs(epoch_us(n.at) - epoch_us(o.at)) < 172800000000 GROUP BY n.id) SELECT id, duplicate_of, reason FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank) AS k FROM h) WHERE k = 1",
    "feed_entities": _ENTITIES + "SELECT article_id, entity_type, entity_id, label, CAST(confidence AS DOUBLE) AS confidence FROM ents",
    "feed_reading_time": "WITH a AS (SELECT DISTINCT id, coalesce(content, summary, excerpt) AS t FROM article), w AS (SELECT id, len(list_filter(string_split(trim(regexp_replace(regexp_replace(replace(replace(replace(coalesce(t, ''), '&nbsp;', ' '), '&amp;', '&'), '&quot;', '\"'), '<[^>]*>', ' ', 'g'), '[\\s\u00a0]+', ' ', 'g')), ' '), lambda x: x <> '')) AS n FROM a) SELECT id, CASE WHEN n >= 40 THEN CAST(greatest(1, floor(n / 225.0 + 0.5)) AS INTEGER) END AS minutes FROM w",
    "feed_view_gate": "WITH RECURSIVE e AS (SELECT event_type AS slug, user_id AS client, ts, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts) AS n FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL), g AS (SELECT slug, client, n, ts AS last, true AS counts, ts FROM e WHERE n = 1 UNION ALL SELECT e.slug, e.client, e.n, CASE WHEN e.ts - g.last > INTERVAL 12 HOURS THEN e.ts ELSE g.last END, e.ts - g.last > INTERVAL 12 HOURS, e.ts FROM g JOIN e ON e.slug = g.slug AND e.client = g.client AND e.n = g.n + 1) SELECT slug, count(*) AS views, min(ts) AS first_view, max(ts) AS last_view FROM g WHERE counts GROUP BY 1",
    "feed_due": f"SELECT id FROM feed_source WHERE enabled AND NOT coalesce(requiresConfig, false) AND feedUrl IS NOT NULL AND (lastCheckedAt IS NULL OR floor(epoch(TIMESTAMPTZ '{NOW}+00')) - floor(epoch(lastCheckedAt)) >= least(scheduleMinutes * 60 * pow(2, least(coalesce(consecutiveFailures, 0), 6)), 86400))",
    "feed_archive_counts": _A + f"SELECT category, count(*) AS cnt FROM x WHERE contentType = 'news' AND placed >= TIMESTAMPTZ '2025-01-01 00:00:00+00' AND contains(lower(concat_ws(' ', title, summary, sourceName, category)), 'clinic') GROUP BY 1",
    "feed_calendar": _A + f", n AS (SELECT placed FROM x WHERE placed <= TIMESTAMPTZ '{NOW}+00') SELECT unnest(['day', 'week', 'month', 'year']) AS since, unnest([count(*) FILTER (WHERE placed >= TIMESTAMPTZ '2025-06-30 00:00:00+00'), count(*) FILTER (WHERE placed >= TIMESTAMPTZ '2025-06-30 00:00:00+00'), count(*) FILTER (WHERE placed >= TIMESTAMPTZ '2025-06-01 00:00:00+00'), count(*) FILTER (WHERE placed >= TIMESTAMPTZ '2025-01-01 00:00:00+00')]) AS cnt FROM n",
    "feed_pages": _A + "SELECT id, CAST(ceil(pos / 12.0) AS INTEGER) AS page, pos FROM (SELECT id, row_number() OVER (ORDER BY placed DESC NULLS LAST, id) AS pos FROM x)",
    "feed_featured": _A + ", r AS (SELECT id, placed, image, part, row_number() OVER (PARTITION BY part ORDER BY placed DESC NULLS LAST, id) AS k FROM (SELECT *, CASE WHEN region = 'uae' THEN 0 ELSE 1 END AS part FROM x)), f AS (SELECT *, row_number() OVER (ORDER BY part, placed DESC NULLS LAST, id) AS rank FROM r WHERE k <= 5), g AS (SELECT * FROM f WHERE rank <= 5) SELECT id, rank, row_number() OVER (ORDER BY rank > 4, image IS NULL, rank) = 1 AS lead FROM g",
    "feed_related": _A + ", b AS (SELECT * FROM (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY placed DESC NULLS LAST, id) AS k FROM x) WHERE k <= 5) SELECT * FROM (SELECT x.id, b.id AS other, row_number() OVER (PARTITION BY x.id ORDER BY k) AS rank FROM x JOIN b ON b.category = x.category AND b.id <> x.id) WHERE rank <= 4",
    "feed_rollup": _A + "SELECT category, contentType, region, count(*) AS cnt FROM x GROUP BY GROUPING SETS ((category), (contentType), (region))",
    "feed_status": _A + "SELECT status, count(*) AS cnt, count(DISTINCT sourceName) AS sources, max(updatedAt) AS last_update FROM x GROUP BY 1",
    "feed_tags": "SELECT tag, count(*) AS cnt FROM (SELECT id, unnest(list_distinct(CAST(tags AS VARCHAR[]))) AS tag FROM (SELECT DISTINCT id, CAST(json(tags) AS JSON) AS tags FROM article WHERE json_valid(tags))) GROUP BY 1",
    "feed_sitemap": _A + "SELECT slug, '<url><loc>/intelligence/' || slug || '</loc><lastmod>' || strftime(updatedAt, '%Y-%m-%d') || '</lastmod></url>' AS line FROM x WHERE status = 'PUBLISHED'",
    "feed_json_fields": "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS total, count(json_extract_string(props, '$.k')) AS with_k FROM events GROUP BY 1",
}
