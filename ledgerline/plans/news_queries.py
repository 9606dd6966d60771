"""Queries over what happens between taking items in and publishing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import feed
from ledgerline.operators import newsroom as N
from ledgerline.plans import feed_queries as Q
from ledgerline.plans.feed_queries import _A, _ENTITIES, _re, NOW
from ledgerline.sources.lineage import written
from ledgerline.sources.tables import once, table


def _now():
    return F.lit(NOW).cast("timestamp")


def gate(spark: SparkSession, folder: str) -> DataFrame:
    a = once(table(spark, folder, "article"), "id", "title", "excerpt", "sourceId")
    s = once(table(spark, folder, "feed_source"), "id", "trustTier").withColumnRenamed("id", "sourceId")
    clinical = F.concat_ws(" ", "title", "excerpt").rlike(feed.worded(feed.CLINICAL))
    return N.review_gate(a.join(s, "sourceId", "left"), clinical, F.col("trustTier")).select("id", "gate", "editorial_status", "medical_review")


def promotion(spark: SparkSession, folder: str) -> DataFrame:
    """The first 50 of the waiting articles go out."""
    out = N.promoted(Q.articles(spark, folder).select("id", "status", "publishedAt", "updatedAt", "at"), _now(), 50)
    return out.select("id", "status", F.unix_seconds("publishedAt").alias("published"), F.unix_seconds("updatedAt").alias("updated"))


def review(spark: SparkSession, folder: str) -> DataFrame:
    """Held articles are approved or rejected by the last figure of their id, some named by id, some by slug."""
    a = Q.articles(spark, folder).select("id", "slug", "status")
    last = F.right("id", F.lit(1))
    said = a.where(last.isin("1", "2", "3")).select(F.when(last == "1", F.col("slug")).otherwise(F.col("id")).alias("ref"), (last != "3").alias("approve"))
    return N.reviewed(a, said).groupBy("status").agg(F.count(F.lit(1)).alias("articles"))


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs of each source but the shortest-named, whose outcome follows from the length of its name."""
    s = table(spark, folder, "feed_source").where("length(id) > 8")
    kind = lambda n: F.when(F.length("id") % n == 0, 304).when(F.length("id") % n == 1, 200).when(F.length("id") % n == 2, 429).otherwise(500)
    one = s.select(F.col("id").alias("source_id"), F.timestamp_seconds(F.lit(1_750_000_000)).alias("started_at"), kind(3).alias("http_status"), F.lit(None).cast("string").alias("error"))
    return one.union(s.select("id", F.timestamp_seconds(F.lit(1_750_003_600)), kind(5), F.when(F.length("id") % 7 == 0, "no answer")))


def runs(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "feed_source").select("id", F.col("consecutiveFailures").alias("failures"), F.lit(None).cast("timestamp").alias("last_success_at"), F.col("lastCheckedAt").alias("last_checked_at"), F.lit("LIVE").alias("status"))
    return N.after_runs(s, _runs(spark, folder)).select("id", "status", "last_status", "last_error", "failures", F.unix_seconds("last_success_at").alias("success"))


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """Stored are the sources with an even length of name, under an older name, and one that is no longer declared."""
    s = table(spark, folder, "feed_source")
    declared = s.select("id", "name", "enabled", F.col("requiresConfig").alias("requires_config"))
    even = s.where("length(id) % 2 = 0").select("id", F.concat(F.lit("old "), "name").alias("name"), F.lit(True).alias("enabled"), F.lit(False).alias("requires_config"), F.when(F.length("id") % 4 == 0, "FAILED").otherwise("DISABLED").alias("status"))
    gone = spark.range(1).selectExpr("'gone' AS id", "'Gone' AS name", "true AS enabled", "false AS requires_config", "'LIVE' AS status")
    return N.merged_registry(declared, even.union(gone))


def linked_disciplines(spark: SparkSession, folder: str) -> DataFrame:
    linked = written(Q.entities(spark, folder).where("entity_type = 'specialty'").select("article_id", "entity_id"), "linked")
    return N.discipline_links(Q._texts(spark, folder), Q._specialties(spark, folder), linked)


def disciplines(spark: SparkSession, folder: str) -> DataFrame:
    return N.disciplines(Q._specialties(spark, folder)).select("phrase", F.array_join("labels", "|").alias("labels"))


def ambiguous(spark: SparkSession, folder: str) -> DataFrame:
    return N.ambiguous_mentions(Q._texts(spark, folder), Q._names(spark, folder))


def published(spark: SparkSession, folder: str) -> DataFrame:
    sure = Q.entities(spark, folder)
    noted = N.ambiguous_mentions(Q._texts(spark, folder), Q._names(spark, folder)).select("article_id", F.lit("doctor").alias("entity_type"), "entity_id", "label", F.lit(0.0).alias("confidence"))
    out = N.public_articles(Q.articles(spark, folder), sure.union(noted))
    lists = [F.array_join(c, "|").alias(c) for c in ("specialty_ids", "facility_ids", "doctor_ids", "card_specialties", "card_facilities")]
    return out.select("id", "category", "content_type", "region", "has_full_content", "ambiguous_mentions", *lists)


def summary(spark: SparkSession, folder: str) -> DataFrame:
    return N.archive_summary(Q.articles(spark, folder), table(spark, folder, "feed_source"), Q.entities(spark, folder))


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    return N.blocks(Q.articles(spark, folder))


def latest(spark: SparkSession, folder: str) -> DataFrame:
    a = N.latest_ignoring_dates(Q.articles(spark, folder), category="medical-news", kind="news", since=_now())
    return a.select(F.unix_micros("latest").alias("latest"))


def offered(spark: SparkSession, folder: str) -> DataFrame:
    return N.offered(Q.articles(spark, folder))


def sources(spark: SparkSession, folder: str) -> DataFrame:
    return N.sources_listed(table(spark, folder, "feed_source"))


def view_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return N.view_snapshot(feed.view_counts(table(spark, folder, "events"), "event_type", "user_id", "ts"))


def oldest_first(spark: SparkSession, folder: str) -> DataFrame:
    """[O15] The first page from the oldest on; undated ones would stand last."""
    return Q.articles(spark, folder).orderBy(F.asc_nulls_last("at"), "id").limit(12).select("id")


_STEP = "regexp_replace({c}, '(?i)^(" + "|".join(N.RANKS) + ")\\s+', '')"
_BARE = Q._phrase("trim(regexp_replace(" + _STEP.format(c=_STEP.format(c="trim(label)")) + ", '\\s*\\([^)]*\\)\\s*$', ''))")
_GENERAL = "[" + ", ".join(f"'{w}'" for w in N.GENERAL) + "]"
_DISC = f"SELECT phrase, list_sort(list(DISTINCT label)) AS labels FROM (SELECT label, {_BARE} AS phrase FROM spc) WHERE len(phrase) >= 7 AND len(list_filter(string_split(phrase, ' '), lambda w: NOT list_contains({_GENERAL}, w))) > 0 GROUP BY 1"
_TERMS = ", ".join(f"({i}, '(?i){p}', '{t}')" for i, (p, t) in enumerate(N.LAY_TERMS))
_AMBIGUOUS = f"SELECT phrase, min(label) AS label FROM (SELECT id, label, {Q._phrase('label')} AS phrase FROM ({Q._NAMES})) GROUP BY 1 HAVING count(DISTINCT id) > 1"
_KIND = "CASE WHEN len(id) % {n} = 0 THEN 304 WHEN len(id) % {n} = 1 THEN 200 WHEN len(id) % {n} = 2 THEN 429 ELSE 500 END"
_SUMMARY = "unnest(['assessed', 'published', 'local', 'contributing_sources', 'linked']) AS what, unnest([count(*) FILTER (WHERE status IN ('PUBLISHED', 'EDITORIAL_REVIEW', 'MEDICAL_REVIEW')), count(*) FILTER (WHERE status = 'PUBLISHED'), count(*) FILTER (WHERE status = 'PUBLISHED' AND region = 'uae'), count(DISTINCT sourceName) FILTER (WHERE status = 'PUBLISHED'), count(*) FILTER (WHERE status = 'PUBLISHED' AND id IN (SELECT article_id FROM ents))]) AS v"
_LIVE = "enabled AND NOT coalesce(requiresConfig, false)"


def _ids(kind: str, what: str, n: int | None = None) -> str:
    return f"coalesce((SELECT string_agg({what}, '|' ORDER BY round(confidence, 2) DESC, label, entity_id) FROM (SELECT *, row_number() OVER (ORDER BY round(confidence, 2) DESC, label, entity_id) AS k FROM ents WHERE ents.article_id = x.id AND entity_type = '{kind}')" + (f" WHERE k <= {n}" if n else "") + "), '')"


QUERIES = {
    f"news_{f.__name__}": f
    for f in (gate, promotion, review, runs, registry, disciplines, linked_disciplines, ambiguous, published, summary, blocks, latest, offered, sources, view_snapshot, oldest_first)
}
SQL = {
    "news_gate": f"WITH s AS (SELECT DISTINCT id AS sid, trustTier FROM feed_source), g AS (SELECT DISTINCT a.id, CASE WHEN regexp_matches(concat_ws(' ', title, excerpt), {_re(feed.CLINICAL)}) THEN 'MEDICAL_REVIEW' WHEN trustTier <= 2 THEN 'READY' ELSE 'EDITORIAL_REVIEW' END AS gate FROM (SELECT DISTINCT id, title, excerpt, sourceId FROM article) a LEFT JOIN s ON s.sid = a.sourceId) SELECT id, gate, CASE WHEN gate = 'EDITORIAL_REVIEW' THEN 'PENDING' ELSE 'AUTO_APPROVED' END AS editorial_status, CASE WHEN gate = 'MEDICAL_REVIEW' THEN 'PENDING' ELSE 'NOT_REQUIRED' END AS medical_review FROM g",
    "news_promotion": _A + f", u AS (SELECT id FROM x WHERE status = 'READY' ORDER BY placed DESC NULLS LAST, id LIMIT 50) SELECT x.id, CASE WHEN u.id IS NOT NULL THEN 'PUBLISHED' ELSE status END AS status, CAST(floor(epoch(CASE WHEN u.id IS NOT NULL THEN coalesce(publishedAt, TIMESTAMPTZ '{NOW}+00') ELSE publishedAt END)) AS BIGINT) AS published, CAST(floor(epoch(CASE WHEN u.id IS NOT NULL THEN TIMESTAMPTZ '{NOW}+00' ELSE updatedAt END)) AS BIGINT) AS updated FROM x LEFT JOIN u USING (id)",
    "news_review": _A + ", b AS (SELECT slug, true AS ok FROM x WHERE right(id, 1) = '1' GROUP BY 1), r AS (SELECT CASE WHEN status IN ('MEDICAL_REVIEW', 'EDITORIAL_REVIEW') THEN CASE WHEN right(id, 1) = '2' THEN 'READY' WHEN right(id, 1) = '3' THEN 'REJECTED' WHEN b.ok THEN 'READY' ELSE status END ELSE status END AS status FROM x LEFT JOIN b ON b.slug = x.slug) SELECT status, count(*) AS articles FROM r GROUP BY 1",
    "news_runs": f"WITH s AS (SELECT DISTINCT id, coalesce(consecutiveFailures, 0) AS f, len(id) > 8 AS ran, {_KIND.format(n=3)} AS h1, {_KIND.format(n=5)} AS h2, CASE WHEN len(id) % 7 = 0 THEN 'no answer' END AS e2 FROM feed_source), o AS (SELECT *, h1 IN (200, 304) AS ok1, h2 IN (200, 304) AND e2 IS NULL AS ok2 FROM s) SELECT id, CASE WHEN NOT ran OR ok2 THEN 'LIVE' WHEN h2 IN (429, 503) THEN 'RATE_LIMITED' ELSE 'FAILED' END AS status, CASE WHEN NOT ran THEN NULL WHEN ok2 AND h2 = 304 THEN 'NOT_MODIFIED' WHEN ok2 THEN 'OK' ELSE 'FAILED' END AS last_status, CASE WHEN ran AND NOT ok2 THEN coalesce(e2, 'HTTP ' || h2) END AS last_error, CAST(CASE WHEN NOT ran THEN f WHEN ok2 THEN 0 WHEN ok1 THEN 1 ELSE f + 2 END AS INTEGER) AS failures, CASE WHEN ran AND ok2 AND h2 = 200 THEN 1750003600 WHEN ran AND ok1 AND h1 = 200 THEN 1750000000 END AS success FROM o",
    "news_registry": "SELECT id, name, coalesce(enabled, true) AS enabled, coalesce(requiresConfig, false) AS requires_config, CASE WHEN coalesce(requiresConfig, false) THEN 'NEEDS_CONFIGURATION' WHEN NOT coalesce(enabled, true) THEN 'DISABLED' WHEN len(id) % 4 = 0 THEN 'FAILED' ELSE 'LIVE' END AS status FROM (SELECT DISTINCT id, name, enabled, requiresConfig FROM feed_source) UNION ALL SELECT 'gone', 'Gone', true, false, 'LIVE'",
    "news_disciplines": f"WITH spc AS ({Q._SPECIALTIES}) SELECT phrase, array_to_string(labels, '|') AS labels FROM ({_DISC})",
    "news_linked_disciplines": _ENTITIES + f", d AS ({_DISC}), lt AS (SELECT * FROM (VALUES {_TERMS}) v(term, re, part)), nd AS (SELECT article_id, phrase, 0 AS kind, 0 AS term FROM (SELECT article_id, phrase, row_number() OVER (PARTITION BY article_id ORDER BY phrase) AS n FROM hay JOIN d ON contains(t, ' ' || phrase || ' ')) WHERE n <= 8), ot AS (SELECT term, phrase FROM (SELECT term, phrase, row_number() OVER (PARTITION BY term ORDER BY phrase) AS k FROM lt JOIN d ON contains(phrase, part)) WHERE k <= 2), ly AS (SELECT article_id, ot.phrase, 1 AS kind, lt.term FROM hay JOIN lt ON regexp_matches(text, re) JOIN ot ON ot.term = lt.term), un AS (SELECT *, dense_rank() OVER (PARTITION BY article_id ORDER BY kind, CASE WHEN kind = 0 THEN phrase ELSE '' END, term) AS unit FROM (SELECT * FROM nd UNION ALL SELECT * FROM ly)), wd AS (SELECT article_id, unit, kind, unnest(labels[1:4]) AS entity_id FROM un JOIN d USING (phrase) WHERE unit <= 8), fs AS (SELECT article_id, entity_id, arg_min(kind, unit) AS kind FROM wd GROUP BY 1, 2) SELECT article_id, entity_id, CASE WHEN kind = 0 THEN 'discipline_match' ELSE 'lay_term' END AS method, CAST(CASE WHEN kind = 0 THEN 0.62 ELSE 0.55 END AS DOUBLE) AS confidence FROM fs WHERE NOT EXISTS (SELECT 1 FROM ents WHERE ents.article_id = fs.article_id AND entity_type = 'specialty' AND ents.entity_id = fs.entity_id)",
    "news_ambiguous": f"WITH q AS ({_AMBIGUOUS}), hay AS ({Q._HAY}) SELECT article_id, 'ambiguous:' || replace(phrase, ' ', '-') AS entity_id, label FROM hay JOIN q ON contains(t, ' ' || phrase || ' ')",
    "news_published": _ENTITIES + f", amb AS ({_AMBIGUOUS}), am AS (SELECT article_id, count(*) AS n FROM hay JOIN amb ON contains(t, ' ' || phrase || ' ') GROUP BY 1), x AS (SELECT DISTINCT id, category, contentType, region, content IS NOT NULL AS has FROM article WHERE status = 'PUBLISHED') SELECT id, category, contentType AS content_type, coalesce(region, 'global') AS region, has AS has_full_content, coalesce(am.n, 0) AS ambiguous_mentions, {_ids('specialty', 'entity_id')} AS specialty_ids, {_ids('facility', 'entity_id')} AS facility_ids, {_ids('doctor', 'entity_id')} AS doctor_ids, {_ids('specialty', 'label', 3)} AS card_specialties, {_ids('facility', 'label', 2)} AS card_facilities FROM x LEFT JOIN am ON am.article_id = x.id",
    "news_summary": _ENTITIES + f", x AS (SELECT DISTINCT * FROM article) SELECT what, CAST(v AS VARCHAR) AS value FROM (SELECT {_SUMMARY} FROM x) UNION ALL SELECT 'live_sources', CAST(count(*) FILTER (WHERE {_LIVE}) AS VARCHAR) FROM feed_source UNION ALL SELECT 'cadence', CASE WHEN min(scheduleMinutes) % 60 = 0 THEN 'Checked every ' || (min(scheduleMinutes) // 60) || ' hour' || CASE WHEN min(scheduleMinutes) = 60 THEN '' ELSE 's' END ELSE 'Checked every ' || min(scheduleMinutes) || ' minutes' END FROM feed_source WHERE {_LIVE}",
    "news_blocks": _A + ", b AS (SELECT 'local' AS block, 12 AS most, x.* FROM x WHERE region = 'uae' UNION ALL SELECT 'global', 12, x.* FROM x WHERE region IS DISTINCT FROM 'uae' UNION ALL SELECT 'research', 6, x.* FROM x WHERE contentType = 'research' OR category = 'research-and-insights') SELECT block, place, id FROM (SELECT block, most, id, row_number() OVER (PARTITION BY block ORDER BY placed DESC NULLS LAST, id) AS place FROM b) WHERE place <= most",
    "news_latest": _A + "SELECT epoch_us(max(placed)) AS latest FROM x WHERE category = 'medical-news' AND contentType = 'news'",
    "news_offered": "SELECT DISTINCT 'source' AS what, sourceName AS value FROM article WHERE sourceName IS NOT NULL UNION ALL SELECT DISTINCT 'type', contentType FROM article WHERE contentType IS NOT NULL",
    "news_sources": "SELECT id, name, trustTier, row_number() OVER (ORDER BY trustTier, id) AS place FROM feed_source",
    "news_view_snapshot": "SELECT slug, views, '{\"slug\":\"' || slug || '\",\"views\":' || views || '}' AS json FROM (" + Q.SQL["feed_view_gate"] + ") WHERE regexp_matches(slug, '^[a-z0-9_-]{4,120}$')",
    "news_oldest_first": _A + "SELECT id FROM x ORDER BY placed NULLS LAST, id LIMIT 12",
}
