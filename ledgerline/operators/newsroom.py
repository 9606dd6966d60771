"""From taken-in items to what is published: the review gate, promotion, runs of sources, their registry, links of disciplines, public articles, summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions import text as T
from ledgerline.operators import feed
from ledgerline.operators.joins import bounded

# Words of rank before a discipline, and words too general to be one.
RANKS = ("consultant", "specialist", "general", "registered", "trainee", "assistant", "senior", "principal", "chief", "head", "resident", "fellow", "physician", "technician", "technologist", "therapist")
GENERAL = (
    "surgery", "medicine", "nurse", "nursing", "emergency", "practitioner", "dentist", "pharmacy", "therapy", "care", "health", "clinical", "medical", "doctor", "midwife", "assistant", "technician",
    "technologist", "therapist", "privilege", "admin",
)
# Everyday words and the part of a discipline they stand for.
LAY_TERMS = [
    (r"\bcancers?\b|\boncolog", "oncology"),
    (r"\bcardiac\b|\bheart (disease|failure|attack)\b", "cardiology"),
    (r"\bmental health\b|\bpsychiatric\b", "psychiatry"),
    (r"\bdiabet", "endocrinology"),
    (r"\bkidney\b|\brenal\b", "nephrology"),
    (r"\bnewborns?\b|\bneonatal\b", "neonatology"),
    (r"\bmaternal\b|\bobstetric", "obstetrics"),
    (r"\bstrokes?\b|\bneurological\b", "neurology"),
    (r"\bfertility\b|\bivf\b", "reproductive"),
    (r"\bdental\b|\bdentistry\b", "dentistry"),
]


def review_gate(df: DataFrame, clinical: Column, tier: Column) -> DataFrame:
    """[C5] df with gate, editorial_status and medical_review: clinical items wait for a physician, those of sources beyond tier 2 (or of unknown tier) for an editor."""
    gate = F.when(F.coalesce(clinical, F.lit(False)), "MEDICAL_REVIEW").when(tier <= 2, "READY").otherwise("EDITORIAL_REVIEW")
    return df.withColumn("gate", gate).withColumns({"editorial_status": F.when(F.col("gate") == "EDITORIAL_REVIEW", "PENDING").otherwise("AUTO_APPROVED"), "medical_review": F.when(F.col("gate") == "MEDICAL_REVIEW", "PENDING").otherwise("NOT_REQUIRED")})


def promoted(articles: DataFrame, now: Column, limit: int = 500) -> DataFrame:
    """[T4, O19] Articles after a promotion: the newest READY ones, `limit` at most, are PUBLISHED; a first time of publication is kept.

    articles: id, status, publishedAt, updatedAt, at. Equal times go by id. Only the ids of one promotion are sent round.
    """
    chosen = articles.where("status = 'READY'").orderBy(F.desc_nulls_last("at"), "id").limit(limit).select("id", F.lit(True).alias("up"))
    joined = articles.join(F.broadcast(chosen), "id", "left")  # `limit` rows
    up = F.coalesce("up", F.lit(False))
    new = {"status": F.when(up, "PUBLISHED").otherwise(F.col("status")), "publishedAt": F.when(up, F.coalesce("publishedAt", now)).otherwise(F.col("publishedAt")), "updatedAt": F.when(up, now).otherwise(F.col("updatedAt"))}
    return joined.withColumns(new).drop("up")


def reviewed(articles: DataFrame, decisions: DataFrame) -> DataFrame:
    """[T4] Articles after an editor's decisions (ref: id or slug, approve): held ones become READY or REJECTED; others stay, and of several decisions an approval counts."""
    held = F.col("status").isin("MEDICAL_REVIEW", "EDITORIAL_REVIEW")
    said = decisions.where("ref IS NOT NULL").groupBy("ref").agg(F.max("approve").alias("approve"))
    by_id, by_slug = said.withColumnsRenamed({"ref": "id", "approve": "a"}), said.withColumnsRenamed({"ref": "slug", "approve": "b"})
    joined = articles.join(by_id, "id", "left").join(by_slug, "slug", "left").withColumn("say", F.coalesce("a", "b"))
    return joined.withColumn("status", F.when(held & F.col("say"), "READY").when(held & ~F.col("say"), "REJECTED").otherwise(F.col("status"))).select(*articles.columns)


def after_runs(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """[T3] Each source after its latest run: status, last_status, last_error, failures, last_checked_at, last_success_at.

    sources: id, failures, last_success_at, last_checked_at, status; runs: source_id, started_at, http_status, error. 304 is NOT_MODIFIED and live, an error or any other status
    but 2xx a failure, 429 and 503 RATE_LIMITED. Runs are taken in order: failures count since the last good one. A source without a run stays.
    """
    ok = F.col("error").isNull() & (F.col("http_status").between(200, 299) | (F.col("http_status") == 304))
    r = runs.withColumn("ok", F.coalesce(ok, F.lit(False)))
    good = r.where("ok").groupBy("source_id").agg(F.max("started_at").alias("good_at"), F.max(F.when(F.col("http_status") != 304, F.col("started_at"))).alias("new_success"))
    last = r.groupBy("source_id").agg(F.max_by(F.struct("http_status", "error", "ok"), F.col("started_at")).alias("l"), F.max("started_at").alias("checked"))
    since = r.join(good, "source_id", "left").groupBy("source_id").agg(F.count_if(~F.col("ok") & (F.col("good_at").isNull() | (F.col("started_at") > F.col("good_at")))).alias("bad"), F.max(F.col("good_at").isNotNull()).alias("had_good"), F.max("new_success").alias("new_success"))
    j = sources.join(last, sources["id"] == last["source_id"], "left").drop("source_id").join(since, sources["id"] == since["source_id"], "left").drop("source_id")
    ran, fine = F.col("l").isNotNull(), F.coalesce(F.col("l.ok"), F.lit(False))
    return j.select(
        "id",
        F.when(~ran, F.col("status")).when(fine, "LIVE").when(F.col("l.http_status").isin(429, 503), "RATE_LIMITED").otherwise("FAILED").alias("status"),
        F.when(ran & fine & (F.col("l.http_status") == 304), "NOT_MODIFIED").when(ran & fine, "OK").when(ran, "FAILED").alias("last_status"),
        F.when(ran & ~fine, F.coalesce("l.error", F.concat(F.lit("HTTP "), F.col("l.http_status").cast("string")))).alias("last_error"),
        F.when(~ran, F.col("failures")).when(fine, 0).when(F.col("had_good"), F.col("bad")).otherwise(F.coalesce("failures", F.lit(0)) + F.col("bad")).cast("int").alias("failures"),
        F.coalesce("checked", "last_checked_at").alias("last_checked_at"),
        F.coalesce("new_success", "last_success_at").alias("last_success_at"),
    )


def merged_registry(registry: DataFrame, state: DataFrame) -> DataFrame:
    """[K16, J22] The declared sources over the stored ones: id, name, enabled, requires_config, status.

    What is declared wins; a source that has run keeps its status unless it needs configuration or is switched off, and a reset one becomes LIVE. Stored sources that are no
    longer declared stay as they are.
    """
    d = registry.select("id", F.col("name").alias("d_name"), F.coalesce("enabled", F.lit(True)).alias("d_on"), F.coalesce("requires_config", F.lit(False)).alias("d_conf"), F.lit(True).alias("declared")).dropDuplicates(["id"])
    j = d.join(state.select("id", "name", "enabled", "requires_config", "status"), "id", "full_outer")
    here = F.coalesce("declared", F.lit(False))
    idle = F.col("status").isNull() | F.col("status").isin("NEEDS_CONFIGURATION", "DISABLED")
    status = F.when(~here, F.col("status")).when(F.col("d_conf"), "NEEDS_CONFIGURATION").when(~F.col("d_on"), "DISABLED").when(idle, "LIVE").otherwise(F.col("status"))
    return j.select("id", F.when(here, F.col("d_name")).otherwise(F.col("name")).alias("name"), F.when(here, F.col("d_on")).otherwise(F.col("enabled")).alias("enabled"), F.when(here, F.col("d_conf")).otherwise(F.col("requires_config")).alias("requires_config"), status.alias("status"))


def disciplines(specialties: DataFrame) -> DataFrame:
    """[A19] (phrase, labels): what is left of specialties without rank and trailing brackets, with the sorted specialties of each.

    specialties: label, of at least five letters. A phrase has seven letters at least and is no general word, nor made of such alone.
    """
    bare = F.trim("label")
    for _ in range(2):
        bare = F.regexp_replace(bare, "(?i)^(" + "|".join(RANKS) + r")\s+", "")
    phrase = F.trim(T.entity_norm(F.trim(F.regexp_replace(bare, r"\s*\([^)]*\)\s*$", ""))))
    d = specialties.where("length(label) >= 5").select("label", phrase.alias("phrase"))
    telling = (F.length("phrase") >= 7) & F.exists(F.split("phrase", " "), lambda w: ~w.isin(*GENERAL))
    return d.where(telling).groupBy("phrase").agg(F.array_sort(F.collect_set("label")).alias("labels"))  # labels of a dictionary


def discipline_links(articles: DataFrame, specialties: DataFrame, linked: DataFrame, *, most: int = 8, labels: int = 4, per_term: int = 2) -> DataFrame:
    """[J11, W5, F21] (article_id, entity_id, method, confidence): specialties of the disciplines that a text names (0.62) or an everyday word stands for (0.55).

    articles: id, text; specialties: label; linked: article_id, entity_id of specialties that are linked already. Of each article `most` disciplines count, named ones first,
    by phrase; each gives its first labels. An everyday word stands for the first disciplines that have its part. Dictionaries are small and go round behind a count.
    """
    d = disciplines(specialties)
    named = feed.entity_links(articles, d.select(F.lit("discipline").alias("entity_type"), F.col("phrase").alias("entity_id"), F.col("phrase").alias("label")), letters={"discipline": 1}, most=most)
    named = named.select("article_id", F.col("entity_id").alias("phrase"), F.lit(0).alias("kind"), F.lit(0).alias("term"), F.lit(0).alias("k"))
    terms = F.array(*[F.struct(F.lit(i).alias("term"), F.lit(part).alias("part")) for i, (_, part) in enumerate(LAY_TERMS)])
    of_term = d.select("phrase", F.inline(F.filter(terms, lambda x: F.col("phrase").contains(x["part"]))))
    of_term = of_term.withColumn("k", F.row_number().over(Window.partitionBy("term").orderBy("phrase"))).where(F.col("k") <= per_term).select("term", "phrase", "k")
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike("(?i)" + p.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")), F.lit(i)) for i, (p, _) in enumerate(LAY_TERMS)]))
    lay = articles.select(F.col("id").alias("article_id"), F.explode(hits).alias("term")).join(bounded(of_term), "term").select("article_id", "phrase", F.lit(1).alias("kind"), "term", "k")
    unit = F.dense_rank().over(Window.partitionBy("article_id").orderBy("kind", F.when(F.col("kind") == 0, F.col("phrase")).otherwise(""), "term"))
    few = named.union(lay).withColumn("unit", unit).where(F.col("unit") <= most)
    wide = few.join(d, "phrase").select("article_id", "kind", "unit", "k", F.explode(F.slice("labels", 1, labels)).alias("entity_id"))
    first = wide.groupBy("article_id", "entity_id").agg(F.min(F.struct("unit", "kind")).alias("f")).join(linked.select("article_id", "entity_id"), ["article_id", "entity_id"], "left_anti")
    return first.select("article_id", "entity_id", F.when(F.col("f.kind") == 0, "discipline_match").otherwise("lay_term").alias("method"), F.when(F.col("f.kind") == 0, 0.62).otherwise(0.55).alias("confidence"))


def ambiguous_mentions(articles: DataFrame, people: DataFrame) -> DataFrame:
    """[A34, A18] (article_id, entity_id, label): names held by several people that a text has; noted with confidence 0, never linked. people: id, label."""
    p = people.withColumn("phrase", F.trim(T.entity_norm(F.col("label"))))
    shared = p.groupBy("phrase").agg(F.count_distinct("id").alias("n"), F.min("label").alias("label")).where("n > 1")
    phrases = shared.select(F.lit("doctor").alias("entity_type"), F.concat(F.lit("ambiguous:"), F.regexp_replace("phrase", " +", "-")).alias("entity_id"), "label")
    return feed.entity_links(articles, phrases, letters={"doctor": 1}, most=1_000_000).select("article_id", "entity_id", "label")


def public_articles(articles: DataFrame, entities: DataFrame) -> DataFrame:
    """[P37, J13, O25, K6, P38] Published articles as they go out: fields, entities of each kind by falling confidence (two decimals), ambiguous ones only counted, and all of it as JSON.

    entities: article_id, entity_type, entity_id, label, confidence; confidence 0 marks an ambiguous name. An article without entities stays.
    """
    sure = entities.where("confidence > 0").select("article_id", "entity_type", F.struct((-F.round("confidence", 2)).alias("order"), "label", "entity_id").alias("e"))
    # The caps of linking bound the list of one article and kind.
    per = sure.groupBy("article_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("entity_type") == t, F.col("e")))).alias(t) for t in ("specialty", "facility", "doctor")])
    noted = entities.where("confidence = 0").groupBy("article_id").agg(F.count(F.lit(1)).alias("ambiguous"))
    j = articles.where("status = 'PUBLISHED'").join(per, articles["id"] == per["article_id"], "left").drop("article_id").join(noted, articles["id"] == noted["article_id"], "left").drop("article_id")
    ids = lambda t: F.coalesce(F.transform(t, lambda x: x["entity_id"]), F.array().cast("array<string>"))
    names = lambda t, n: F.coalesce(F.transform(F.slice(t, 1, n), lambda x: x["label"]), F.array().cast("array<string>"))
    out = j.select(
        "id", "slug", "title", "category", F.col("contentType").alias("content_type"), F.coalesce("region", F.lit("global")).alias("region"), F.col("content").isNotNull().alias("has_full_content"),
        T.reading_minutes(F.coalesce("content", "summary", "excerpt")).alias("reading_minutes"), feed.usable_picture(F.col("image")).alias("image"), F.coalesce("ambiguous", F.lit(0)).alias("ambiguous_mentions"),
        ids("specialty").alias("specialty_ids"), ids("facility").alias("facility_ids"), ids("doctor").alias("doctor_ids"), names("specialty", 3).alias("card_specialties"), names("facility", 2).alias("card_facilities"),
    )
    return out.withColumn("json", F.to_json(F.struct(*out.columns)))


def cadence(sources: DataFrame) -> DataFrame:
    """[A22] One row: how often the busiest live source is asked, as text; NULL without a live source."""
    m = sources.where("enabled AND NOT coalesce(requiresConfig, false)").agg(F.min("scheduleMinutes").alias("m"))
    hours = F.concat(F.lit("Checked every "), (F.col("m") / 60).cast("int").cast("string"), F.lit(" hour"), F.when(F.col("m") == 60, "").otherwise("s"))
    return m.select(F.when(F.col("m") % 60 == 0, hours).otherwise(F.concat(F.lit("Checked every "), F.col("m").cast("string"), F.lit(" minutes"))).alias("cadence"))


def archive_summary(articles: DataFrame, sources: DataFrame, linked: DataFrame) -> DataFrame:
    """[K11, A23-A25, A22] (what, value) of the archive: assessed, published, of the region, contributing and live sources, linked articles, cadence. linked: article_id."""
    published = F.col("status") == "PUBLISHED"
    ids = linked.select(F.col("article_id").alias("id"), F.lit(True).alias("linked")).distinct()
    one = articles.join(ids, "id", "left").agg(
        F.count_if(F.col("status").isin("PUBLISHED", "EDITORIAL_REVIEW", "MEDICAL_REVIEW")).alias("assessed"), F.count_if(published).alias("published"), F.count_if(published & (F.col("region") == "uae")).alias("local"),
        F.count_distinct(F.when(published, F.col("sourceName"))).alias("contributing_sources"), F.count_if(published & F.coalesce("linked", F.lit(False))).alias("linked"),
    )
    live = sources.agg(F.count_if(F.col("enabled") & ~F.coalesce("requiresConfig", F.lit(False))).alias("live_sources"))
    long = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")) for c in df.columns])).alias("x")).select("x.*")
    return reduce(DataFrame.union, [long(one), long(live), long(cadence(sources))])


def blocks(articles: DataFrame) -> DataFrame:
    """[O17, U3] (block, place, id) of the front page: the twelve newest local and other articles and the six newest of research."""
    order = [F.desc_nulls_last("at"), F.asc("id")]
    far = F.coalesce(F.col("region") != "uae", F.lit(True))
    research = (F.col("contentType") == "research") | (F.col("category") == "research-and-insights")
    parts = []
    for name, test, n in (("local", F.col("region") == "uae", 12), ("global", far, 12), ("research", research, 6)):
        few = articles.where(F.coalesce(test, F.lit(False))).orderBy(*order).limit(n)
        parts.append(few.select(F.lit(name).alias("block"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("place"), "id"))
    return reduce(DataFrame.union, parts)


def latest_ignoring_dates(articles: DataFrame, **filters) -> DataFrame:
    """[A27] One row: the time of the newest article under all filters but the time window; NULL if there is none."""
    return feed.archive(articles, **filters, skip="since").agg(F.max("at").alias("latest"))


def offered(articles: DataFrame) -> DataFrame:
    """[P45] (what, value): sources and content types that occur, which are the ones offered as filters."""
    pair = F.explode(F.array(F.struct(F.lit("source").alias("what"), F.col("sourceName").alias("value")), F.struct(F.lit("type").alias("what"), F.col("contentType").alias("value"))))
    return articles.select(pair.alias("x")).select("x.*").where("value IS NOT NULL").distinct()


def sources_listed(sources: DataFrame) -> DataFrame:
    """[O20, K9] Sources by tier and id, with place; a registry of a few rows."""
    return sources.select("id", "name", "trustTier", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("trustTier", "id")).alias("place"))


def view_snapshot(counts: DataFrame) -> DataFrame:
    """[K10, F33] (slug, views, json) of counted pages of a valid name, one line each."""
    good = counts.where((F.col("views") > 0) & F.col("slug").rlike("^[a-z0-9_-]{4,120}$"))
    return good.select("slug", "views", F.to_json(F.struct("slug", "views")).alias("json"))
