"""The news feed: documents to items, classification, duplicates, entity links, archive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions import text as T
from ledgerline.functions.urls import canonical_url
from ledgerline.operators.joins import bounded
from ledgerline.operators.ranking import positions
from ledgerline.sources.lineage import written

# Patterns by which items are classified; the first category that matches wins.
PLACES = r"(?i)(?<![A-Za-z0-9_])(?:uae|u\.a\.e\.(?=\w)|emirat\w*|dubai|abu dhabi|sharjah|ajman|fujairah|ras al[- ]khaimah|umm al[- ]quwain|al ain)(?![A-Za-z0-9_])"
BODIES = (
    r"(?i)(?<![A-Za-z0-9_])(?:dha|dubai health authority|dubai health|doh|department of health\s*[-–—]?\s*abu dhabi|mohap|ministry of health and prevention|ehs|emirates health services|seha|"
    r"purehealth|pure health|m42|mubadala health|malaffi|riayati|daman|thiqa|nabidh|dubai academic health corporation|arab health)(?![A-Za-z0-9_])"
)
HEALTH = (
    r"(?i)health|hospital|clinic|patient|medical|medicine|physician|doctor|nurse|licens|regulat|treatment|care|therap|surg|vaccin|insur|pharma|screening|diagnos|wellbeing|well-being|wellness|"
    r"disease|cancer|oncolog|cardiac|cardio|p[ae]diatric|neonat|newborn|maternal|mental|psychiatr|diabet|transplant|organ donation|donor|biops|genom|genetic|life sciences|biotech|trial|ambulance|"
    r"emergency care|apnoea|apnea|anxiety|rehabilitation|nutrition|immunis|immuniz|epidemi|medicaid|telemedicine|telehealth|drug|medication"
)
CATEGORIES = [
    ("insurance", r"insur\w*|reimburse\w*|claims?|payer|coverage|copay|premium|daman|thiqa"),
    ("medical-tourism", r"medical tourism|health tourism|medical travel|inbound patients?"),
    ("healthcare-technology", r"digital health|telehealth|telemedicine|health tech|AI|artificial intelligence|machine learning|wearable|robotic|electronic health record|EHR|health informatics"),
    ("research-and-insights", r"stud(?:y|ies)|trial|clinical trial|research|findings|cohort|randomi[sz]ed|peer[- ]reviewed|journal|evidence"),
    ("doctors-and-clinics", r"clinic|hospital|physician|surgeon|nurse|practition\w*|facilit(?:y|ies)|accredit\w*|licens\w*"),
    ("health-and-wellness", r"wellness|nutrition|diet|exercise|lifestyle|mental health|well[- ]being|sleep|smoking|obesity"),
    ("medical-news", r"disease|outbreak|vaccin\w*|drug|treatment|therap\w*|patients?|health|medic\w*|cancer|diabet\w*|infect\w*"),
]
GENERIC = ("medical-news", "doctors-and-clinics", "health-and-wellness")
CLINICAL = r"dosage|dose|contraindicat\w*|adverse (?:event|reaction)|efficacy|indication|prescrib\w*|treatment protocol|clinical guidance|therapy|symptom|diagnos\w*|mortality|morbidity|side effects?"
RESEARCH = r"stud(?:y|ies)|trial|randomi[sz]ed|cohort|meta[- ]analysis|peer[- ]reviewed|journal|preprint|findings"
BREAKING = r"urgent|breaking|immediate(?:ly)?|recall|outbreak|emergency|alert|warning|suspend\w*|withdraw\w*"
# Picture addresses that are no picture of the item.
NO_PICTURE = r"(?i)(sprite|pixel|spacer|blank|1x1|avatar|logo|icon)"


def worded(pattern: str) -> str:
    """The pattern at word boundaries of plain ASCII, in any case."""
    return rf"(?i)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def _element(block: Column, *names: str) -> Column:
    """Body of the first element of that name, the first name that occurs."""
    found = [F.regexp_extract(block, rf"(?is)<{n}(?:\s[^>]*)?>(.*?)</{n}\s*>", 1) for n in names]
    return F.coalesce(*[F.nullif(F.trim(f), F.lit("")) for f in found])


def usable_picture(c: Column) -> Column:
    """[P35] An http(s) picture address, NULL if it looks like a sprite or a badge."""
    return F.when(c.rlike("(?i)^https?://") & ~F.regexp_replace(c, r"^https?://[^/]+", "").rlike(NO_PICTURE), c)


def items(documents: DataFrame, xml: str, base: str, keep: list[str]) -> DataFrame:
    """[S16, F12-F19, P36] Items of RSS and Atom documents, lenient: kept columns, pos, title, link, guid, excerpt, content_html, author, published_at, categories, image.

    Malformed documents give the items that can be read; an item without title or link is none. Columns of the source other than those kept are not read.
    """
    blocks = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<(item|entry)(?:\s[^>]*)?>(.*?)</\1\s*>"), F.lit(2))
    rows = documents.select(*keep, F.col(base).alias("_base"), F.posexplode(blocks).alias("pos", "b"))
    b = F.col("b")
    alternate = F.regexp_extract(b, r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']alternate["'])[^>]*\bhref\s*=\s*["']([^"']+)["']""", 1)
    any_link = F.regexp_extract(b, r"""(?is)<link\b[^>]*\bhref\s*=\s*["']([^"']+)["']""", 1)
    link = F.coalesce(T.stripped(_element(b, "link")), F.nullif(alternate, F.lit("")), F.nullif(any_link, F.lit("")))
    summary, body = _element(b, "description", "summary"), _element(b, "content:encoded", "content")
    clean = T.sanitised(T.decoded(F.coalesce(body, F.when(F.length(T.stripped(summary)) > 900, summary))), F.col("_base"))
    attr = lambda tag: F.nullif(F.regexp_extract(b, rf"""(?is)<{tag}\b[^>]*\burl\s*=\s*["']([^"']+)["']""", 1), F.lit(""))
    img = lambda c: F.nullif(F.regexp_extract(T.decoded(c), r"""(?is)<img\b[^>]*\bsrc\s*=\s*["']([^"']+)["']""", 1), F.lit(""))
    pictures = [usable_picture(T.absolute(x, F.col("_base"))) for x in (attr("enclosure"), attr("media:content"), attr("media:thumbnail"), img(summary), img(body))]
    out = rows.select(
        *keep,
        "pos",
        T.blank_to_null(T.stripped(_element(b, "title"))).alias("title"),
        T.absolute(T.decoded(link), F.col("_base")).alias("link"),
        T.blank_to_null(T.stripped(_element(b, "guid", "id"))).alias("guid"),
        F.nullif(F.substring(T.stripped(F.coalesce(summary, body)), 1, 600), F.lit("")).alias("excerpt"),
        F.when(F.length(T.stripped(clean)) >= 400, clean).alias("content_html"),
        T.blank_to_null(T.stripped(_element(b, "dc:creator", "author", "name"))).alias("author"),
        T.parsed_date(_element(b, "pubDate", "published", "updated", "dc:date")).alias("published_at"),
        F.slice(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(b, F.lit(r"(?is)<category\b[^>]*>(.*?)</category\s*>"), F.lit(1)), lambda x: T.stripped(x)), lambda x: x != "")), 1, 8).alias("categories"),
        F.coalesce(*pictures).alias("image"),
    )
    return out.where("title IS NOT NULL AND link IS NOT NULL")


def hashes(df: DataFrame, title: str, excerpt: str, source: str, url: str, guid: Column | None = None) -> DataFrame:
    """[F7, F9-F11] df with canonical_url, normalized_title, source_hash, content_hash and story_key."""
    address = canonical_url(F.col(url))
    return df.withColumns(
        {
            "canonical_url": address,
            "normalized_title": T.normalized_title(F.col(title)),
            "source_hash": T.source_hash(F.col(source), guid if guid is not None else F.lit(None).cast("string"), address),
            "content_hash": T.content_hash(F.col(title), F.col(excerpt)),
            "story_key": T.story_key(F.col(title)),
        }
    )


def classified(df: DataFrame, text: Column, default: Column, region: Column) -> DataFrame:
    """[C2-C5, F22] df with category, content_type, item_region and clinical."""
    places, health = F.regexp_count(text, F.lit(PLACES)), text.rlike(HEALTH)
    local = health & (text.rlike(BODIES) | (places >= 2) | ((places >= 1) & (region == "uae")))
    local = F.coalesce(local, F.lit(False))
    ruled = F.coalesce(*[F.when(text.rlike(worded(p)), F.lit(name)) for name, p in CATEGORIES], default, F.lit("medical-news"))
    clinical = F.coalesce(text.rlike(worded(CLINICAL)), F.lit(False))
    kind = F.when(clinical, "medical").when(text.rlike(worded(RESEARCH)), "research").when(text.rlike(worded(BREAKING)), "breaking-news").otherwise("news")
    return df.withColumns(
        {"category": F.when(local & ruled.isin(*GENERIC), "uae-healthcare-news").otherwise(ruled), "content_type": kind, "item_region": F.when(local, "uae").when(region == "gcc", "gcc").otherwise("global"), "clinical": clinical}
    )


def duplicate_of(new: DataFrame, old: DataFrame) -> DataFrame:
    """[J12] (id, duplicate_of, reason) of new items against stored ones by five ordered keys, the first that hits deciding.

    new, old: id, source_id, canonical_url, source_hash, content_hash, normalized_title, story_key, at. Titles must lie less than a day apart, stories of
    other sources less than two. The earliest stored row (by id) is named. Each key is one equi-join; a stored key is reduced to what can be named before
    it is joined, so that a hot key meets a new item as one row (a hot title or story: as one row a time).
    """
    parts = []
    for rank, reason, key in ((1, "canonical_url", "canonical_url"), (2, "source_hash", "source_hash"), (3, "content_hash", "content_hash")):
        first = old.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("duplicate_of"))
        parts.append(new.join(first, key).select("id", "duplicate_of", F.lit(rank).alias("rank"), F.lit(reason).alias("reason")))
    for rank, reason, key, days in ((4, "normalized_title", "normalized_title", 1), (5, "same_story", "story_key", 2)):
        # The time is cut into buckets as wide as the reach, so a hot key is parted by time and the join stays an equality.
        width = days * 86_400
        bucket = F.floor(F.unix_timestamp("at") / width)
        stored = old.where(F.col(key).isNotNull() & (F.col(key) != "") & F.col("at").isNotNull()).select(F.col(key).alias("k"), F.col("id").alias("duplicate_of"), F.col("at").alias("old_at"), F.col("source_id").alias("old_source"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("t"))
        near = new.withColumn("t", bucket).withColumnRenamed(key, "k").join(stored, ["k", "t"])
        near = near.where(F.abs(F.unix_micros("at") - F.unix_micros("old_at")) < width * 1_000_000)
        near = near.where(F.col("source_id") != F.col("old_source")) if rank == 5 else near
        parts.append(near.select("id", "duplicate_of", F.lit(rank).alias("rank"), F.lit(reason).alias("reason")))
    every = reduce(DataFrame.union, parts)
    return every.groupBy("id").agg(F.min(F.struct("rank", "duplicate_of", "reason")).alias("b")).select("id", "b.duplicate_of", "b.reason")


def entity_links(articles: DataFrame, phrases: DataFrame, *, letters: dict[str, int] | None = None, shared: tuple[str, ...] = (), most: int = 8) -> DataFrame:
    """[J10, and of W5 and F21 the part of whole phrases] (article_id, entity_type, entity_id, label, confidence) where an article's text holds a phrase as whole words.

    articles: id, text; phrases: entity_type, entity_id, label, of which those of at least eight letters (or letters[entity_type]) are looked for, with any number of
    words; a phrase that means several entities of a type is ambiguous and left out, but for the types in `shared`, where it links them all. Texts are cut into runs of words that meet the phrases in an equi-join, never pair by pair. Of each type the
    `most` first labels of an article stay, as the feature wants it.
    """
    p = phrases.select("entity_type", "entity_id", "label", F.trim(T.entity_norm(F.col("label"))).alias("phrase"))
    enough = F.coalesce(*[F.when(F.col("entity_type") == t, n) for t, n in (letters or {}).items()], F.lit(8))
    p = p.where((F.length("phrase") >= enough) & (F.col("phrase") != "")).distinct()
    several = F.col("entity_type").isin(*shared) if shared else F.lit(False)
    alone = p.where(~several).groupBy("entity_type", "phrase").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id"), F.min("label").alias("label")).where("n = 1")
    sole = alone.select("entity_type", "entity_id", "label", "phrase").union(p.where(several))
    words = articles.select(F.col("id").alias("article_id"), F.split(F.trim(T.entity_norm(F.col("text"))), " ").alias("w"))
    first = sole.select(F.substring_index("phrase", " ", 1).alias("head"), F.size(F.split("phrase", " ")).alias("n")).distinct()
    # Single words meet the phrases' first words alone; only the few places found go back to their texts.
    # First words are a dictionary: sent round behind a count, so that no word of a text is shuffled.
    start = words.select("article_id", F.posexplode("w").alias("i", "head")).join(bounded(written(first, "heads")), "head").select("article_id", "i", "n").distinct()
    runs = start.join(words, "article_id").select("article_id", F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ").alias("phrase")).distinct()
    found = runs.join(sole, "phrase").select("article_id", "entity_type", "entity_id", "label", F.least(F.lit(1.0), F.lit(0.55) + F.least(F.length("phrase"), F.lit(60)) / 120).alias("confidence")).dropDuplicates(["article_id", "entity_type", "entity_id"])
    rank = F.row_number().over(Window.partitionBy("article_id", "entity_type").orderBy("label", "entity_id"))
    return found.withColumn("n", rank).where(F.col("n") <= most).drop("n")


def due_sources(sources: DataFrame, now: Column) -> DataFrame:
    """[P34, T6] Sources to be asked now: enabled ones with an address, never asked or asked long enough ago; failures double the wait up to a day."""
    wait = F.least(F.col("scheduleMinutes") * 60 * F.pow(F.lit(2.0), F.least(F.coalesce("consecutiveFailures", F.lit(0)), F.lit(6))), F.lit(86_400.0))
    ready = F.col("enabled") & ~F.coalesce("requiresConfig", F.lit(False)) & F.col("feedUrl").isNotNull()
    return sources.where(ready & (F.col("lastCheckedAt").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("lastCheckedAt") >= wait)))


def archive(articles: DataFrame, *, category: str | None = None, kind: str | None = None, source: str | None = None, since: Column | None = None, words: str = "", skip: str | None = None) -> DataFrame:
    """[P32] Articles under the chosen filters, any one of which can be skipped; an undated one is in no time window."""
    hay = T.archive_fold(F.concat_ws(" ", "title", "summary", "sourceName", "category"))
    tests = {
        "category": F.col("category") == category if category else None,
        "kind": F.col("contentType") == kind if kind else None,
        "source": F.col("sourceName") == source if source else None,
        "since": F.col("at") >= since if since is not None else None,
        "words": reduce(lambda a, b: a & b, [hay.contains(w) for w in words.lower().split()]) if words.strip() else None,
    }
    on = [t for k, t in tests.items() if t is not None and k != skip]
    return articles.where(reduce(lambda a, b: a & b, on)) if on else articles


def paged(articles: DataFrame, size: int = 12) -> DataFrame:
    """[W6, K5, O18] id, at, page and place of each article, newest first."""
    order = [F.desc_nulls_last("at"), F.asc("id")]
    ranked = positions(articles.select("id", "at"), order)
    return ranked.select("id", "at", F.ceil(F.col("pos") / size).cast("int").alias("page"), "pos")


def featured(articles: DataFrame, n: int = 5) -> DataFrame:
    """[O16, O17, U4] The n newest local articles, topped up by the newest others; the lead is the first of the best four that has a picture."""
    order = [F.desc_nulls_last("at"), F.asc("id")]
    near, far = F.col("region") == "uae", F.coalesce(F.col("region") != "uae", F.lit(True))
    top = [articles.where(c).orderBy(*order).limit(n).select("id", "at", "image", F.lit(k).alias("part")) for k, c in ((0, near), (1, far))]
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("part", *order))  # 2 n rows
    few = top[0].union(top[1]).withColumn("rank", rank).where(F.col("rank") <= n)
    lead = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy((F.col("rank") > 4), F.col("image").isNull(), "rank"))
    return few.withColumn("lead", lead == 1).select("id", "rank", "lead")


def view_counts(events: DataFrame, slug: str, client: str, at: str, hours: int = 12) -> DataFrame:
    """[W8, A32, T5] (slug, views, first_view, last_view): a client's view of a page counts once until more than so many hours after the last counted one.

    The gate is folded over each client's own times of one page, the one place where order matters; totals are aggregated from the folds.
    """
    gap = hours * 3_600_000_000
    times = events.where(F.col(slug).isNotNull() & F.col(client).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(slug).alias("slug"), F.col(client).alias("client")).agg(F.array_sort(F.collect_list(F.unix_micros(F.col(at).cast("timestamp")))).alias("ts"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("last"))
    def step(s: Column, t: Column) -> Column:
        counts = s["last"].isNull() | (t - s["last"] > gap)
        return F.struct((s["n"] + counts.cast("long")).alias("n"), F.when(counts, t).otherwise(s["last"]).alias("last"))
    gated = times.select("slug", F.aggregate("ts", start, step).alias("s"), F.get("ts", F.lit(0)).alias("first"))
    return gated.groupBy("slug").agg(F.sum("s.n").alias("views"), F.timestamp_micros(F.min("first")).alias("first_view"), F.timestamp_micros(F.max("s.last")).alias("last_view"))


def related(articles: DataFrame, n: int = 4) -> DataFrame:
    """[J14] (id, other, rank): for each article the n newest others of its category.

    Only each category's n + 1 newest can be named, so an article meets n + 1 rows and no pairs of a category are made.
    """
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc_nulls_last("at"), "id"))
    best = articles.select("id", "category", "at").withColumn("k", rank).where(F.col("k") <= n + 1).select("category", F.col("id").alias("other"), "k")
    met = articles.select("id", "category").join(bounded(written(best, "newest")), "category").where("id <> other")
    place = F.row_number().over(Window.partitionBy("id").orderBy("k"))
    return met.withColumn("rank", place).where(F.col("rank") <= n).select("id", "other", "rank")
