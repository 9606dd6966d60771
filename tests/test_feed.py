import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from ledgerline.operators import feed, ingest
from ledgerline.streaming import ingest as stream_ingest
from ledgerline.streaming import views

T0 = dt.datetime(2024, 3, 1)


def test_items_of_lenient_documents(spark):
    rss = """<rss><channel><item><title><![CDATA[A & B]]></title><link>/x?utm_source=f</link><guid>g1</guid><description>&lt;p&gt;Hello&lt;/p&gt; <img src="https://e.org/i.png"></description>
    <pubDate>Tue, 05 Mar 2024 10:20:30 GMT</pubDate><category>News</category><category>News</category></item><item><title>no link</title></item>
    <item><title>C<link>https://e.org/c</link></title><link>https://e.org/c</link></item></channel>"""
    atom = '<feed><entry><title type="html">D</title><link rel="self" href="https://e.org/s"/><link rel="alternate" href="https://e.org/d"/><id>g2</id><summary>s</summary><updated>2024-03-05T10:20:30Z</updated></entry></feed>'
    df = spark.createDataFrame([("s", "https://e.org/feed.xml", rss), ("t", "https://e.org/a.xml", atom), ("u", "https://e.org/b.xml", "<broken"), ("v", None, None)], "source_id string, base string, xml string")
    rows = {r.title: r for r in feed.items(df, "xml", "base", ["source_id"]).collect()}
    assert rows["A & B"].link == "https://e.org/x?utm_source=f" and rows["A & B"].excerpt == "Hello" and rows["A & B"].image == "https://e.org/i.png" and rows["A & B"].categories == ["News"]
    assert rows["D"].link == "https://e.org/d" and rows["D"].published_at == dt.datetime(2024, 3, 5, 10, 20, 30) and "no link" not in rows
    got = feed.hashes(feed.items(df, "xml", "base", ["source_id"]), "title", "excerpt", "source_id", "link", F.col("guid")).where("title = 'A & B'").first()
    assert got.canonical_url == "https://e.org/x" and len(got.source_hash) == 64


def test_classification(spark):
    rows = [("Dubai hospital opens in Dubai", None), ("Dubai hospital opens", None), ("Dubai hospital opens", "uae"), ("Insurance coverage for telemedicine", None), ("FDA warning: study of drug dosage", "gcc"), (None, None)]
    out = feed.classified(spark.createDataFrame(rows, "t string, r string"), F.col("t"), F.lit(None).cast("string"), F.col("r")).collect()
    assert [r.item_region for r in out] == ["uae", "global", "uae", "global", "gcc", "global"]
    assert out[0].category == "uae-healthcare-news" and out[1].category == "doctors-and-clinics" and out[3].category == "insurance" and out[5].category == "medical-news"
    assert out[4].content_type == "medical" and out[4].clinical and not out[0].clinical


def item(i, seq, at=0.0, source="s", **k):
    base = {"canonical_url": f"u{i}", "source_hash": f"g{i}", "content_hash": f"c{i}", "normalized_title": f"t{i}", "story_key": f"k{i}"} | k
    return {"id": i, "source_id": source, "seq": seq, "at": T0 + dt.timedelta(hours=at), **base}


ROWS = [
    item("A", 1, source_hash="g1", canonical_url="u1"),
    item("B", 2, canonical_url="u1", source_hash="g2", content_hash="cb"),
    item("C", 3, source_hash="g2"),
    item("D", 4, content_hash="cb"),
    item("E", 5, content_hash="cA", normalized_title="tA", at=72),
    item("F", 6, normalized_title="tC", at=24),
    item("G", 7, normalized_title="tC", at=23.98),
    item("H", 8, source="z", story_key="kC", at=30),
    item("I", 9, source="s", story_key="kC", at=1),
    item("J", 10, canonical_url=None, source_hash=None, content_hash=None, normalized_title=None, story_key=None),
]


def test_greedy_play(spark):
    got = {r["id"]: r for r in ingest.replay([], ROWS)}
    assert {i: r["decision"] for i, r in got.items()} == dict(A="new", B="duplicate", C="new", D="duplicate", E="new", F="new", G="duplicate", H="new", I="new", J="new")
    assert got["B"]["reason"] == "canonical_url" and got["D"]["duplicate_of"] == "A" and got["H"]["story_id"] == "C" and got["I"]["story_id"] == "C"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in ingest.ITEM.split(", ")) for r in ROWS], ingest.ITEM)
    none = df.limit(0).withColumn("story_id", F.lit(None).cast("string"))
    whole = {r.id: (r.decision, r.duplicate_of, r.story_id) for r in ingest.decide(df, none).collect()}
    assert whole == {i: (r["decision"], r["duplicate_of"], r["story_id"]) for i, r in got.items()}
    # The same in two batches with the store between them.
    first = df.where("seq <= 3")
    store = ingest.merged(none, first, ingest.decide(first, none)).cache()
    rest = df.where("seq > 3")
    later = {r.id: (r.decision, r.duplicate_of) for r in ingest.decide(rest, store).collect()}
    assert later == {i: v[:2] for i, v in whole.items() if i in later} and len(later) == 7
    assert ingest.run_summary(ingest.decide(df, none), df).where("source_id = 's'").first().seen == 9


def test_stream_equals_batch(spark, tmp_path):
    def rss(n, title):
        return f"<rss><item><title>{title}</title><link>https://e.org/{n}</link><guid>{n}</guid><description>text {title}</description></item></rss>"

    docs = [("a", "2024-03-01T00:00:00Z", "https://e.org/f", rss(1, "First report of something")), ("b", "2024-03-01T01:00:00Z", "https://e.org/f", rss(1, "First report of something again")), ("a", "2024-03-02T00:00:00Z", "https://e.org/f", rss(2, "Quite another matter"))]
    (tmp_path / "in").mkdir()
    store = stream_ingest.FeedStore(spark, str(tmp_path / "store"))
    for k, d in enumerate(docs):
        pd.DataFrame([d], columns=["source_id", "fetched_at", "base_url", "xml"]).to_json(tmp_path / "in" / f"{k}.json", orient="records", lines=True)
        q = stream_ingest.start(spark, str(tmp_path / "in"), store, str(tmp_path / "cp"))
        q.awaitTermination()
    assert sorted(r.canonical_url for r in store.read().collect()) == ["https://e.org/1", "https://e.org/2"]
    all_docs = spark.createDataFrame([(a, pd.Timestamp(b).to_pydatetime(), c, d) for a, b, c, d in docs], stream_ingest.DOCUMENT)
    decided = ingest.decide(stream_ingest.items_of(all_docs), spark.createDataFrame([], ingest.ITEM + ", story_id string"))
    assert decided.where("decision = 'new'").count() == 2


def test_view_gate_batch_and_stream(spark, tmp_path):
    times = [0, 6, 12, 12 + 1 / 3_600_000, 18]
    rows = [("p", "c", T0 + dt.timedelta(hours=h)) for h in times] + [("p", "d", T0), ("q", "c", T0), (None, "c", T0), ("p", None, T0)]
    df = spark.createDataFrame(rows, "slug string, client string, at timestamp")
    got = {r.slug: r.views for r in feed.view_counts(df, "slug", "client", "at").collect()}
    assert got == {"p": 3, "q": 1}
    # A view that lies beyond all others makes the earlier ones certain; a late one within the hour is judged in its order.
    end = spark.createDataFrame([("z", "z", T0 + dt.timedelta(days=30))], df.schema)
    (tmp_path / "in").mkdir()
    late = spark.createDataFrame([("l", "c", T0 + dt.timedelta(hours=20, minutes=30))], df.schema)
    for n, part in enumerate((df.union(late), spark.createDataFrame([("l", "c", T0 + dt.timedelta(hours=20)), ("l", "c", T0 + dt.timedelta(hours=32, minutes=15))], df.schema), end)):
        part.toPandas().to_parquet(tmp_path / "in" / f"{n}.parquet", coerce_timestamps="us")
    got |= {"l": 2}
    q = views.counted_views(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in")), "slug", "client", "at").writeStream.format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.slug: r.n for r in spark.sql("SELECT slug, count(*) AS n FROM counted WHERE slug <> 'z' GROUP BY slug").collect()} == got


def test_entities_archive_and_due(spark):
    arts = spark.createDataFrame([("1", "New unit at Prime Paediatric Hospital, near Al Noor."), ("2", None)], "id string, text string")
    phr = spark.createDataFrame([("f", "x", "Prime Pediatric Hospital"), ("f", "y", "Al Noor"), ("f", "z", "Noor"), ("p", "a", "New Unit At"), ("p", "b", "new unit at")], "entity_type string, entity_id string, label string")
    assert [(r.article_id, r.entity_id) for r in feed.entity_links(arts, phr).collect()] == [("1", "x")]
    src = spark.createDataFrame([("new", 60, 0, True, False, "u", None), ("soon", 60, 0, True, False, "u", T0 - dt.timedelta(minutes=59)), ("late", 60, 0, True, False, "u", T0 - dt.timedelta(minutes=60)), ("fails", 60, 3, True, False, "u", T0 - dt.timedelta(hours=7)), ("day", 6000, 9, True, None, "u", T0 - dt.timedelta(hours=24)), ("off", 60, 0, False, False, "u", None), ("none", 60, 0, True, False, None, None)], "id string, scheduleMinutes int, consecutiveFailures int, enabled boolean, requiresConfig boolean, feedUrl string, lastCheckedAt timestamp")
    assert {r.id for r in feed.due_sources(src, F.lit(T0)).collect()} == {"new", "late", "day"}


def test_entities_of_any_number_of_words_and_shared_phrases(spark):
    name = "The Very Long Named Hospital Of Nine Words"
    arts = spark.createDataFrame([("1", f"Visit {name}. A paediatrics ward; Nurse.")], "id string, text string")
    phr = spark.createDataFrame([("facility", "x", name), ("specialty", "Pediatrics", "Pediatrics"), ("specialty", "Paediatrics", "Paediatrics"), ("specialty", "Nurse", "Nurse")], "entity_type string, entity_id string, label string")
    got = feed.entity_links(arts, phr, letters={"specialty": 1}, shared=("specialty",)).collect()
    assert {(r.entity_type, r.entity_id) for r in got} == {("facility", "x"), ("specialty", "Pediatrics"), ("specialty", "Paediatrics"), ("specialty", "Nurse")}


def test_store_keeps_and_replaces_what_items_hold(spark):
    form = f"{ingest.ITEM}, {ingest.PAYLOAD}"
    row = lambda i, seq, h, excerpt, body, image: (i, "s", seq, "u", "sh", h, "t", "k", T0, "l", "T", excerpt, body, "A", ["N"], image)
    items = spark.createDataFrame([row("a", 1, "h1", "old", "long", "i.png"), row("b", 2, "h2", "mid", "m", "j.png"), row("c", 3, "h3", "new", None, None)], form)
    decisions = spark.createDataFrame([("a", "new", None, None, "a", None), ("b", "duplicate", "a", "canonical_url", "a", "h2"), ("c", "duplicate", "a", "canonical_url", "a", "h3")], ingest.DECISION)
    none = spark.createDataFrame([], ingest.STORED)
    first = ingest.merged(none, items.limit(1), decisions.where("id = 'a'")).first()
    assert (first.link, first.title, first.excerpt, first.content_html, first.author, first.categories, first.image) == ("l", "T", "old", "long", "A", ["N"], "i.png")
    then = ingest.merged(none, items, decisions).collect()
    assert [(r.content_hash, r.excerpt, r.content_html, r.image, r.author) for r in then] == [("h3", "new", None, "j.png", "A")]
    assert {c.split()[0] for c in ingest.PAYLOAD.split(", ")} <= set(stream_ingest.items_of(spark.createDataFrame([], stream_ingest.DOCUMENT)).columns)
