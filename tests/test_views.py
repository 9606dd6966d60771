"""Views and newsroom operators on small tables with NULLs, ties, repeats and nothing at all."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import directory as D
from ledgerline.operators import joins, newsroom
from ledgerline.operators import views as V
from ledgerline.sources import lineage, snapshots, tables

T0 = dt.datetime(2024, 3, 1)


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first().c


def test_labels_and_coordinates(spark):
    assert [one(spark, V.type_label(F.lit(x))) for x in ("hospital", "unheard of", "", None)] == ["Hospital", "unheard of", "Other healthcare provider", "Other healthcare provider"]
    assert [one(spark, V.specialty_label(F.lit(x))) for x in ("Consultant Ophthalmology", "Otolaryngology - ENT", "Orthodontics", None)] == ["Consultant Ophthalmology - Eye", "Otolaryngology - ENT", "Orthodontics", None]
    good = one(spark, V.coordinates(F.lit("25.5"), F.lit(55.25)))
    assert (good.lat, good.lng, round(good.west, 3)) == (25.5, 55.25, 55.246)
    for lat, lng in ((0.0, 0.0), (91.0, 1.0), (1.0, -181.0), (None, 1.0), (float("nan"), 1.0)):
        assert one(spark, V.coordinates(F.lit(lat).cast("double"), F.lit(lng))) is None
    assert one(spark, V.place_text(F.lit("a"), F.lit(None).cast("string"), F.lit(""), F.lit("a"), F.lit("b"))) == "a, b"
    assert one(spark, V.valid_slug(F.lit("abc"))) is False and one(spark, V.valid_slug(F.lit("abc-1"))) is True and one(spark, V.valid_slug(F.lit(None).cast("string"))) is False
    assert len(one(spark, V.client_key(F.lit("1.2.3.4"), F.lit(None).cast("string")))) == 16
    assert [one(spark, V.view_figure(F.lit(a).cast("int"), F.lit(b).cast("int"))) for a, b in ((3, 1), (None, 2), (0, 5), (None, None))] == [3, 2, None, None]
    assert one(spark, V.licence_badge(F.lit("Full-time License"))) == "FTL" and one(spark, V.specialty_route(F.lit("A & B"))) == "/?smode=professionals&spec=A%20%26%20B"
    assert one(spark, V.doctor_route(F.lit("1/2"))) == "/#/doctor/1%2F2" and one(spark, V.facility_route(F.lit("f"))) == "/#/facility/f"


def test_contacts_and_lists(spark):
    none = F.lit(None).cast("string")
    rows = one(spark, V.contact_channels(F.lit("+1 (2) 3"), none, F.lit("A@x.org"), F.lit(" "), F.lit('{"secondary_email": "a@X.org", "twitter": "@me", "contact_details_office_number": "44"}')))
    assert [(r.kind, r.value, r.href) for r in rows] == [("phone", "+1 (2) 3", "tel:+123"), ("phone2", "44", "tel:44"), ("email", "A@x.org", "mailto:A@x.org"), ("twitter", "@me", "https://x.com/me")]
    assert one(spark, V.contact_channels(none, none, none, none, F.lit("{broken"))) == []
    assert [r.href for r in one(spark, V.facility_contacts(none, none, F.lit("www.x.org"), none))] == ["https://www.x.org"]
    assert one(spark, V.add_on_names(F.lit('[{"name": "A"}, "B", {"x": 1}]'), F.lit('["C"]'))) == ["A", "B"]
    assert one(spark, V.add_on_names(F.lit("[]"), F.lit('["C"]'))) == ["C"] and one(spark, V.add_on_names(none, F.lit("bad"))) == []
    a = one(spark, V.accreditation(F.lit(""), F.lit("Body"), F.lit("2024-01-02T00"), none))
    assert (a.headline, a.body, a.days) == ("Body", None, "2024-01-02")
    entry = F.struct(F.lit("Uni").alias("institution"), F.lit("MD").alias("qualification"), F.lit(None).cast("string").alias("heading"))
    assert tuple(one(spark, V.education_lines(entry))) == ("Uni", "MD")


PEOPLE = "id string, name string, name_folded string, specialty_folded string, category_folded string, nationality string, linked_facilities array<string>, facilities_folded array<string>, facility_types array<string>"


def test_facility_list(spark):
    rows = [("1", "Akram", "akram", "", "", "India", ["Akram Clinic", "City Pharmacy"], ["akram clinic", "city pharmacy"], ["clinic", "pharmacy"]), ("2", "Bo", "bo", "", "", None, ["City Pharmacy"], ["city pharmacy"], ["pharmacy"]), ("3", None, "", "", "", "Egypt", [], [], [])]
    people = spark.createDataFrame(rows, PEOPLE)
    places = spark.createDataFrame([("Akram Clinic", "clinic"), ("City Pharmacy", "pharmacy"), ("City Pharmacy", "pharmacy"), ("Empty Clinic", "clinic"), (None, "clinic")], "facility string, type string")
    show = lambda q: [(r.facility, r.doctor_count, r.matching) for r in V.facility_list(people, places, q).collect()]
    assert show(D.DirectoryQuery()) == [("City Pharmacy", 2, 2), ("Akram Clinic", 1, 1)]
    assert show(D.DirectoryQuery(q="bo", mode="facilities")) == []  # a person's name leads to no facility
    assert show(D.DirectoryQuery(q="clinic", mode="facilities")) == [("Akram Clinic", 1, 1), ("Empty Clinic", 0, None)]
    assert show(D.DirectoryQuery(q="clinic", mode="facilities", chosen={"nationality": ("India",)})) == [("Akram Clinic", 1, 1)]
    assert show(D.DirectoryQuery(chosen={"nationality": ("India",)}, sort="name-desc")) == [("City Pharmacy", 2, 1), ("Akram Clinic", 1, 1)]
    assert V.facility_list(people.limit(0), places, D.DirectoryQuery()).count() == 0


def test_options(spark):
    counts = spark.createDataFrame([("specialty", "Dental", 9), ("specialty", "Otolaryngology", 2), ("specialty", "Entomology", 1), ("category", "ENT", 4)], "facet string, label string, cnt long")
    got = V.filter_options(counts, "specialty", search="ent").orderBy("place").collect()
    assert [r.label for r in got] == ["Otolaryngology", "Entomology", "Dental"]
    got = V.filter_options(counts, "specialty", selected=("Entomology", "Gone"), first=1).orderBy("place").collect()
    assert [(r.label, r.cnt, r.pinned) for r in got] == [("Entomology", 1, True), ("Gone", 0, True), ("Dental", 9, False)]
    assert [(r.label, r.col, r.row) for r in V.in_columns(V.ranked_top(counts.where("facet = 'specialty'").select("label", "cnt"), [F.desc("cnt")], 3), 2, 3).orderBy("place").collect()] == [("Dental", 0, 0), ("Otolaryngology", 0, 1), ("Entomology", 1, 0)]


def test_newsroom_edges(spark):
    form = "id string, slug string, status string, publishedAt timestamp, updatedAt timestamp, at timestamp"
    arts = spark.createDataFrame([("a", "s", "READY", None, T0, None), ("b", "s", "READY", T0, T0, T0), ("c", None, "MEDICAL_REVIEW", None, None, T0), ("d", "x", "EDITORIAL_REVIEW", None, None, None)], form)
    now = F.lit("2024-05-01 00:00:00").cast("timestamp")
    out = {r.id: (r.status, r.publishedAt) for r in newsroom.promoted(arts, now, 1).collect()}
    assert out["b"] == ("PUBLISHED", T0) and out["a"][0] == "READY"
    said = spark.createDataFrame([("c", True), ("x", False), ("a", True), (None, True)], "ref string, approve boolean")
    assert {r.id: r.status for r in newsroom.reviewed(arts, said).collect()} == {"a": "READY", "b": "READY", "c": "READY", "d": "REJECTED"}
    gate = newsroom.review_gate(spark.createDataFrame([(True, 1), (False, 2), (None, 3), (False, None)], "c boolean, t int"), F.col("c"), F.col("t")).collect()
    assert [r.gate for r in gate] == ["MEDICAL_REVIEW", "READY", "EDITORIAL_REVIEW", "EDITORIAL_REVIEW"]
    src = spark.createDataFrame([("a", 2, None, None, "LIVE"), ("b", None, None, None, None)], "id string, failures int, last_success_at timestamp, last_checked_at timestamp, status string")
    runs = spark.createDataFrame([("a", T0, 500, None), ("a", T0 + dt.timedelta(hours=1), 200, "cut off")], "source_id string, started_at timestamp, http_status int, error string")
    got = {r.id: r for r in newsroom.after_runs(src, runs).collect()}
    assert (got["a"].status, got["a"].failures, got["a"].last_error) == ("FAILED", 4, "cut off") and got["b"].status is None and got["b"].last_status is None
    labels = spark.createDataFrame([("Consultant Medical Oncology (Adult)",), ("Specialist Oncology",), ("General Surgery",), ("Nurse",), ("Registered Nurse",), (None,)], "label string")
    assert {r.phrase: r.labels for r in newsroom.disciplines(labels).collect()} == {"medical oncology": ["Consultant Medical Oncology (Adult)"], "oncology": ["Specialist Oncology"]}
    texts = spark.createDataFrame([("1", "New cancer unit"), ("2", "The oncology ward"), ("3", None), ("4", "")], "id string, text string")
    links = newsroom.discipline_links(texts, labels, spark.createDataFrame([("2", "Specialist Oncology")], "article_id string, entity_id string")).collect()
    assert {(r.article_id, r.entity_id, r.method) for r in links} == {("1", "Consultant Medical Oncology (Adult)", "lay_term"), ("1", "Specialist Oncology", "lay_term"), ("2", "Consultant Medical Oncology (Adult)", "lay_term")}
    names = spark.createDataFrame([("1", "Omar Khan Ali"), ("2", "OMAR KHAN ALI"), ("3", "Only One Here")], "id string, label string")
    seen = spark.createDataFrame([("n", "dr omar khan ali and only one here")], "id string, text string")
    assert [(r.article_id, r.entity_id) for r in newsroom.ambiguous_mentions(seen, names).collect()] == [("n", "ambiguous:omar-khan-ali")]


def test_pages_and_schemas(spark, tmp_path):
    df = spark.createDataFrame([(i, f"s{i}", i // 12 + 1) for i in range(30)], "id int, slug string, page int")
    snapshots.write_pages(df, str(tmp_path / "pages"))
    read = lambda n: sorted(r.id for r in snapshots.read_page(spark, str(tmp_path / "pages"), n, "id int, slug string").collect())
    assert read(2) == list(range(12, 24)) and read(3) == list(range(24, 30)) and read(9) == []
    gone = snapshots.stale(df.select("slug"), df.where("id < 28").select("slug"), "slug")
    assert sorted(r.slug for r in gone.collect()) == ["s28", "s29"]
    loose = tables.tolerant(df.select("id", "slug"), {"slug": "string", "id": "long", "new": "timestamp"})
    assert dict(loose.dtypes) == {"slug": "string", "id": "bigint", "new": "timestamp"} and loose.where("new IS NOT NULL").count() == 0
    wide = tables.widened(df, {"id": "long", "status": "string"})
    assert wide.columns == ["id", "slug", "page", "status"] and dict(wide.dtypes)["id"] == "int"


def test_broadcasting_beyond_the_bound_is_a_shuffle_with_the_same_rows(spark):
    few = lineage.written(spark.range(50).withColumn("x", F.col("id") * 2), "few")
    many = spark.range(200)
    plans = []
    for rows in (100, 0):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            df = many.join(joins.bounded(few, rows), "id")
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            assert sorted(r.x for r in df.collect()) == [2 * i for i in range(50)]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1]


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Nothing:
        def isDefined(self):
            return False

    class Context:
        master = "spark://somewhere:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": lambda self: Nothing()})()

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": lambda self, key, default: default})()

    with pytest.raises(RuntimeError):
        lineage.shared_folder(Session())


def test_written_tables_can_be_released(spark):
    before = lineage.written(spark.range(3), "gone")
    path = before.inputFiles()[0]
    assert lineage.release(spark) >= 1
    import os

    assert not os.path.exists(path.removeprefix("file://").removeprefix("file:"))
