import datetime as dt
import itertools
import json

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import classify, quality
from ledgerline.operators import directory as D
from ledgerline.operators import register as R
from ledgerline.sources import snapshots

FACILITIES = [("f1", "Akram Dermatology Clinic", "aesthetic"), ("f2", "City Pharmacy", "pharmacy"), ("f3", "Smile Dental", "dental")]
PEOPLE = [
    ("1001", "AISHA KHAN", "Physician-Specialist Dermatology", "FTL", "India", "Arabic, English", ["f1"], ["f1"]),
    ("1002", "Akram Élan", "Physician-General Practitioner", "FTL", "Egypt", "Arabic", ["f1", "f2"], ["f1"]),
    ("1003", "BELLA DERM", "Nurse and Midwife-Registered Nurse", "REG", "Philippines", None, [], []),
    ("1004", "Carlos Diaz", "Dentist-General Dentist", "FTL", "Spain", "English, Spanish", ["f3"], ["f3"]),
    ("1005", "Dina Omar", "Physician", "TRL", None, "Arabic, English", ["f2"], []),
    ("2001", "aisha noor", "Allied Health-Pharmacist", "FTL", "India", "English", ["f2"], ["f2"]),
]
NOW = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def source(spark):
    doc = [(i, n, s, t, nat, lang, None, None, None, None, None, None, None) for i, n, s, t, nat, lang, *_ in PEOPLE] + [("9", "Gone", "Physician-X", "FTL", "India", None, None, None, None, None, None, None, NOW)]
    doctor = spark.createDataFrame(doc + doc[:1], "id string, name string, speciality string, licenseType string, nationality string, languages string, mobileNumber string, personalEmail string, linkedIn string, experience string, education string, specialities string, removedAt timestamp")
    facility = spark.createDataFrame([(i, n, t) for i, n, t in FACILITIES], "id string, nameTrimmed string, typeGuess string")
    rows = []
    for i, *_, linked, licensed in PEOPLE:
        for f in linked:
            rows.append((i, f, 1, "facility_roster", None, None, "facility_roster", NOW))
        for f in licensed:
            rows += [(i, f, 0, "search_stage", None, None, "search_dto", NOW), (i, f, 1, "current_license", "Consultant", "Active License", "specialities", NOW)]
    rows += [("1001", "f3", 0, "employment_history", "x", None, "experience", NOW), ("9", "f1", 1, "search_stage", None, None, "search_dto", NOW), ("1004", None, 1, "search_stage", None, None, "search_dto", NOW), ("1004", "nowhere", 1, "search_stage", None, None, "search_dto", NOW)]
    placement = spark.createDataFrame(rows + rows[:1], "doctorId string, facilityId string, isCurrent int, relationType string, title string, statusLabel string, sourceSection string, createdAt timestamp")
    licence = spark.createDataFrame([("1002", "Full-time License", "primary_dto"), ("1002", "Part-time License", "filter_pass")], "doctorId string, licenceType string, source string")
    return {"doctor": doctor, "facility": facility, "doctor_facility": placement.distinct(), "doctor_licence_type": licence}


@pytest.fixture(scope="module")
def people(source):
    return D.professionals(source["doctor"], source["doctor_facility"], source["facility"], source["doctor_licence_type"]).cache()


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def q(**k):
    return D.DirectoryQuery(**k)


def test_search_and_filters(people):
    assert ids(D.matched(people, q(q="derm"))) == ["1001", "1002", "1003"]
    assert ids(D.matched(people, q(q="derm", mode="professionals"))) == ["1001", "1003"]
    assert ids(D.matched(people, q(q="akram"))) == ["1001", "1002"]
    assert ids(D.matched(people, q(q="aisha derm"))) == ["1001"] and ids(D.matched(people, q(q="élan"))) == ["1002"]
    assert ids(D.matched(people, q(q="1001"))) == ["1001"] and ids(D.matched(people, q(q="00"))) == []
    assert ids(D.matched(people, q(chosen={"facility": ("City Pharmacy",)}))) == ["2001"]
    assert ids(D.matched(people, q(chosen={"category": ("Physician",), "language": ("Arabic",)}))) == ["1001", "1002", "1005"]
    assert ids(D.matched(people, q(chosen={"category": ("Nothing",)}))) == [] and ids(D.matched(people, q(toggles=("has_mobile",)))) == []


def test_facet_counts_equal_one_query_a_facet(people):
    rows = people.collect()
    for chosen in ({}, {"category": ("Physician",), "language": ("Arabic",)}, {"nationality": ("India", "Egypt"), "licence": ("Full-time License",), "facility_type": ("pharmacy",)}):
        got = {(r.facet, r.label): r.cnt for r in D.facet_counts(people, q(chosen=chosen)).collect()}
        want = {}
        for f in D.FACETS:
            keep = set(ids(D.matched(people, q(chosen={k: v for k, v in chosen.items() if k != f}))))
            for r in rows:
                if r.id in keep:
                    for x in [r[f]] if f in D.SINGLE else r[D._COUNTED[f]]:
                        if x is not None:
                            want[(f, x)] = want.get((f, x), 0) + 1
        assert got == want
    plan = D.facet_counts(people, q(chosen={"category": ("Physician",)}))._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_orders_pages_and_facility_view(people, source):
    order = [r.id for r in D.page(people, q(sort="name-asc")).collect()]
    assert order == ["1001", "2001", "1002", "1003", "1004", "1005"]
    assert [r.id for r in D.page(people, q()).collect()] == ["1001", "1002", "1003", "1004", "1005", "2001"]
    assert [r.id for r in D.page(people, q(sort="specialty"), 6).collect()][-1] == "1005"
    view = {r.facility: (r.doctor_count, r.matching) for r in D.facility_results(people, source["facility"], q(chosen={"nationality": ("India",)})).collect()}
    assert view == {"Akram Dermatology Clinic": (2, 1), "City Pharmacy": (3, 1), "Smile Dental": (1, None)}
    assert [(r.kind, r.value) for r in D.suggestions(people, source["facility"], "ph").orderBy("rank").collect()][:2] == [("facility", "City Pharmacy"), ("specialty", "Pharmacist")]
    assert D.suggestions(people, source["facility"], "p").count() == 0


def test_query_state_round_trip():
    state = q(q="a b", mode="professionals", sort="name-asc", page=3, chosen={"category": ("X & Y", "Z")}, toggles=("has_email",))
    assert D.DirectoryQuery.from_params(state.to_params()) == state and q().to_params() == "" and state.active_filters() == 4
    assert D.DirectoryQuery.from_params("?mode=bad&page=-2&sort=1&nope=1") == q()


def test_links(source, spark):
    link = R.links(source["doctor"], source["doctor_facility"], source["facility"])
    got = {(r.doctor_id, r.facility_id): r for r in link.collect()}
    assert set(got) == {(i, f) for i, *_, linked, _ in PEOPLE for f in linked} | {("1001", "f3")}
    assert got["1001", "f3"].is_past and not got["1001", "f3"].is_current and got["1005", "f2"].is_current and not got["1005", "f2"].is_licensed
    assert got["1001", "f1"].roles == ["Consultant"]
    text = "General Dentist · ADAM MEDICAL CENTRE L.L.C and 1 others Show All | Nurse"
    assert spark.range(1).select(R.printed_facilities(F.lit(text)).alias("p")).first().p == ["adam medical centre l l c"]


def test_profile_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    work = one(R.experience(F.lit("Specialist Orthodontics · ABC CLINIC · License: 00009446-002 · 05 December 2023 - Present (8 Months) | Nurse · Dubai |  | A · B · C · D")))
    assert (work[0].title, work[0].facility, work[0].licence_number, work[0].start, work[0].end, work[0].duration) == ("Specialist Orthodontics", "ABC CLINIC", "00009446-002", "05 December 2023", "Present", "8 Months")
    assert (work[1].title, work[1].facility, work[1].place) == ("Nurse", None, "Dubai") and (work[2].facility, work[2].place) == ("B", "D") and len(work) == 3
    edu = one(R.education(F.lit("MBBS · University of Khartoum · Graduated 2010 · Sudan, Khartoum (Verified by DataFlow)")))[0]
    assert (edu.qualification, edu.institution, edu.graduated, edu.country, edu.location, edu.verification) == ("MBBS", "University of Khartoum", "2010", "Sudan", "Khartoum", "Verified by DataFlow")
    more = one(R.education(F.lit("Pre-University · Kochi | Nursing · - | Royal College of Surgeons | Kochi | BSc · X College · extra · India | BSc · X College · extra · India")))
    assert [(x.qualification, x.institution, x.heading, x.country, x.location, x.extra) for x in more] == [
        ("Pre-University", None, None, None, "Kochi", []), (None, None, "Nursing", None, "-", []), (None, "Royal College of Surgeons", None, None, None, []), (None, None, None, None, "Kochi", []),
        *[("BSc", "X College", None, None, "India", ["extra"])] * 2,
    ]
    assert [x.is_current for x in one(R.experience(F.lit("Nurse · A · B (Present) | Nurse · 05 May 2020 - Present")))] == [True, False]
    assert one(R.education(F.lit(None).cast("string"))) == [] and one(R.experience(F.lit(" | "))) == []
    hours = {"Tuesday": {"isClosed": "true"}, "Sunday": {"is24Hours": "true"}, "Monday": {"timeIntervals": [{"StartDropDown": "9", "EndDropDown": "13"}, {"StartDropDown": "16", "EndDropDown": "24"}]}, "Wednesday": {"timeIntervals": []}}
    assert [tuple(x) for x in one(R.opening_hours(F.lit(json.dumps(hours))))] == [("Sunday", "24 hours"), ("Monday", "9 AM – 1 PM, 4 PM – 12 AM"), ("Tuesday", "Closed")]
    assert one(R.opening_hours(F.lit("{bad"))) is None
    pairs = {"Physician-General Practitioner": ("Physician", "General Practitioner"), "Allied Health-Speech-Language": ("Allied Health", "Speech-Language"), "-X": ("-X", None), "Dentist": ("Dentist", None)}
    for text, want in pairs.items():
        assert (one(R.category(F.lit(text))), one(R.specialty(F.lit(text)))) == want


def test_facility_kinds(spark):
    f = spark.createDataFrame([("1", "Prime Medical Center L L C", None), ("2", "Premier Diagnostic Center", None), ("3", "A D A M CLINIC L.L.C", None), ("4", "Dr Smith General Dental Clinic", None), ("5", "Group Holding LLC", None), ("6", "Al Noor", None), ("7", "Al Noor", "clinic"), ("8", None, None)], "facility_id string, name string, guess string")
    staff = spark.createDataFrame([(i, s, n) for i in ("6", "7") for s, n in (("Pharmacist", 6), ("General Practitioner", 4))], "facility_id string, specialty string, cnt long")
    got = {r.facility_id: (r.type, r.type_source) for r in classify.facility_types(f, staff).collect()}
    assert got == {"1": ("medical_center", "name"), "2": ("diagnostic_center", "name"), "3": ("clinic", "name"), "4": ("dental", "name"), "5": ("other", "unclassified"), "6": ("pharmacy", "staff"), "7": ("clinic", "dha_type"), "8": ("other", "unclassified")}


def build(source):
    link = R.links(source["doctor"], source["doctor_facility"], source["facility"])
    counts = R.facility_counts(link)
    licences = R.licence_names(source["doctor"], source["doctor_licence_type"])
    size = lambda c, f: F.size(f(F.col(c)))
    doctor = R.active(source["doctor"]).distinct()
    return {
        "people": doctor.select("id"), "facilities": source["facility"].select(F.col("id").alias("facility_id"), F.col("typeGuess").alias("type")), "link": link, "counts": counts, "licences": licences,
        "facets": R.static_facets(source["doctor"], source["doctor_licence_type"]), "profiles": doctor.select("id", size("experience", R.experience).alias("work"), size("education", R.education).alias("education")),
    }


def test_publishing_is_all_or_nothing(spark, source, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "store"))
    report = lambda t: quality.checks(**t, source=source)
    built = build(source)
    first = store.publish(built, report, "one")
    assert first["published"] and store.current() == "one" and store.read("people").count() == 6
    worse = {
        "people": built["people"].where("id <> '1001'"),
        "link": built["link"].withColumn("is_licensed", F.lit(True)),
        "facets": built["facets"].withColumn("cnt", F.col("cnt") + 1),
    }
    expected = {"people": "every active person is exported", "link": "staff equals its second derivation", "facets": "licence facet equals a rebuild"}
    for n, (name, df) in enumerate(worse.items()):
        status = store.publish(built | {name: df}, report, f"bad{n}")
        assert not status["published"] and expected[name] in status["failed"] and store.current() == "one"
    assert store.publish(built, report, "two")["previous"] == "one" and store.current() == "two"
    assert store.rollback() == "one" and store.current() == "one"
    snapshots.write_sharded(built["people"], "id", str(tmp_path / "shards"))
    assert ids(snapshots.look_up(spark, str(tmp_path / "shards"), "id", "1002")) == ["1002"]


def test_positions_and_slugs(spark):
    from ledgerline.operators.ranking import positions

    df = spark.createDataFrame([(i, "Ä b" if i % 3 else "a-b") for i in range(50)], "id int, n string")
    got = [r.pos for r in positions(df, [F.desc("id")]).orderBy(F.desc("id")).collect()]
    assert got == list(range(1, 51))
    slugs = [r.slug for r in R.unique_slugs(df, "n", ["id"]).orderBy("id").limit(3).collect()]
    assert slugs == ["a-b", "a-b-2", "a-b-3"] and len(set(itertools.chain(slugs))) == 3
    mixed = spark.createDataFrame(list(enumerate(["x", "x-2", "x", "x", "x-3", "x-2", "x-4", "x-2-2", "", None])), "id int, n string")
    made = {r.id: r.slug for r in R.unique_slugs(mixed, "n", ["id"]).collect()}
    assert (made[0], made[1], made[2], made[3], made[4], made[5], made[6], made[7]) == ("x", "x-2", "x-5", "x-6", "x-3", "x-2-3", "x-4", "x-2-2")


def test_pictures(spark):
    png = "data:image/png;base64,iVBORw0KGgo="
    df = snapshots.valid_pictures(spark.createDataFrame([(png,), ("AAAA",), ("?!",), (None,)], "p string"), "p")
    assert [r.picture is not None for r in df.collect()] == [True, False, False, False]
