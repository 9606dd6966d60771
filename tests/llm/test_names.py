import random

from pyspark.sql import functions as F

from ledgerline.llm import names as N


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def words(seed, n):
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        w = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 16)))
        out.add(w)
        v = list(w)
        for _ in range(rnd.randint(1, 3)):
            i = rnd.randrange(len(v))
            v[i : i + 1] = rnd.choice([[], ["e"], [v[i], "e"]])
            if not v:
                v = ["a"]
        out.add("".join(v))
    return sorted(out)


def test_banded_distance():
    w = words(1, 120)
    for a in w:
        for b in w[::3]:
            for k in (0, 1, 2, 3):
                assert N.edit_distance(a, b, k) == min(osa(a, b), k + 1), (a, b, k)


def test_segment_join_equals_brute_force(spark):
    left, right = words(2, 150), words(3, 150)
    left += [w[: i] + w[i + 1] + w[i] + w[i + 2 :] for w in right if len(w) > 5 for i in (len(w) // 2 - 1, len(w) // 3)]
    got = N.segment_join(spark.createDataFrame([(w,) for w in left] + [(None,), (left[0],)], "s string"), spark.createDataFrame([(w,) for w in right], "s string"), [])
    found = {(r.l, r.r): r.distance for r in got.collect()}

    for a in left:
        for b in right:
            k = N.edits_for(len(b), N.WIDE)
            if osa(a, b) <= k:
                assert found[(a, b)] == osa(a, b)
    assert all(d <= N.edits_for(len(b), N.WIDE) and d == osa(a, b) for (a, b), d in found.items())
    # Segments that several strings share are no key alone, and nothing is lost by it.
    again = N.segment_join(spark.createDataFrame([(w,) for w in left], "s string"), spark.createDataFrame([(w,) for w in right], "s string"), [], hot=1)
    assert {(r.l, r.r): r.distance for r in again.collect()} == found


def test_join_with_itself(spark):
    w = words(5, 200)
    df = spark.createDataFrame([(x,) for x in w], "s string")
    for hot in (N.HOT, 2):
        found = {(r.l, r.r) for r in N.segment_join(df, df, [], steps=(4, 7), longer=True, hot=hot).collect()}
        assert found == {(a, b) for a in w for b in w if a != b and len(a) <= len(b) and osa(a, b) <= N.edits_for(len(b), (4, 7))}


def test_short_names_and_long_joined_ones():
    for a, b in (("Anna Li", "Ana Li"), ("AlexanderLastitais", "Alexander Lastitais"), ("Bo Xu", "Xu, Bo"), ("Omar Ng", "OMAR NG, MD")):
        assert N.one_person(a, b) and set(N.token_strings(a)) & set(N.token_strings(b)), (a, b)
    assert not N.one_person("Anna Li", "Anna Chu") and not N.one_person("Omar Ng", "Zainab Ng")


def test_kinds_of_facilities():
    short = {"hosp": "hospital", "dntl": "dental", "phyio": "physiotherapy", "hme": "home", "surgry": "surgery", "cntre": "centre", "optcl": "optical", "dgnstc": "diagnostic", "phcy": "pharmacy", "hlthcare": "healthcare"}
    assert {w: N._kind_of(w) for w in short} == short
    assert not any(N._kind_of(w) for w in ("noor", "jujupor", "hal", "dala", "pym"))


def test_names():
    same = [
        ("Khadija Sanjana Al-Shabaiko", "K Shabaiko"), ("Theodore Varesir", "Theodore Vare sir"), ("Noje brix, Joaquin Sanjana", "Nojebrix Joakin Sanjana"),
        ("Ted Komije", "THEODORE KOMIJE (GP)"), ("Dr. William Lucia bin Mehiyun", "William Lucia Mehitun"), ("VICTORIA W. TETROUGE", "Victoria Tetruoge"), ("YOUSEF ZÁRUBRÁM", "Yousef Zarubram, MD"),
    ]
    other = [("Khadija Jaiklumar", "Khadija Bifouhi"), ("Gabriela Ahmed Sizazil", "Nicholas Abdullah Sizazil"), ("", "A B"), (None, "Omar Khan"), ("Dr.", "Dr.")]
    assert all(N.one_person(a, b) and N.one_person(b, a) for a, b in same)
    assert not any(N.one_person(a, b) or N.one_person(b, a) for a, b in other)


def test_person_pairs(spark):
    rows = [("1", "Ted Komije", "Egypt", "u"), ("2", "THEODORE KOMIJE", "Egypt", "u"), ("2", "THEODORE KOMIJE", "Egypt", "u"), ("3", "Theodore Komije", "Egypt", None), ("4", "Theodore Komije", "Kenya", "u"), ("5", None, "Egypt", "u"), ("6", "Ahmed Komije", "Egypt", "u")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "id string, name string, n string, e string, block string, s string")
    assert [tuple(r) for r in N.person_pairs(df, "id", "name", [F.col("n"), F.col("e")]).collect()] == [("1", "2")]
    assert N.person_pairs(df.limit(0), "id", "name", [F.col("n")]).count() == 0


def test_facility_links(spark):
    fac = spark.createDataFrame([("f1", "BAIBRIMAM BROUDAKAI PHARMACY FZ-LLC"), ("f2", "Vufunon Home Healthcare Co."), ("f3", "Vufunon Home Healthcare - Kubufis Branch"), ("f4", None)], "id string, nameTrimmed string")
    texts = {
        "a": "Baibrimam Pharm. - Broudaaki Br.", "b": " BROUDAKAI - BAIBRIMAM PHARMACY ", "c": "B a i b r i m a m Broudakai Pharmac", "d": "Vufunon Home Healthcr", "e": "vufunon kubufis homehealth care",
        "f": "Vufunon Dental Clinic", "g": "BAIBRIMAM BROUDAKAI PHARMACY FZ-LLC", "h": None, "i": " ", "j": "N/A", "k": "bAIBRIMAMbROUDAKAIpHARMACY", "l": "Baibrimam Pharmacy",
    }
    doc = spark.createDataFrame(list(texts.items()) + [("a", texts["a"])], "id string, facility string")
    got = {r.key_a: r.key_b for r in N.facility_links(doc, fac).collect()}
    assert got == {"a": "f1", "b": "f1", "c": "f1", "d": "f2", "e": "f3", "k": "f1"}
    assert N.facility_links(doc, fac.limit(0)).count() == 0
