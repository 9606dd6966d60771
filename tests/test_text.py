import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as T


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v")).alias("o"))
    out = [r.o for r in df.collect()]
    return out[0] if len(out) == 1 else out


@pytest.mark.parametrize(
    "f,given,wanted",
    [
        (T.fold, "  Élan-Vital™ Ümlaut (Dr.) ", "elan vital umlaut dr"),
        (T.fold, "ﬁt ½ ß Ａ", "fit 1 2 a"),
        (T.archive_fold, "élan", "e lan"),
        (T.normalized_title, "The FDA approves first drug for rare disease", "fda approves first drug rare disease"),
        (T.normalized_title, "Café opens in Abu Dhabi", "cafe opens abu dhabi"),
        (T.story_key, "The FDA approves first drug for rare disease", "81061abc02c5fd34"),
        (T.facility_words, "a d a m clinic l l c", " adam clinic "),
        (T.facility_words, "Group Holding LLC", " group holding llc "),
        (T.facility_words, "Prime Medical Centers F.Z. L.L.C", " prime medical centre "),
        (T.entity_norm, "Paediatric, café!", " pediatric caf "),
        (T.slug, " Élan & Co. ", "elan-co"),
        (T.shard, "94316348", "348"),
        (T.shard, "7", "007"),
        (T.stripped, "<p>a&nbsp;&amp;lt; &#65;&#x42;</p>\n c", "a &lt; AB c"),
        (T.reading_minutes, " ".join(["w"] * 39), None),
        (T.reading_minutes, " ".join(["w"] * 40), 1),
        (T.reading_minutes, " ".join(["w"] * 337), 1),
        (T.reading_minutes, " ".join(["w"] * 338), 2),
        (T.reading_minutes, " ".join(["w"] * 563), 3),
        (T.initials, "  aisha  noor khan", "AK"),
        (T.html_escaped, "<a & 'b'>", "&lt;a &amp; &#39;b&#39;&gt;"),
        (T.blank_to_null, "  \t ", None),
    ],
)
def test_vectors(spark, f, given, wanted):
    assert one(spark, f, given) == wanted


def test_fold_equals_unicode_data(spark):
    texts = ["Šťáva ﬂ مرحبا é́ x", "ÀÉÎÕÜ ñ ç ø ł", "① ２３", "½ cup ﬃ"]
    for t in texts:
        plain = "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not "̀" <= c <= "ͯ")
        want = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in plain).split())
        assert one(spark, T.fold, t) == want, t


def test_fold_of_rare_compatibility_forms(spark):
    """Forms of several letters that the fold does not spell out become blanks, and nothing else changes."""
    assert one(spark, T.fold, "a ĳ b ㎏ c ﷺ d") == "a b c d"


def test_markup(spark):
    html = '<div onclick="x()">a<script>evil("<p>")</script><p style="c">b <a class="k" href="https://e.org/x">l</a><a href="javascript:1">m</a></p><p></p><img src=\'https://e.org/i.png\' alt="pic" onerror=z><img src="data:1"></div><!-- c --><u>n</u><table><tr><td>t</td></tr></table><input value=1>'
    assert one(spark, T.sanitised, html) == 'a<p>b <a href="https://e.org/x">l</a>m</a></p><img src="https://e.org/i.png" alt="pic"><u>n</u>t'
    relative = '<p><a href="../more.html?a=1&amp;b=2">x</a> <img src="i.png"> 1 < 2</p>'
    assert one(spark, lambda c: T.sanitised(c, F.lit("https://e.org/news/day/a.html")), relative).startswith('<p><a href="https://e.org/news/more.html?a=1&b=2">x</a> <img src="https://e.org/news/day/i.png">')
    assert one(spark, T.sanitised, None) is None and one(spark, T.sanitised, "") == ""


def test_addresses_and_dates(spark):
    base = "https://e.org/news/today.html"
    cases = {"https://x.org/a": "https://x.org/a", "//x.org/a": "https://x.org/a", "/a/b": "https://e.org/a/b", "c.png": "https://e.org/news/c.png", "mailto:x": None, "../c.png": "https://e.org/c.png", "./a/../b/?q=/../x": "https://e.org/news/b/?q=/../x", "../../../z": "https://e.org/z", "a/..": "https://e.org/news/"}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select(T.absolute(F.col("v"), F.lit(base)).alias("o"))
    assert [r.o for r in df.collect()] == list(cases.values())
    dates = ["Tue, 05 Mar 2024 10:20:30 GMT", "5 Mar 2024 10:20:30 +0200", "2024-03-05T10:20:30Z", "soon", None]
    got = one(spark, lambda c: F.unix_timestamp(T.parsed_date(c)), *dates)
    assert got == [1709634030, 1709626830, 1709634030, None, None]
