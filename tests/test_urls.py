from pyspark.sql import functions as F

from ledgerline.functions.urls import canonical_url


def test_canonical(spark):
    cases = {
        "https://www.Example.org/a/b/?utm_source=x&reference=1&id=7#top": "https://example.org/a/b?id=7",
        "HTTPS://Www.Example.ORG": "https://example.org/",
        "https://example.org:443//": "https://example.org/",
        "http://example.org:8080/A//?Ref=Q": "http://example.org:8080/A",
        "  not an address ": "not an address",
        "https://e.org/x?a=1&mc_cid=2&b=3": "https://e.org/x?a=1&b=3",
        "https://e.org/?": "https://e.org/",
        "": "",
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string").select(canonical_url(F.col("u")).alias("c"))
    assert [r.c for r in df.collect()] == list(cases.values())
