import math
import random
from collections import Counter

from ledgerline.llm import mixing

SIZES, TARGETS = "doc_id long, source string, tokens int, copies int", "source string, weight double, max_repeats int"


def corpus():
    rnd = random.Random(1)
    return [(i, s, rnd.randint(1, 300), 0) for i, s in enumerate(rnd.choices(["a", "b", "c", None, "z"], [60, 20, 5, 5, 10], k=4000))] + [(-1, "a", 0, 0)]


def test_shares_and_limits(spark):
    sizes = spark.createDataFrame(corpus(), SIZES)
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 5), ("none", 0.1, 3)], TARGETS)
    out = mixing.drawn(sizes, targets, "doc_id").collect()
    limit = {"a": 1, "b": 2, "c": 5}
    assert len({r.doc_id for r in out}) == len(out) and all(1 <= r.copies <= limit[r.source] for r in out)
    total = sum(r.tokens * r.copies for r in out)
    for s, w in (("a", 4 / 9), ("b", 3 / 9), ("c", 2 / 9)):
        assert abs(sum(r.tokens * r.copies for r in out if r.source == s) / total - w) < 0.005
    again = mixing.drawn(sizes.repartition(7), targets, "doc_id").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))
    other = mixing.drawn(sizes, targets, "doc_id", seed=5).collect()
    assert sorted(map(tuple, other)) != sorted(map(tuple, out))
    report = {r.source: r for r in mixing.share_report(mixing.drawn(sizes, targets, "doc_id"), sizes, targets).collect()}
    assert report["none"].documents == 0 and report["none"].actual_share == 0 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9


def test_too_large_a_total_is_capped(spark):
    sizes = spark.createDataFrame(corpus(), SIZES)
    targets = spark.createDataFrame([("a", 0.5, 1), ("c", 0.5, 3)], TARGETS)
    out = mixing.drawn(sizes, targets, "doc_id", total_tokens=10**9).collect()
    assert all(r.copies == (1 if r.source == "a" else 3) for r in out)
    assert {r.doc_id for r in out} == {i for i, s, n, _ in corpus() if s in ("a", "c") and n}


def test_a_small_share_of_a_large_source_is_cut_into_small_ranges(spark):
    sizes = spark.range(20_000).selectExpr("id AS doc_id", "'a' AS source", "100 AS tokens", "0 AS copies").union(spark.createDataFrame([(-1, "b", 2_000, 0)], SIZES))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    out = mixing.drawn(sizes, targets, "doc_id").where("source = 'a'").count()
    assert out == 20
    # With an inclusion of 0.001 the odds' logarithms still spread over many ranges about the end of the sample.
    p = 0.001
    logs = [math.log(u / (1 - u) * (1 - p) / p) for u in ((i + 0.5) / 1e6 for i in range(1_000_000)) if 0.5 * p < u < 2 * p]
    assert max(Counter(math.floor(x * mixing.RANGES) for x in logs).values()) <= 2


def test_inclusion_follows_the_odds(spark):
    rows = [(i, "a", 10 if i % 2 else 1000, 0) for i in range(400)]
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    sizes = spark.createDataFrame(rows, SIZES)
    small = large = 0
    for seed in range(6):
        for r in mixing.drawn(sizes, targets, "doc_id", total_tokens=60_000, seed=seed).collect():
            small, large = small + (r.tokens == 10), large + (r.tokens == 1000)
    assert 1.8 < large / small < 4.5  # log(1001) / log(11) = 2.88


def test_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mixing.drawn(spark.createDataFrame([], SIZES), targets, "doc_id").count() == 0
    assert mixing.drawn(spark.createDataFrame([(1, "q", 5, 0)], SIZES), targets, "doc_id").count() == 0
