import random
from collections import Counter, defaultdict

import pytest

from ledgerline.llm import packing, tokens


def check(items, places, capacity):
    size = {k: n for k, _, n in items}
    used, got, seen = defaultdict(int), Counter(), set()
    spans = defaultdict(list)
    for key, piece, container, slot, at, n in places:
        assert 0 < n <= capacity and 0 <= at and at + n <= capacity
        assert (container, slot) not in seen and (key, piece) not in {x[:2] for x in spans[container]}
        seen.add((container, slot))
        spans[container].append((key, piece, at, n))
        used[container] += n
        got[key] += n
    assert got == Counter({k: n for k, n in size.items()})
    for c, s in spans.items():
        s = sorted(x[2:] for x in s)
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and used[c] <= capacity
    pieces = Counter(p[0] for p in places)
    assert all(pieces[k] == max(1, -(-n // capacity)) for k, n in size.items())
    return used


def test_every_item_once_and_nearly_full():
    rnd = random.Random(4)
    items = [(i, rnd.choice("aaaabbc"), rnd.choice([5, 20, 60, 150, 700, 1000]) + rnd.randint(0, 30)) for i in range(3000)]
    total = sum(n for *_, n in items)
    shares = {s: sum(n for _, x, n in items if x == s) / total for s in "abc"}
    used = check(items, packing.pack(items, shares, {}, 512), 512)
    assert total / (512 * len(used)) > 0.98
    assert packing.pack([], {}, {}, 10) == []
    assert [p[5] for p in packing.pack([("x", "a", 25)], {"a": 1.0}, {}, 10)] == [10, 10, 5]


def test_shares_hold_and_deficits_are_carried():
    items = [(f"{s}{i}", s, 10) for s, n in (("a", 600), ("b", 300), ("c", 100)) for i in range(n)]
    by = defaultdict(Counter)
    for key, _, c, *_, n in packing.pack(items, {"a": 0.6, "b": 0.3, "c": 0.1}, {}, 100):
        by[c][key[0]] += n
    assert all(abs(x["a"] - 60) <= 10 and abs(x["b"] - 30) <= 10 and abs(x["c"] - 10) <= 10 for x in by.values())
    first = packing.pack(items, {"a": 0.6, "b": 0.3, "c": 0.1}, {"c": 1000.0}, 100)
    assert all(p[0][0] == "c" for p in first if p[2] == 0)


def test_a_part_starts_with_what_the_earlier_ones_end_with(spark):
    """Parts packed one after the other, each with the deficits left by the last, give the places that packed() gives."""
    rnd = random.Random(8)
    rows = [(i, rnd.choice("aaab"), rnd.randint(1, 90), 1, "x") for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    limits = spark.createDataFrame([("s", 128)], "purpose string, capacity_tokens int")
    targets = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("none", 0.0)], "source string, weight double")
    got = defaultdict(list)
    for r in packing.packed(df, limits, "doc_id", "source", targets=targets, part_tokens=5_000).collect():
        got[r.container >> 32].append((r.doc_id, r.piece, r.container & 0xFFFFFFFF, r.slot, r.offset, r.tokens))
    of = {i: (s, n) for i, s, n, *_ in rows}
    shares, owed = {"a": 0.25, "b": 0.75}, {"a": 0.0, "b": 0.0}
    assert len(got) > 5
    for part in sorted(got):
        items = [(i, *of[i]) for i in {p[0] for p in got[part]}]
        assert sorted(packing.pack(items, shares, owed, 128)) == sorted(got[part])
        for s, w in shares.items():
            owed[s] += w * sum(n for *_, n in items) - sum(n for _, x, n in items if x == s)


SCHEMA = "doc_id long, source string, tokens int, part int, container string"


def test_frame(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "a", "b", None]), rnd.randint(0, 400), 1, "x") for i in range(2000)] + [(9999, "b", 5000, 1, "x")]
    limits = spark.createDataFrame([("s", 256), ("l", 1024), ("none", 0)], "purpose string, capacity_tokens int")
    for part_tokens in (10**9, 40_000):
        out = packing.packed(spark.createDataFrame(rows, SCHEMA), limits, "doc_id", "source", part_tokens=part_tokens).collect()
        assert {r.purpose for r in out} == {"s", "l"}
        for purpose, capacity in (("s", 256), ("l", 1024)):
            mine = [(r.doc_id, r.piece, r.container, r.slot, r.offset, r.tokens) for r in out if r.purpose == purpose]
            check([(r[0], r[1], r[2]) for r in rows if r[2]], mine, capacity)
    empty = packing.packed(spark.createDataFrame([], SCHEMA), limits, "doc_id", "source")
    assert empty.count() == 0 and packing.fill_report(empty).count() == 0


def test_token_counts(spark):
    pytest.importorskip("tiktoken")
    df = spark.createDataFrame([(1, "hello <|endoftext|> مرحبا"), (2, None), (3, ""), (4, "word " * 20_000)], "id long, text string")
    got = {r.id: r.tokens for r in tokens.counted(df, ["id"], "text").collect()}
    tool = tokens.encoding(tokens.VOCABULARY)
    assert got[1] == len(tool.encode_ordinary("hello <|endoftext|> مرحبا")) and got[2] == got[3] == 0 and got[4] >= 20_000
    assert tool.decode(tool.encode_ordinary("naïve – text ١٢")) == "naïve – text ١٢"
