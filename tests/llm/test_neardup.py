import random
import re

import numpy as np
import pyarrow as pa

from ledgerline.llm import neardup, shingles

WORD = re.compile(r"[^\W_]+")


def shingle_set(text, n=3):
    if text is None:
        return set()
    w = WORD.findall(re.sub("<[^>]*>", "", text).lower())
    return set(zip(*[w[i:] for i in range(n)]))


def similarity(a, b, n=3):
    x, y = shingle_set(a, n), shingle_set(b, n)
    return len(x & y) / len(x | y) if x | y else 0.0


def corpus(seed=5, families=25):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for f in range(families):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([12, 40, 160]))]
        out.append(" ".join(words))
        for _ in range(rnd.randint(0, 3)):
            w = list(words)
            for _ in range(max(1, len(w) // 25)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            text = " ".join(w)
            out.append(rnd.choice([text, text.upper(), f"<p>{text}</p>", text.replace(" ", ",  ")]))
    return out


def test_shingle_counts_and_stability():
    texts = [*corpus(), None, "", "  ", "one two", "a b c", "<p>É b</p> c_d", "naïve Ünïcode ١٢٣ ok", "x " * 30_000]
    off, h = shingles.shingle_sets(pa.array(texts))
    assert list(np.diff(off)) == [len(shingle_set(t)) for t in texts]
    back_off, back = shingles.shingle_sets(pa.array(texts[::-1]))
    for i in range(len(texts)):
        j = len(texts) - 1 - i
        assert (h[off[i] : off[i + 1]] == back[back_off[j] : back_off[j + 1]]).all()


def test_densified_signatures_estimate_similarity():
    rnd = np.random.default_rng(1)
    off, sets = [0], []
    for _ in range(300):
        common = rnd.integers(0, 2**63, 60).astype(np.uint64)
        for _ in range(2):
            s = np.unique(np.concatenate((common, rnd.integers(0, 2**63, 30).astype(np.uint64))) * np.uint64(2) + np.uint64(1))
            sets.append(s)
            off.append(off[-1] + len(s))
    sig = shingles.one_permutation(np.array(off), np.concatenate(sets), 256)
    assert abs((sig[::2] == sig[1::2]).mean() - 60 / 120) < 0.02


def truth(rows, least, n):
    top = {}

    def f(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    ids = sorted({k for k, _ in rows})
    for i, (a, ta) in enumerate(rows):
        for b, tb in rows[:i]:
            if a != b and similarity(ta, tb, n) >= least:
                top[f(a)] = f(b)
    return {(a, b) for a in ids for b in ids if a < b and f(a) == f(b)}


def test_groups_equal_brute_force(spark):
    rows = [(f"d{i}", t) for i, t in enumerate(corpus())] + [("n1", None), ("n2", None), ("e", ""), ("s", "too short"), ("s2", "too short"), ("d0", corpus()[0])]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "id string, content string, node string, size int")
    for least, n in ((0.5, 3), (0.8, 5)):
        got = neardup.pairs_within(neardup.near_duplicate_groups(df, "id", "content", words=n, least=least), "id")
        assert {tuple(r) for r in got.collect()} == truth(rows, least, n)


def test_a_third_of_all_rows_are_copies(spark):
    texts = corpus()
    rows = [(f"c{i:04d}", texts[0]) for i in range(300)] + [(f"d{i}", t) for i, t in enumerate(texts)]
    groups = neardup.near_duplicate_groups(spark.createDataFrame(rows, "id string, content string"), "id", "content", words=3, least=0.5)
    assert groups.where("id LIKE 'c%'").select("group").distinct().count() == 1 and groups.where("id LIKE 'c%'").count() == 300
    empty = neardup.near_duplicate_groups(spark.createDataFrame([], "id string, content string"), "id", "content")
    assert empty.count() == 0


def test_similar_pairs_inside_buckets_of_unrelated_texts(spark):
    rnd, texts = random.Random(3), {}
    words = iter(range(10**6))
    take = lambda n: [f"w{next(words)}" for _ in range(n)]
    boilerplate = take(42)
    for i in range(150):
        own = take(8)
        for side in "ab":
            w = [*boilerplate, *own, *take(25)]
            rnd.shuffle(w)
            texts[f"{i:03d}{side}"] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "id string, content string")
    keys = {r["id"]: set(r["keys"]) for r in neardup.signed(df, ["id"], "content", words=1, bins=256, band_rows=4).collect()}
    # Only the two texts of a number are similar (0.50, others 0.39); all pairs that share a bucket are to be found.
    want = {(f"{i:03d}a", f"{i:03d}b") for i in range(150) if keys[f"{i:03d}a"] & keys[f"{i:03d}b"]}
    got = neardup.pairs_within(neardup.near_duplicate_groups(df, "id", "content", words=1, least=0.5), "id")
    assert {tuple(r) for r in got.collect()} == want and len(want) > 140
