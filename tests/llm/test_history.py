import random

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import history
from ledgerline.llm.neardup import pruned

from .test_neardup import corpus, similarity

H = "id string, canonicalUrl string, sourceHash string, contentHash string, content string"


def brute(old, new):
    kept, out = list(old), {}
    for r in sorted(new, key=lambda r: (r[5], r[6])):
        hits = [k for k in kept if (r[1] and k[1] == r[1]) or (r[2] and k[2] == r[2]) or (r[3] and k[3] == r[3]) or similarity(r[4], k[4]) >= 0.5]
        if hits:
            out[r[0]] = {k[0] for k in hits}
        else:
            kept.append(r)
    return out


def feed(seed):
    rnd = random.Random(seed)
    texts = corpus(seed, 20)
    rnd.shuffle(texts)

    def item(i, p, t):
        return (f"{p}{i}", rnd.choice([None, f"https://e.org/{i}", f"https://e.org/{i % 9}"]), rnd.choice([f"s{p}{i}", f"s{i % 17}"]), rnd.choice([None, f"c{p}{i}", f"c{i % 13}"]), rnd.choice([t, t, None]))

    old = [item(i, "h", t) for i, t in enumerate(texts[: len(texts) // 3])]
    new = [(*item(i, "n", t), 1 + i // 10, i) for i, t in enumerate(texts[len(texts) // 3 :])]
    return old, new


@pytest.mark.parametrize("seed,at_once", [(1, 1), (2, 3), (3, 99)])
def test_equals_playing_the_arrivals_one_by_one(spark, seed, at_once):
    old, new = feed(seed)
    got = history.check_deliveries(spark.createDataFrame(old + old[:2], H), spark.createDataFrame(new + new[:1], H + ", batch_no int, item_no long"), at_once=at_once)
    want, rows = brute(old, new), [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and {a for a, _ in rows} == set(want)
    assert all(b in want[a] for a, b in rows)


def test_a_hot_family_and_empty_sides(spark):
    words = [f"w{i}" for i in range(120)]
    rnd = random.Random(3)

    def near():
        w = list(words)
        for _ in range(4):
            w[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
        return " ".join(w)

    new = [(f"n{i}", None, f"s{i}", None, near(), 1, i) for i in range(120)] + [("odd", None, "q", None, "a quite different text of other words", 1, 500)]
    df, none = spark.createDataFrame(new, H + ", batch_no int, item_no long"), spark.createDataFrame([], H)
    rows = {tuple(r) for r in history.check_deliveries(none, df).collect()}
    want = brute([], new)
    assert {a for a, _ in rows} == set(want) and all(b in want[a] for a, b in rows)
    assert history.check_deliveries(none, df.limit(0)).count() == 0


def test_appended_history(spark, tmp_path):
    old, new = feed(4)
    table = history.PivotTable(spark, str(tmp_path / "pivots"))
    h = history.as_items(spark.createDataFrame(old, H), False)
    table.add(h.where("id <= 'h2'")).add(h.where("id > 'h2'"))
    deliveries = history.as_items(spark.createDataFrame(new, H + ", batch_no int, item_no long"), True)
    texts = h.select("id", "text").union(deliveries.select("id", "text"))
    want, got = brute(old, new), {}
    for n in sorted({r[5] for r in new}):  # delivery after delivery; what is accepted joins the history
        part = deliveries.where(F.col("batch_no") == n)
        bad = history.refused(table, history.pivot_rows(part, words=3), texts).collect()
        got |= {r.id: r.of for r in bad}
        table.add(part.where(~F.col("id").isin([r.id for r in bad])))
    assert set(got) == set(want) and all(b in want[a] for a, b in got.items())


def test_rows_out_of_a_deliverys_reach_are_not_read(spark, tmp_path):
    table = history.PivotTable(spark, str(tmp_path / "pivots"))
    texts = {f"t{n}": " ".join(f"w{n}x{i}" for i in range(n + 2)) for n in (1, 2, 3, 4, 7, 8, 9, 40, 5000)}
    df = spark.createDataFrame([(k, None, k, None, t) for k, t in texts.items()], H)
    table.add(history.as_items(df, False))
    sizes = {r.size: r.part for r in table.rows().collect()}
    for a in sizes:
        for b in sizes:
            assert not (a >= b / 2 and b >= a / 2) or abs(sizes[a] - sizes[b]) <= 1
    read = table.rows([sizes[40] - 1, sizes[40], sizes[40] + 1])
    assert {r.size for r in read.collect()} == {40}
    folders = {f.split("part=")[1].split("/")[0] for f in read.inputFiles()} if read.inputFiles() else set()
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part" in plan.split("PartitionFilters: [")[1].split("]")[0] and len(folders) > 1
    # A spoilt file in a range out of reach is never opened.
    for f in (tmp_path / "pivots" / f"part={sizes[5000]}").glob("*.parquet"):
        f.write_bytes(b"spoilt")
    new = history.as_items(spark.createDataFrame([("n", None, "q", None, texts["t40"].upper(), 1, 1)], H + ", batch_no int, item_no long"), True)
    near = table.rows([sizes[40] - 1, sizes[40], sizes[40] + 1]).where("node IS NOT NULL")
    assert near.select("id", "keys", "counts").collect()[0].id == "t40"
    assert history.pivot_rows(new, words=3).collect()[0].node == near.collect()[0].node


def test_pruning_never_loses_a_similar_pair(spark):
    texts = corpus(8, 15)
    items = spark.createDataFrame([(f"i{k}", None, None, None, t) for k, t in enumerate(texts)], H)
    table = history.pivot_rows(history.as_items(items, False), words=3).where("node IS NOT NULL").cache()
    a, b = table.select(F.col("node").alias("a")), table.select(F.col("node").alias("b"))
    pairs = a.join(b, F.col("a") < F.col("b")).distinct()
    kept = {tuple(r) for r in pruned(pairs, table, 0.5).collect()}
    node = {r.id: r.node for r in table.collect()}
    for i, x in enumerate(texts):
        for j in range(i):
            if similarity(x, texts[j]) >= 0.5 and node[f"i{i}"] != node[f"i{j}"]:
                assert tuple(sorted((node[f"i{i}"], node[f"i{j}"]))) in kept
    assert len(kept) < pairs.count()
