import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import gru, langid

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_gradients_equal_differences():
    w = {k: v.astype(np.float64) for k, v in gru.init(3, hidden=4, embed=3, stride=2, features=5, seed=3).items()}
    r = np.random.default_rng(0)
    data, label, weight = r.integers(0, 256, (5, 14)).astype(np.uint8), r.integers(0, 3, (6, 5)), r.random((6, 5))
    _, g = gru.loss_and_gradients(w, data, label, weight, 2)
    for k in w:
        i = max(np.ndindex(w[k].shape), key=lambda i: abs(g[k][i]))
        old = w[k][i]
        w[k][i] = old + 1e-3
        up = gru.loss_and_gradients(w, data, label, weight, 2)[0]
        w[k][i] = old - 1e-3
        down = gru.loss_and_gradients(w, data, label, weight, 2)[0]
        w[k][i] = old
        assert abs((up - down) / 2e-3 - g[k][i]) < 1e-3 * max(1, abs(g[k][i]))


def test_label_codes(spark):
    df = spark.createDataFrame([("en-AE",), (" EN_XX ",), ("und",), ("",), (None,), ("Unknown",), ("12",)], "l string")
    assert [r[0] for r in df.select(langid.label_code(F.col("l"))).collect()] == ["en", "en", None, None, None, None, None]


@pytest.fixture(scope="module")
def model(spark):
    s = langid.Settings(train_steps=500)
    return langid.train(langid.sample_of(spark.read.parquet(DOCS).where("doc_id % 2 = 0"), "doc_id", "text", "lang", s), s)


def test_held_out_accuracy(spark, model):
    rows = spark.read.parquet(DOCS).where("doc_id % 2 = 1").select("text", langid.label_code(F.col("lang")).alias("c")).where("c IS NOT NULL").collect()
    _, _, _, _, lang, _ = langid.stretches(model, pa.array([r.text for r in rows]))
    right = np.mean([langid.LANGUAGES[x] == r.c for x, r in zip(lang, rows)])
    assert right > 0.85  # some of the labels are wrong on purpose


def test_stretches_and_edges(spark, model):
    en = "The records office has not yet funded the second operating theatre, because the waiting list had grown. "
    es = "Creemos que todo esto es difícil de medir y que el laboratorio va a financiar camas adicionales este año. "
    ar = "وقال أحد الأطباء إن المشروع سهل الاستخدام، وفقا لآخر الأرقام. "
    texts = [en * 2 + es * 2 + ar * 2, en * 3, None, "", "123 456.", "(" + es.strip() + ") " + en * 2, en * 300 + ar * 5, "<p>" + ar * 2 + "</p><p>" + en * 2 + "</p>"]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, seg_no int")
    out = langid.labelled(df, "doc_id", "text", [], model).collect()
    got = {i: [r.seg_lang for r in sorted((r for r in out if r.doc_id == i), key=lambda r: r.seg_no or 0)] for i in range(len(texts))}
    assert got[0] == ["en", "es", "ar"] and got[1] == ["en"] and got[6] == ["en", "ar"] and got[7] == ["ar", "en"] and got[5] == ["en"]
    assert got[2] == got[3] == got[4] == [None]
    alone = langid.stretches(model, pa.array([texts[6]]))
    beside = langid.stretches(model, pa.array([texts[0], texts[6]]))
    assert np.allclose(alone[3], beside[3][-2:], atol=1e-5)
    assert all(0 <= r.confidence <= 1.0001 for r in out)
    assert langid.labelled(df.limit(0), "doc_id", "text", [], model).count() == 0
