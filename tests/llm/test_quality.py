import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import quality
from tests.llm.texts import SCHEMA, awkward, sentence


def good_and_bad(n=600):
    rnd = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        text = sentence(rnd, rnd.randint(5, 120)).lower()
        bad = i % 5 == 0
        if bad:
            junk = [lambda t: t.upper() + "!!", lambda t: " | ".join(t.split()), lambda t: " ".join(t.split()[:3] * 20)]
            text = junk[i // 5 % 3](text)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not bad), 0))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    docs, labels = good_and_bad()
    rows = quality.feature_rows(spark.createDataFrame(docs, SCHEMA).withColumn("upper", F.lit("clash")))
    model = quality.train(rows, spark.createDataFrame([*labels, *labels[:9], (None, 1, 0), (3, None, 0)], LABELS))
    got = quality.scored(rows, model).withColumn("held_out", quality.held_out()).toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    truth = dict((d, q) for d, q, _ in labels)
    out = got[got.held_out]
    right = (out.score >= 0.7) == (out.doc_id.map(truth) == 1)
    assert right.mean() > 0.97 and got.score.between(0, 1).all()
    beside = spark.createDataFrame(docs, SCHEMA).select("doc_id", quality.score_column(F.col("text"), model).alias("s")).toPandas()
    assert np.allclose(beside.sort_values("doc_id").s, got.sort_values("doc_id").score)


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = good_and_bad(200)
    rows = quality.feature_rows(spark.createDataFrame(docs, SCHEMA))
    lies = [(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q, t) for d, q, t in labels]
    one, two = (quality.train(rows, spark.createDataFrame(x, LABELS)) for x in (labels, lies))
    table = quality.features([d[1] for d in docs])
    assert (one.score(table) == two.score(table)).all()


def test_sample_is_bounded_and_repeatable(spark):
    docs, labels = good_and_bad(100)
    rows = quality.feature_rows(spark.createDataFrame(docs, SCHEMA))
    marks = spark.createDataFrame(labels, LABELS)
    table = quality.features([d[1] for d in docs])
    found = [quality.train(rows, marks, sample_rows=40).score(table) for _ in range(2)]
    assert (found[0] == found[1]).all() and (found[0] != quality.train(rows, marks).score(table)).any()


def test_awkward_and_missing(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    rows = quality.feature_rows(docs)
    none = quality.train(rows, spark.createDataFrame([], LABELS))
    assert {r.score for r in quality.scored(rows, none).collect()} == {0.5}
    assert quality.scored(rows, none).count() == len(awkward())
    empty = quality.feature_rows(spark.createDataFrame([], SCHEMA))
    assert quality.scored(empty, none).count() == 0
    assert np.isfinite(quality.features([r[1] for r in awkward()])).all()
    beside = spark.createDataFrame([], SCHEMA).select(quality.score_column(F.col("text"), none).alias("s"))
    assert beside.count() == 0


def test_blocks_do_not_matter(monkeypatch):
    texts = [r[1] for r in awkward()]
    want = quality.features(texts)
    monkeypatch.setattr(quality, "BLOCK_BYTES", 10)
    assert np.allclose(quality.features(texts), want)


def test_pair_tables_learn_an_interaction():
    rnd = np.random.default_rng(0)
    rows = rnd.random((4000, 3))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.5)).astype(float)
    model = quality.fit(rows, labels)
    assert ((model.score(rows) > 0.5) == labels).mean() > 0.95
    assert model.pairs[0] in [(1, 0), (0, 1)]


@pytest.mark.parametrize("text", ["", None])
def test_empty_text_has_a_score(text):
    rows = quality.features(["some words here", text])
    assert 0 <= quality.Model(base=0.3).score(rows)[1] <= 1
