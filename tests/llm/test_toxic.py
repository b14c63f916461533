import itertools
import random
import zlib

import numpy as np
import pytest

from pulsegrid.llm import toxic_spans
from tests.llm.texts import SCHEMA, awkward, sentence

LABELS = "doc_id long, quality int, toxic int"
BAD = ["grumbol", "vexnor"]
STEMS = ["zorch"]


def mild_and_toxic(n=500, seed=3):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = sentence(rnd, rnd.randint(3, 80)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                word = rnd.choice(BAD) if i % 4 else rnd.choice(STEMS) + rnd.choice(["on", "thi", "er", "st", "or"]) * 2
                words.insert(rnd.randrange(len(words) + 1), word)
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def plain_marginals(model, found, places):
    """Sum over all taggings of one text."""
    weights, moves = model.weights, [[0.0, model.moves[0]], [model.moves[1], model.moves[2]]]
    own = [model.bias + sum(weights[found.features[k, i]] for k in range(toxic_spans.KINDS)) for i in places]
    total, sums = 0.0, np.zeros(len(places))
    for tags in itertools.product((0, 1), repeat=len(places)):
        s = model.start * tags[0] + sum(o * y for o, y in zip(own, tags, strict=True))
        s += sum(moves[a][b] for a, b in itertools.pairwise(tags))
        total += np.exp(s)
        sums += np.exp(s) * np.array(tags)
    return sums / total


def random_model(rng):
    weights = rng.normal(size=toxic_spans.BUCKETS)
    return toxic_spans.Model(weights=weights, bias=rng.normal(), start=rng.normal(), moves=rng.normal(size=3))


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_marginals_against_all_taggings(monkeypatch, chunk):
    monkeypatch.setattr(toxic_spans, "CHUNK", chunk)
    rng = np.random.default_rng(0)
    for _ in range(60):
        raws = [" ".join(rng.choice(["aaaa", "bbbb", "cc", "dddddd", "é"], rng.integers(0, 8))).encode() for _ in range(rng.integers(1, 5))]
        found, model = toxic_spans.tokens(raws), random_model(rng)
        p = model.marginals(found)
        for text in range(len(raws)):
            places = np.flatnonzero(found.owner == text)
            if len(places):
                assert np.allclose(plain_marginals(model, found, places), p[places])


def test_slope_of_the_fit_is_that_of_the_likelihood():
    rng = np.random.default_rng(4)
    found = toxic_spans.tokens([b"aa bb cc aa", b"bb dd", b"cc"])
    labels = np.array([1, 0, 1, 0, 0, 1, 1])
    model = random_model(rng)
    own, forth, reverse = model.passes(found)

    def likelihood(model):
        total = 0.0
        for text in range(found.texts):
            places = np.flatnonzero(found.owner == text)
            one = toxic_spans.Tokens(1, found.owner[places] * 0, found.starts[places], found.ends[places], found.features[:, places], found.first[places])
            sums = []
            for tags in itertools.product((0, 1), repeat=len(places)):
                s = model.start * tags[0] + sum(y * (model.bias + model.weights[one.features[:, i]].sum()) for i, y in enumerate(tags))
                s += sum((0.0, model.moves[0], model.moves[1], model.moves[2])[2 * a + b] for a, b in itertools.pairwise(tags))
                sums.append((s, tags))
            wanted = tuple(labels[places])
            total += dict((t, s) for s, t in sums)[wanted] - np.log(sum(np.exp(s) for s, _ in sums))
        return total

    p = forth * reverse / (1 + forth * reverse)
    shifted = toxic_spans.Model(weights=model.weights, bias=model.bias + 1e-5, start=model.start, moves=model.moves)
    assert np.isclose((likelihood(shifted) - likelihood(model)) / 1e-5, (labels - p).sum(), atol=1e-3)


def test_held_out_accuracy_and_spans(spark):
    docs, labels = mild_and_toxic()
    frame = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 AS score", "2 AS spans", "3 AS toxic")
    model = toxic_spans.train(frame, spark.createDataFrame([*labels, *labels[:9], (None, 1, 1), (3, 1, None), (4, 1, 7)], LABELS))
    got = toxic_spans.toxic_spans(frame, model).withColumn("held_out", toxic_spans.held_out()).collect()
    texts, truth = {d[0]: d[1] for d in docs}, {d: t for d, _, t in labels}
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len(out) > 60 and np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in out]) > 0.97
    marked = [texts[r.doc_id][s.start : s.start + s.length] for r in out for s in r.spans]
    assert marked and np.mean([any(b in m for b in [*BAD, *STEMS]) for m in marked]) > 0.9


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = mild_and_toxic(200)
    frame = spark.createDataFrame(docs, SCHEMA)
    lies = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in labels]
    one, two = (toxic_spans.train(frame, spark.createDataFrame(x, LABELS)) for x in (labels, lies))
    assert (one.weights == two.weights).all() and (one.shape == two.shape).all()


def test_sample_is_bounded(spark):
    docs, labels = mild_and_toxic(200)
    frame = spark.createDataFrame(docs, SCHEMA)
    one, two = (toxic_spans.train(frame, spark.createDataFrame(labels, LABELS), sample_rows=24) for _ in range(2))
    assert (one.weights == two.weights).all()
    assert (one.weights != toxic_spans.train(frame, spark.createDataFrame(labels, LABELS)).weights).any()


def test_awkward_and_missing(spark):
    rows = awkward()
    docs = spark.createDataFrame(rows, SCHEMA)
    none = toxic_spans.train(docs, spark.createDataFrame([], LABELS))
    got = toxic_spans.toxic_spans(docs, none).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.5}
    assert toxic_spans.toxic_spans(spark.createDataFrame([], SCHEMA), none).count() == 0
    model = random_model(np.random.default_rng(1))
    model.shape = np.array([0.1, 0.2, 0.3, -0.1])
    scored = toxic_spans.toxic_spans(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in scored)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1] or "")
    for r in scored:
        pieces = [[t[s.start : s.start + s.length] for s in r.spans] for t in texts[r.doc_id]]
        assert any(all(p == p.strip() and p for p in piece) for piece in pieces)


def test_blocks_and_neighbours_do_not_matter():
    rng = np.random.default_rng(2)
    model, raws = random_model(rng), [(r[1] or "").encode() for r in awkward()]
    found = toxic_spans.tokens(raws)
    together = model.marginals(found)
    for i, raw in enumerate(raws):
        assert np.allclose(model.marginals(toxic_spans.tokens([raw])), together[found.owner == i])
