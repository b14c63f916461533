import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from pulsegrid.llm import mixing, quality
from tests.llm.test_duplicates import shingles, union_find
from tests.llm.test_quality import good_and_bad
from tests.llm.texts import awkward

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(folder, docs, labels):
    folder.mkdir()
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    docs = [pa.array(c, k) for c, k in zip(zip(*docs), kinds)] if docs else [pa.array([], k) for k in kinds]
    pq.write_table(pa.table(docs, COLUMNS), folder / "documents.parquet")
    kinds = [pa.int64(), pa.int32(), pa.int32()]
    labels = [pa.array(c, k) for c, k in zip(zip(*labels), kinds)] if labels else [pa.array([], k) for k in kinds]
    pq.write_table(pa.table(labels, ["doc_id", "quality", "toxic"]), folder / "labels.parquet")
    return str(folder)


def corpus():
    docs, labels = good_and_bad(150)
    docs += [(1000 + i, t, "en", s, None) for i, (_, t, _, s, _) in enumerate(awkward())]
    return docs, labels


def kept_by_quality(docs, labels):
    known = {d: t for d, t, *_ in docs}
    learnt = [(d, q) for d, q, _ in labels if zlib.crc32(str(d).encode()) % 4 != 2]
    table = quality.features([known[d] for d, _ in learnt])
    order = np.lexsort(table.T)
    model = quality.fit(table[order], np.array([q for _, q in learnt], float)[order])
    score = model.score(quality.features([d[1] for d in docs]))
    return [d for d, s in zip(docs, score) if s >= 0.7], score


def kept_of_groups(docs):
    sets = [shingles(d[1]) for d in docs]
    links = [
        (j, i)
        for i, x in enumerate(sets)
        for j in range(i)
        if x and 100 * len(x & sets[j]) >= 75 * len(x | sets[j])
    ]
    first = {}
    for i, root in enumerate(union_find(len(docs), links)):
        if sets[i]:
            first[root] = min(first.get(root, i), i, key=lambda k: docs[k][0])
    return [d for i, d in enumerate(docs) if not sets[i] or i in first.values()]


def without_repeats(docs, length=200):
    from collections import Counter

    raws = [(d[1] or "").encode() for d in docs]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for doc, raw in zip(docs, raws):
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        parts, part = [], bytearray()
        for byte, cut in zip(raw, gone):
            if cut:
                parts.append(bytes(part))
                part = bytearray()
            else:
                part.append(byte)
        text = "".join(p.decode("utf-8", "ignore") for p in [*parts, bytes(part)])
        out.append((doc[0], text, *doc[2:4], len(text)))
    return out


def copies(docs):
    db = duckdb.connect()
    documents = pd.DataFrame(docs, columns=COLUMNS)
    db.register("documents", documents)
    rows = db.execute(mixing.ORACLE).df()
    taken = dict(zip(rows.doc_id, zip(rows["size"], rows.taken)))
    return [d for d in docs for _ in range(int(taken[d[0]][1] // max(1, taken[d[0]][0])))]


def test_pipeline_against_brute_force(spark, tmp_path):
    docs, labels = corpus()
    got = corpus_pipeline.run(spark, tables(tmp_path / "t", docs, labels)).collect()
    good, score = kept_by_quality(docs, labels)
    assert 0 < len(good) < len(docs) and np.abs(score - 0.7).min() > 1e-9
    final = copies(without_repeats(kept_of_groups(good)))
    # a document without words that the mix takes counts no word, so its copies are not known here
    worded = {d[0] for d in final}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc, text, *_ in final:
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        at = 0
        while at < len(ids):
            size = 1024
            while size > len(ids) - at:
                size //= 2
            want.append((doc, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes()), len(ids)))
            at += size
    found = [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id in worded]
    assert sorted(found) == sorted(want)
    assert {r.doc_tokens for r in got if r.doc_id not in worded} <= {1, 2, 3, 4, 5, 6, 7, 8}


def test_stages_keep_columns_and_survive_anything(spark, tmp_path):
    docs, labels = awkward(), [(i, 1, 0) for i in range(30)] + [(31, None, 1)]
    folder = tables(tmp_path / "t", docs, labels)
    frame = spark.read.parquet(f"{folder}/documents.parquet").selectExpr(
        "*", "1 AS size", "'x' AS target", "2 AS _id", "'y' AS kept", "0 AS copies", "'z' AS row", "'q' AS ids"
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, folder).columns == frame.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame, folder).count() > 0


def test_pipeline_of_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(tmp_path / "t", [], [])).count() == 0


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
    assert set(__spark_entry__.oracle_sql()) <= names


@pytest.mark.parametrize("name", ["op3_mixing", "op4_projections"])
def test_oracles_name_the_columns(name):
    assert name in __spark_entry__.oracle_sql()
