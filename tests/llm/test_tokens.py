import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulsegrid.llm import codes, counts, packing, token_files
from tests.llm.texts import SCHEMA, awkward

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = list("abstrevdlm'' \n\t 12!?.éÉß ǅ½²٣") + [
    "İ", "ſ", "Σ", "̈", " ", "\xa0", "<|endoftext|>", "'s", "'re", "'ll", "  ", "中", "ｗ", "\x00", "\x85",
    "​", "_", "Ⅷ", "ª", "😀", "'S", "' s",
]


def library_ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def odd_texts(n=1500):
    rnd = random.Random(3)
    found = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randrange(0, 40))) for _ in range(n)]
    return [*found, "a" * 1000 + "'s" * 50, "ab" * 3000, " " * 50, "\n" * 7 + "x", "", None]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_and_counts_equal_the_library(path):
    texts = odd_texts()
    library = Tokenizer.from_file(path)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    ids, bounds = codes.Encoder(path).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    assert counts.Machine(path).count(texts).tolist() == [len(w) for w in want]


def test_blocks_tables_and_states_may_be_small(monkeypatch):
    texts = [t for t in odd_texts(200) if t] + [" ".join(map(str, range(500)))]
    library = Tokenizer.from_file(BYTE)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(codes, "BLOCK_CHARS", 50)
    monkeypatch.setattr(counts, "BLOCK_CHARS", 50)
    monkeypatch.setattr(codes, "TABLE_WORDS", 20)
    monkeypatch.setattr(counts, "MOST_STATES", 30)
    monkeypatch.setattr(counts, "CHUNK", 4)
    ids, bounds = codes.Encoder(BYTE).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    assert counts.Machine(BYTE).count(texts).tolist() == [len(w) for w in want]


def test_slices_cut_before_spaces_only():
    text = "ab  cd\n\nef" * 20
    parts = list(codes.slices(text, 7))
    assert "".join(parts) == text and len(parts) > 5
    assert all(p[0].isspace() and not q[-1].isspace() for p, q in zip(parts[1:], parts))


def clashing(docs):
    return docs.withColumn("ids", F.lit("x")).withColumn("part", F.lit(1)).withColumn("n_tokens", F.lit(0))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, tmp_path):
    docs = clashing(spark.createDataFrame(awkward(), SCHEMA))
    token_files.write_tokens(docs, str(tmp_path / "t"), WORD, end_id=2)
    got = [tuple(r) for r in token_files.digest(spark, str(tmp_path / "t")).orderBy("start").collect()]
    want, start = [], 0
    order = sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    for doc, text, *_ in order:
        ids = [*library_ids(WORD, text), 2]
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want


def test_token_files_are_read_selectively(spark, tmp_path):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    token_files.write_tokens(docs, str(tmp_path / "t"), WORD)
    plan = token_files.read_metadata(spark, str(tmp_path / "t"))._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[-1]
    import pyarrow.parquet as pq

    part = next((tmp_path / "t").glob("*.parquet"))
    columns = pq.ParquetFile(part).metadata.row_group(0)
    found = {columns.column(i).path_in_schema: columns.column(i) for i in range(columns.num_columns)}
    assert "RLE_DICTIONARY" in found["ids.list.element"].encodings
    assert "DELTA_BINARY_PACKED" in found["doc_id"].encodings
    assert found["doc_id"].has_column_index and found["ids.list.element"].has_offset_index


def test_token_counts(spark):
    docs = clashing(spark.createDataFrame(awkward(), SCHEMA))
    got = sorted(map(tuple, counts.token_counts(docs, WORD, limit=100).collect()), key=str)
    want = []
    for doc, text, *_ in awkward():
        n = len(library_ids(WORD, text))
        want.append((doc, len((text or "").encode()), n, n > 100))
    assert got == sorted(want, key=str)


def test_packing(spark, tmp_path):
    docs = clashing(spark.createDataFrame(awkward(), SCHEMA))
    packing.write_buckets(packing.pieces(docs, BYTE, longest=1024), str(tmp_path / "p"))
    rows = packing.digest(spark, str(tmp_path / "p")).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    assert {r.sequence_id for r in rows} == set(range(len(rows)))
    want = []
    for doc, text, *_ in awkward():
        ids = [*library_ids(BYTE, text), 0]
        at = 0
        while at < len(ids):
            size = 1024
            while size > len(ids) - at:
                size //= 2
            want.append((doc, at, size, crc(ids[at : at + size]), len(ids)))
            at += size
    got = [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    by_length = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.length for r in by_length] == sorted((r.length for r in rows), reverse=True)


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    token_files.write_tokens(docs, str(tmp_path / "t"), WORD)
    assert token_files.digest(spark, str(tmp_path / "t")).count() == 0
    assert counts.token_counts(docs, WORD).count() == 0
    packing.write_buckets(packing.pieces(docs, BYTE), str(tmp_path / "p"))
    assert packing.digest(spark, str(tmp_path / "p")).count() == 0


def test_longest_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError, match="power of two"):
        packing.pieces(spark.createDataFrame([], SCHEMA), BYTE, longest=1000)


def test_words_are_looked_up_by_whole_arrays():
    rnd = np.random.default_rng(3)
    keys = np.unique(np.concatenate([rnd.integers(0, 1 << 63, 5000), np.arange(1, 3000)]).astype(np.uint64))
    near = np.uint64(pow(codes.FACTOR, -1, 1 << 64)) * np.arange(1, 400, dtype=np.uint64)  # all for one slot
    keys = rnd.permutation(np.unique(np.concatenate([keys, near])))
    table, known = codes.Places(bits=2), {}
    for part in np.array_split(keys[: len(keys) // 2], 7):
        assert (table.get(part) == -1).all()
        values = np.arange(len(known), len(known) + len(part), dtype=np.int32)
        table.put(part, values)
        known |= dict(zip(part.tolist(), values.tolist(), strict=True))
        assert table.get(keys).tolist() == [known.get(k, -1) for k in keys.tolist()]


def test_known_words_cost_no_library_calls(monkeypatch):
    code = codes.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one two  two, three", "", "four " * 50 + "x" * 80, "one\n\ntwo ÿ é"]
    first = code.encode(texts)
    monkeypatch.setattr(code, "_add", None)  # calling it would fail
    again = code.encode(texts[::-1])
    assert [again[0][a:b].tolist() for a, b in zip(again[1][:-1], again[1][1:])][::-1] == [
        first[0][a:b].tolist() for a, b in zip(first[1][:-1], first[1][1:])
    ]
    expected = [code.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert first[0].tolist() == sum(expected, [])
