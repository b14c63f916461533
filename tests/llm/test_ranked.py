import math
import re
from collections import Counter

import duckdb
import pytest

from pulsegrid.llm import ranked_search
from tests.llm.texts import SCHEMA, awkward, sentence

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_ranking(docs, items, k=10):
    """Every document is scored for every item, by the formula."""
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    number, total = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms_of(text))
    rows = []
    for item, terms in asked.items():
        scores = []
        for doc, tf, n in counts:
            m = 100 - 90 + 90 * n * number // total
            score = 0
            for t in terms:
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        for rank, (score, none, doc) in enumerate(sorted(scores)[:k], 1):
            rows.append((item, rank, None if none else doc, -score))
    return rows


def key(row):
    return tuple((v is None, v or 0) for v in row)


def tables(spark):
    import random

    rnd = random.Random(5)
    docs = [*awkward(), *[(500 + i, sentence(rnd, rnd.randint(1, 300)), "en", "s", 0) for i in range(200)]]
    items = [(i, docs[3 * i][1]) for i in range(40)] + [(None, "one two"), (7, "x y z"), (7, "x y z"), (90, None), (91, "~ !"), (92, "nowherefound")]
    return docs, items


def ranked(spark, docs, items, k=10):
    docs = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 AS term", "2 AS m", "3 AS n", "4 AS item_id", "5 AS score")
    asked = ranked_search.item_terms(spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS term", "2 AS n"))
    found = ranked_search.search(ranked_search.build_index(docs, asked), asked, k)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return [tuple(r) for r in found.collect()]


@pytest.mark.parametrize("block,first", [(4096, 4096), (3, 1)])
def test_against_brute_force(spark, monkeypatch, block, first):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", block)
    monkeypatch.setattr(ranked_search, "FIRST_DOCS", first)
    docs, items = tables(spark)
    got = ranked(spark, docs, items)
    want = plain_ranking([(d[0], d[1]) for d in docs], items)
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 200


def test_sql_says_the_same(spark, tmp_path):
    docs, items = tables(spark)
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/b")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    db.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/b/*.parquet'")
    want = plain_ranking([(d[0], d[1]) for d in docs], items)
    assert sorted(db.execute(ranked_search.ORACLE).fetchall(), key=key) == sorted(want, key=key)


def test_a_hot_group_of_copies(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 16)
    docs = [(i, "the same words in every copy", "en", "s", 0) for i in range(300)]
    docs += [(300 + i, f"other words {i} here", "en", "s", 0) for i in range(50)]
    items = [(1, "copy words"), (2, "17 33"), (3, "words")]
    assert sorted(ranked(spark, docs, items)) == sorted(plain_ranking([(d[0], d[1]) for d in docs], items))


def test_rows_of_a_visit_do_not_grow_with_the_lengths(spark, monkeypatch):
    """Every document has a length, and so a block, of its own; an item gets its best of a chunk, not of a block."""
    monkeypatch.setattr(ranked_search, "FIRST_DOCS", 1)
    made, scored = [], ranked_search._scored

    def counted(visits, blocks, k):
        found = scored(visits, blocks, k)
        made.append(found.count())
        return found

    monkeypatch.setattr(ranked_search, "_scored", counted)
    docs = [(i, "same " + "other " * i, "en", "s", 0) for i in range(300)]
    items = [(1, "same"), (2, "other"), (3, "same other")]
    assert sorted(ranked(spark, docs, items, 2)) == sorted(plain_ranking([(d[0], d[1]) for d in docs], items, 2))
    assert sum(made) <= 2 * 2 * len(items) * 8  # two phases, two of an item in each task's chunk


@pytest.mark.parametrize("chunk", [1, 7])
def test_chunks_of_any_size_rank_the_same(spark, monkeypatch, chunk):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 3)
    monkeypatch.setattr(ranked_search, "CHUNK_DOCS", chunk)
    docs, items = tables(spark)
    got = ranked(spark, docs, items)
    assert sorted(got, key=key) == sorted(plain_ranking([(d[0], d[1]) for d in docs], items), key=key)


def test_filter_lets_every_wanted_term_through(spark):
    asked = ranked_search.item_terms(spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(5000)))], "item_id long, text string"))
    bits = ranked_search._filter(asked)
    codes = [r.term for r in asked.select("term").collect()]
    assert all(bits[c % ranked_search.FILTER_BITS] for c in codes) and bits.sum() <= 5000
    zero = spark.createDataFrame([(0,), (32768,), (32769,), (-1,)], "term long")
    assert set(ranked_search._filter(zero).nonzero()[0].tolist()) == {0, 32768, 32769, ranked_search.FILTER_BITS - 1}


def test_whole_index_without_a_filter(spark):
    docs, items = tables(spark)
    index = ranked_search.build_index(spark.createDataFrame(docs, SCHEMA))
    asked = ranked_search.item_terms(spark.createDataFrame(items, "item_id long, text string"))
    got = [tuple(r) for r in ranked_search.search(index, asked, 3).collect()]
    assert sorted(got, key=key) == sorted(plain_ranking([(d[0], d[1]) for d in docs], items, 3), key=key)


def test_empty(spark):
    docs, items = tables(spark)
    assert ranked(spark, [], items) == []
    assert ranked(spark, docs, []) == []
    assert ranked(spark, [(1, "!", "", "", 0), (2, None, "", "", 0)], items) == []
