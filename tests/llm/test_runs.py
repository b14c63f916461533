import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from pulsegrid.llm import periodic_runs
from tests.llm.texts import SCHEMA, awkward


def plain_runs(x):
    """Every period is tried at every place."""
    n, found = len(x), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q) and not any(all(x[t] == x[t + p] for t in range(i, j + q - p)) for p in range(1, q)):
                found.add((i, j + q - i, q))
            i = j + 1
    return sorted(found)


def mixture(rnd, limit=260):
    n, x = rnd.randint(0, limit), []
    while len(x) < n:
        kind = rnd.random()
        if kind < 0.3:
            x += [rnd.randrange(3) for _ in range(rnd.randint(1, 20))]
        elif kind < 0.6:
            unit = [rnd.choice([0, 0, 0, 0, 1]) if rnd.random() < 0.8 else rnd.randrange(50) for _ in range(rnd.randint(1, 45))]
            x += (unit * 6)[: rnd.randint(1, 5 * len(unit))]
        elif kind < 0.8:
            x += ([0] * rnd.randint(1, 40) + [1]) * rnd.randint(1, 5)
        else:
            x += [rnd.randrange(1000) for _ in range(rnd.randint(1, 30))]
    return x


def test_runs_against_brute_force():
    rnd, seen = random.Random(1), 0
    for _ in range(600):
        x = mixture(rnd)
        want = plain_runs(x)
        seen += len(want)
        assert periodic_runs.find_runs(np.array(x, np.int64)) == want
    assert seen > 500


def test_lying_hashes_are_found_out(monkeypatch):
    monkeypatch.setattr(periodic_runs._Hashes, "equal", lambda self, a, lag, length: np.ones(len(a), bool))
    rnd = random.Random(2)
    for _ in range(100):
        x = mixture(rnd)
        assert periodic_runs.find_runs(np.array(x, np.int64)) == plain_runs(x)


@pytest.mark.parametrize("period", [15, 16, 17, 31, 32, 500, 4097, 20_000])
def test_long_periods(period):
    rnd = random.Random(period)
    unit = [rnd.randrange(10**6) for _ in range(period)]
    head = [-1] * 3
    x = np.array(head + (unit * 4)[: 3 * period + period // 2 + 30], np.int64)
    assert periodic_runs.find_runs(x) == [(3, len(x) - 3, period)]
    assert periodic_runs.find_runs(x[: 3 + 3 * period - 1]) == []


def test_one_word_repeated_and_nested_periods():
    assert periodic_runs.find_runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    inner = [0] * 30 + [1] * 30  # runs within each period of a longer one
    x = np.array(inner * 20, np.int64)
    found = periodic_runs.find_runs(x)
    assert (0, 1200, 60) in found and len(found) == 41


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + k for s, k, q in runs)]
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    ends = [*best, 1000 * best[1] // best[2]] if best else [None] * 4
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    return (doc_id, len(runs), *ends, *(hashlib.sha256(t.encode()).hexdigest() for t in (lines, " ".join(kept))))


def test_query_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [r for r in awkward() if len(r[1] or "") < 5000]
    rows += [(1000 + i, " ".join(map(str, mixture(rnd, 120))), "en", "s", 0) for i in range(150)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS runs", "2 AS n_runs", "'x' AS collapsed", "3 AS h")
    got = periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_repeats(docs)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    def nulls(r):
        return tuple((v is None, v or 0) for v in r[:6]) + r[6:]

    assert sorted(map(nulls, map(tuple, got.collect()))) == sorted(nulls(plain_row(r[0], r[1])) for r in rows)


def test_blocks_do_not_matter(spark, monkeypatch):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    want = sorted(map(repr, periodic_runs.periodic_runs(docs).collect()))
    texts = [(r[1] or "").encode().split() for r in awkward()]
    one = [periodic_runs._block([t])[0] for t in texts]
    assert periodic_runs._block(texts) == one
    assert len(want) == len(awkward())


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_repeats(docs))).count() == 0
