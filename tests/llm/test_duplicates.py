import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import components as cc
from pulsegrid.llm import projections, shingle_join, windows
from tests.llm.texts import SCHEMA, awkward, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def union_find(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(i) for i in range(n)]


def named(ids, roots):
    least = {}
    for i, r in zip(ids, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(r) for r in roots]


def shingles(text, n=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute_groups(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    links = []
    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if common and 100 * common >= percent * (len(x) + len(sets[j]) - common):
                links.append((j, i))
    ids = [d for d, _ in rows]
    return sorted(((d, len(s), c) for d, s, c in zip(ids, sets, named(ids, union_find(len(rows), links)))), key=str)


def groups(docs, **options):
    found = shingle_join.similar_groups(docs, **options).select("doc_id", "n_shingles", "component_id")
    return sorted(map(tuple, found.collect()), key=str)


def near_copies(n, words=60):
    import random

    rnd = random.Random(n)
    base = sentence(rnd, words).split()
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(rnd.randint(0, 4)):
            own[rnd.randrange(words)] = f"w{rnd.randrange(50)}"
        rows.append((i, " ".join(own), None, None, None))
    common = sentence(rnd, 12)
    rows += [(1000 + i, f"{common} {sentence(rnd, rnd.randint(2, 40))}", None, None, None) for i in range(n)]
    return rows


@pytest.mark.parametrize("rows", [awkward(), near_copies(60)], ids=["awkward", "near"])
def test_similar_groups(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("set_id", F.lit("clash")).withColumn("size", F.lit(0))
    assert groups(docs) == brute_groups([r[:2] for r in rows])


@pytest.mark.parametrize("short", [2, 3])
def test_long_columns_alone_find_all_links(spark, monkeypatch, short):
    monkeypatch.setattr(shingle_join, "SHORT_COLUMN", short)
    rows = near_copies(40, 30)
    assert groups(spark.createDataFrame(rows, SCHEMA), blocks=3) == brute_groups([r[:2] for r in rows])


def test_order_of_shingles_does_not_matter(spark, monkeypatch):
    rows = near_copies(40, 30)
    monkeypatch.setattr(shingle_join, "frequent_shingles", lambda docs, n: np.empty(0, np.uint64))
    assert groups(spark.createDataFrame(rows, SCHEMA)) == brute_groups([r[:2] for r in rows])


def test_one_of_each(spark):
    rows = awkward()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("_id", F.lit(5)).withColumn("group", F.lit(5))
    kept = shingle_join.one_of_each(docs)
    assert kept.columns == docs.columns
    worded = [r for r in rows if shingles(r[1])]
    roots = Counter()
    sets = [shingles(r[1]) for r in worded]
    links = [(j, i) for i, x in enumerate(sets) for j in range(i) if 100 * len(x & sets[j]) >= 75 * len(x | sets[j])]
    roots = set(union_find(len(worded), links))
    assert kept.count() == len(roots) + len(rows) - len(worded)


def test_groups_of_nothing(spark):
    assert groups(spark.createDataFrame([], SCHEMA)) == []
    none = [(1, None, "", "", 0), (2, "", "", "", 0)]
    assert groups(spark.createDataFrame(none, SCHEMA)) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rnd = np.random.default_rng(4)
    links = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(99, i) for i in range(60)],
        "random": [tuple(map(int, p)) for p in rnd.integers(0, 150, (100, 2))],
        "none": [],
    }[shape]
    frame = spark.createDataFrame([*links, *links[:3], (None, 3), (7, None)], "a long, b long")
    got = dict(map(tuple, cc.components(frame).collect()))
    roots = union_find(200, links)
    nodes = {n for p in links if p[0] != p[1] for n in p}
    assert got == {n: roots[n] for n in nodes}


def brute_windows(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (doc, _), raw in zip(rows, raws):
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "wide"), [(200, 1000), (200, 0), (60, 3), (50, 1000)])
def test_repeated_windows(spark, length, wide):
    rows = awkward()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("clash")).withColumn("id", F.lit(0))
    found = windows.cleaned(docs, length, wide=wide)
    got = found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute_windows([r[:2] for r in rows], length)


def test_windows_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", 300)
    rows = [(1, "ab" * 700, "", "", 0), (2, sentence(__import__("random").Random(1), 300) * 2, "", "", 0)]
    raws = [r[1].encode() for r in rows]
    for raw, runs in windows._blocks(raws, 200):
        assert (runs[:, 3] <= 300).all() and len(raw) >= 200
    found = windows.cleaned(spark.createDataFrame(rows, SCHEMA), 200)
    got = found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute_windows([r[:2] for r in rows], 200)


def test_windows_of_nothing(spark):
    assert windows.cleaned(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError, match="at least"):
        windows.cleaned(spark.createDataFrame([], SCHEMA), 20).count()


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n=300, size=16):
    rnd = np.random.default_rng(5)
    base = rnd.standard_normal((n, size))
    near = base[:80] + 0.15 * rnd.standard_normal((80, size))
    hot = base[7] + 0.2 * rnd.standard_normal((60, size))
    rows = [(i, v.astype("f4").tolist(), 0) for i, v in enumerate(np.concatenate([base, near, hot, base[:20]]))]
    some = rows[3][1]
    rows += [rows[3], rows[3], (None, some, 1), (9001, None, 1), (9002, [0.0] * size, 1), (9003, [float("nan")] * size, 1)]
    rows += [(9004, [None, *some[1:]], 1), (9005, [float("inf"), *some[1:]], 1), (9006, some[:5], 1), (9007, [], 1)]
    return [*rows, (9008, [2 * x for x in some], 1), (None, None, None)]


def ok(v):
    return bool(v) and None not in v and np.isfinite(v).all() and any(v)


def test_near_duplicates(spark):
    rows = vectors()
    frame = spark.createDataFrame(rows, VECTORS).withColumn("node", F.lit("clash")).withColumn("size", F.lit(0))
    unit = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if ok(r[1]) else None for r in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i + 1, len(rows))
        if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95 - 1e-12
    ]
    degree = Counter(x for p in links for x in p)
    ids = [r[0] for r in rows]
    names = named(ids, union_find(len(rows), links))
    want = sorted(((i, degree[k], c, i == c) for k, (i, c) in enumerate(zip(ids, names))), key=str)
    got = sorted(map(tuple, projections.near_duplicates(frame).collect()), key=str)
    found, true = sum(x[1] for x in got), sum(x[1] for x in want)
    assert found >= 0.99 * true and all(a[1] <= b[1] for a, b in zip(got, want)) or got == want


def test_plan_reaches_its_recall():
    for n in (1, 100, 10**5, 10**9):
        signs, lines = projections.plan(n, 0.95, 0.999)
        assert signs >= 0 and 2 <= lines < 400


def test_near_duplicates_of_nothing(spark):
    assert projections.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    none = spark.createDataFrame([(1, None, 0), (2, [0.0], 0)], VECTORS)
    assert sorted(map(tuple, projections.near_duplicates(none).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_pivots_are_the_least_changed_sets():
    sizes = np.array([100] * 12 + [120] * 10, np.int32)  # of two levels next to each other
    names = np.arange(22, dtype=np.int64)
    rare = np.array([9, 8, 7, 1, *range(20, 28), *range(50, 55), 2, *range(60, 64)], np.uint8)
    columns = [np.full(22, 5, np.uint64), names, sizes, rare]
    block = pa.table({k: [c.tobytes()] for k, c in zip(("shingles", "names", "sizes", "rare"), columns)})
    found = shingle_join._product(75)(block).to_pandas()
    stars = {(r.a, r.b) for r in found[found.kind == 1].itertuples()}
    near, far = 3, 17
    expected = {tuple(sorted((near, i))) for i in range(12) if i != near}
    expected |= {tuple(sorted((far, i))) for i in range(12, 22) if i != far} | {(near, far)}
    assert stars == expected


def test_contested_entries_keep_every_pair_that_shares_enough(spark):
    rnd = np.random.default_rng(7)
    sizes = rnd.integers(50, 58, 40)
    groups_of = rnd.integers(0, 12, 40)
    entries = {(int(s), int(n)) for n in range(40) for s in rnd.choice(20, rnd.integers(1, 14), replace=False)}
    short = [(int(a), int(b), int(m)) for a, b, m in zip(range(0, 38, 3), range(1, 39, 3), rnd.integers(0, 4, 13))]
    long = spark.createDataFrame(
        [(s, n, int(sizes[n]), int(groups_of[n])) for s, n in entries], "shingle long, node long, size int, component long"
    )
    met = spark.createDataFrame(short, "a long, b long, met long")
    left = {(r.shingle, r.node) for r in shingle_join._contested(long, met, 75).collect()}
    assert left <= entries and len(left) < len(entries)
    counts = {(a, b): m for a, b, m in short}
    similar = 0
    for a in range(40):
        for b in range(a + 1, 40):
            shared = {s for s, n in entries if n == a} & {s for s, n in entries if n == b}
            low, high = sorted((int(sizes[a]), int(sizes[b])))
            if groups_of[a] == groups_of[b] or low * 100 < high * 75 or not shared:
                continue
            if len(shared) + counts.get((a, b), 0) >= shingle_join.least_met(low, high, 75):
                similar += 1
                assert all((s, n) in left for s in shared for n in (a, b))
    assert similar


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rnd = np.random.default_rng(2)
    base = np.unique(rnd.integers(0, 1 << 63, 150)).astype(np.uint64)
    sets = [np.empty(0, np.uint64), base]
    for k in (1, 5, 30, 60, 3000):
        own = np.unique(rnd.integers(0, 1 << 63, k)).astype(np.uint64)
        sets.append(np.sort(np.concatenate([base[min(k, 150) // 2 :], own])))
    bits = np.unpackbits(shingle_join.sketches(sets).view(np.uint8), axis=1).astype(int)
    assert bits.shape == (len(sets), 64 * shingle_join.SKETCH) and not bits[0].any()
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            differ = len(np.setxor1d(x, y))
            assert np.abs(bits[i] - bits[j]).sum() <= differ
            assert np.abs(bits[i] - bits[j]).sum() > 0.75 * differ - 2 or differ > 200
    assert shingle_join.sketches([]).shape == (0, shingle_join.SKETCH)


def test_unlike_sets_of_long_columns_are_not_joined(spark, monkeypatch):
    rnd = __import__("random").Random(8)
    base, far = sentence(rnd, 150).split(), 60

    def changed(places, name):
        own = list(base)
        for i in places:
            own[i] = f"{name}x{i}"
        return " ".join(own)

    # copies near the text, and such as miss the bound by a few shingles: each shares columns with all of them
    texts = [changed([3 + 2 * (i % 60)], f"n{i}") for i in range(far)]
    texts += [changed(sorted(rnd.sample(range(10, 140, 9), 4)), f"f{i}") for i in range(far)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    asked, whole = [], shingle_join._linked
    monkeypatch.setattr(shingle_join, "_linked", lambda pairs, *rest: asked.append(pairs) or whole(pairs, *rest))
    assert groups(docs) == brute_groups(list(enumerate(texts)))
    assert asked[1].count() < 600  # 1966 without sketches
