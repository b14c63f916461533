"""The quality classifier and the chat formatter against slow, plain restatements."""

import json
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import chat, quality
from tests.llm.texts import SCHEMA, awkward, sentence

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_features(text):
    text = text or ""
    raw = text.encode()
    size = max(len(raw), 1)
    symbols = set(b"%*$&#@~^=+<>_\\/")
    count = lambda test: sum(map(test, raw)) / size
    named = [
        count(lambda b: 65 <= b <= 90), count(lambda b: b == 33), count(lambda b: b == 124), count(lambda b: b in symbols),
        count(lambda b: 48 <= b <= 57), count(lambda b: b == 46), count(lambda b: b == 44),
    ]
    plain = lambda b: 97 <= b <= 122 or 65 <= b <= 90 or 48 <= b <= 57 or b in symbols or b in b"!|.,"
    named += [count(lambda b: 33 <= b < 127 and not plain(b)), count(lambda b: b >= 128)]
    words = [w.encode() for w in re.split(f"[{SPACES}]+", text) if w]
    n = max(len(words), 1)
    # lines of the same words count as one line, whatever the order
    lines = [tuple(sorted(w for w in re.split(f"[{SPACES}]+", line) if w)) for line in text.split("\n")]
    lines = [line for line in lines if line]
    most = max((words.count(w) for w in set(words)), default=0) if len(words) < 3000 else None
    return [
        math.log1p(len(raw)), *named,
        sum(map(len, words)) / n, sum(len(w) <= 3 for w in words) / n, sum(len(w) >= 15 for w in words) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, len(set(words)) / n, most if most is None else most / n,
        len(lines) / n, 1 - len(set(lines)) / max(len(lines), 1),
    ]


def test_features_one_text_at_a_time():
    texts = [r[1] for r in awkward()] + ["Ab, c! c! |x| 12\n\nAb, c!\nAb, c! d", "a b\na b\nb a"]
    got = quality.features(texts)
    for row, text in zip(got, texts, strict=True):
        for name, have, want in zip(quality.FEATURES, row, plain_features(text), strict=True):
            assert want is None or abs(have - want) < 1e-9, (name, text)


def plain_cut(g, h, cells):
    """Best cut of some bins into two, every one tried: (gain, left bins, right bins)."""
    def worth(part):
        total, weight = sum(g[i] for i in part), sum(h[i] for i in part)
        return total * total / (weight + quality.RIDGE)

    return max(((worth(cells[:k]) + worth(cells[k:]) - worth(cells), cells[:k], cells[k:]) for k in range(1, len(cells))), default=(0, cells, []))


def test_trees_against_every_cut():
    rnd = np.random.default_rng(3)
    for _ in range(60):
        n = int(rnd.integers(2, 12))
        g, h = rnd.standard_normal(n), rnd.random(n) + 0.1
        ranges = [list(range(n))]
        for _ in range(2):
            gain, part = max(((plain_cut(g, h, r)[0], r) for r in ranges if len(r) > 1), default=(0, None), key=lambda x: x[0])
            if part is None or gain <= 1e-6:
                break
            _, left, right = plain_cut(g, h, part)
            ranges.remove(part)
            ranges += [left, right]
        want = np.empty(n)
        for part in ranges:
            want[part] = g[part].sum() / (h[part].sum() + quality.RIDGE)
        assert np.allclose(quality._line_tree(g, h), want)


def test_planes_against_every_pair_of_cuts():
    rnd = np.random.default_rng(4)
    for _ in range(40):
        a, b = (int(x) for x in rnd.integers(2, 6, 2))
        g, h = rnd.standard_normal((a, b)), rnd.random((a, b)) + 0.1
        worth = lambda s: g[s].sum() ** 2 / (h[s].sum() + quality.RIDGE)
        corners = [(slice(x), slice(y)) for x in (None,) for y in (None,)]
        best = max(
            sum(worth((r, c)) for r in (slice(0, i), slice(i, a)) for c in (slice(0, j), slice(j, b)))
            for i in range(a + 1)
            for j in range(b + 1)
        ) - worth(corners[0])
        tree, gain = quality._plane_tree(g, h)
        assert abs(gain - best) < 1e-9 and len(np.unique(tree)) <= 4


def test_scores_are_sums_of_table_entries():
    rnd = random.Random(2)
    texts = [sentence(rnd, rnd.randint(3, 60)) for _ in range(300)]
    labels = np.array([float(i % 3 > 0) for i in range(300)])
    texts = [t if y else t.upper() + "!!" for t, y in zip(texts, labels, strict=True)]
    rows = quality.features(texts)
    model = quality.fit(rows, labels)
    for row, score in zip(rows, model.score(rows), strict=True):
        total = model.base
        for x, edges, table in zip(row, model.edges, model.tables, strict=True):
            total += table[sum(x >= e for e in edges)]
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[sum(row[i] >= e for e in model.pair_edges[i]), sum(row[j] >= e for e in model.pair_edges[j])]
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-9


CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after string"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = {"add": {"type": "object", "required": ["x"], "properties": {"x": {"type": "number", "maximum": 9}}}}


def plain_lines(calls, results):
    """One conversation and one identifier after the other."""
    known = lambda r: r[0] is not None and r[1] is not None
    none_first = lambda r: [(v is not None, v if v is not None else 0) for v in r]
    rows = []
    names = {r[:2] for r in calls if known(r)}
    for key in sorted(names | {r[:2] for r in results if known(r)}):
        mine, answers = ([r[2:] for r in rs if r[:2] == key] for rs in (calls, results))
        call, result = (min(rs, key=none_first) if rs else None for rs in (mine, answers))
        depth, seen, at = 0, {key}, call and call[3]
        while call and at is not None and (key[0], at) in names:
            if (key[0], at) in seen:
                depth = None
                break
            seen.add((key[0], at))
            depth += 1
            at = min((r[2:] for r in calls if r[:2] == (key[0], at)), key=none_first)[3]
        if call is None:
            status, depth = "orphan", None
        elif result is None:
            status = "open"
        else:
            status = "early" if None not in (result[0], call[0]) and result[0] <= call[0] else "linked"
        wrong, line = ["$: no call"], {"id": key[1], "status": status}
        if call:
            value, wrong = chat.read_arguments(call[2])
            wrong = wrong or (["$: unknown tool"] if call[1] not in SCHEMAS else chat.problems(value, SCHEMAS[call[1]]))
            line["call"] = {"name": call[1], "arguments": call[2] if value is None else value}
        if result:
            line["result"] = result[1]
        line = json.dumps(line, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        turn = call[0] if call else result[0]
        rows.append((*key, depth, turn, status, len(mine), len(answers), not wrong, wrong, line))
    return rows


def test_random_conversations(spark):
    rnd = random.Random(8)
    ids = [f"c{i}" for i in range(6)]
    texts = ['{"x":1}', '{"x":10}', '{"x":"1"}', "{}", "no", '{"y":2,"x":1.50}', None, '{"x":1,"x":2}']
    calls, results = [], []
    for conv in [*range(40), None]:
        for _ in range(rnd.randint(0, 7)):
            calls.append((conv, rnd.choice([*ids, None]), rnd.randint(0, 9), rnd.choice(["add", "sub"]), rnd.choice(texts), rnd.choice([*ids, None, "gone"])))
        for _ in range(rnd.randint(0, 5)):
            results.append((conv, rnd.choice([*ids, None]), rnd.randint(0, 9), rnd.choice(["r", "", None])))
    calls += calls[:10]
    one = spark.createDataFrame(calls, CALLS).withColumn("depth", F.lit("clash"))
    got = [tuple(r) for r in chat.format_calls(one, spark.createDataFrame(results, RESULTS), SCHEMAS).collect()]
    want = plain_lines(calls, results)
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) > 100


def test_awkward_texts_have_scores(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    model = quality.Model(base=0.4)
    assert quality.scored(quality.feature_rows(docs), model).count() == len(awkward())
