import json

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import chat

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after string"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = {"add": {"type": "object", "required": ["x"], "properties": {"x": {"type": "number", "maximum": 9}}}}


def formatted(spark, calls, results):
    one = spark.createDataFrame(calls, CALLS).withColumn("depth", F.lit("clash")).withColumn("status", F.lit(1))
    two = spark.createDataFrame(results, RESULTS).withColumn("depth", F.lit("clash"))
    return {(r.conv_id, r.call_id): r for r in chat.format_calls(one, two, SCHEMAS).collect()}


def test_links_order_validity_and_json(spark):
    calls = [
        (1, "a", 0, "add", '{"x": 1, "é": [1.5, null]}', None),
        (1, "b", 2, "add", '{"x": 10}', "a"),
        (1, "c", 4, "add", "{}", "b"),
        (1, "d", 5, "other", '{"x": 1}', "nowhere"),
        (1, "e", 9, "add", '{"x": NaN}', "f"),
        (1, "f", 9, "add", '{"x": 1, "x": 2}', "e"),
        (1, "g", 9, "add", None, "e"),
        (1, "h", 7, "add", '{"x": 1e999}', "h"),
        (2, "a", 3, "add", '{"x": 2}', None),
        (2, "a", 1, "add", '{"x": 3}', None),
        (2, "a", 1, "add", '{"x": 3}', None),
        (None, "a", 1, "add", "{}", None),
        (3, None, 1, "add", "{}", None),
    ]
    results = [(1, "a", 1, "one"), (1, "a", 3, "late"), (1, "b", 2, None), (1, "z", 8, "?"), (2, "a", 2, ""), (None, "a", 1, "")]
    got = formatted(spark, calls, results)
    assert set(got) == {(1, x) for x in "abcdefghz"} | {(2, "a")}
    row = got[1, "a"]
    assert (row.depth, row.status, row.valid, row.n_results) == (0, "linked", True, 2)
    want = {"id": "a", "status": "linked", "call": {"name": "add", "arguments": {"x": 1, "é": [1.5, None]}}, "result": "one"}
    assert row.line == json.dumps(want, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert {k: got[1, k].depth for k in "bcdefghz"} == {"b": 1, "c": 2, "d": 0, "e": None, "f": None, "g": None, "h": None, "z": None}
    assert {k: got[1, k].status for k in "bcz"} == {"b": "early", "c": "open", "z": "orphan"}
    wrong = {k: got[1, k].problems for k in "bcdefghz"}
    assert wrong["b"] == ["$.x: above maximum"] and wrong["c"] == ["$.x: missing"] and wrong["d"] == ["$: unknown tool"]
    assert all(wrong[k] == ["$: not JSON"] for k in "efh") and wrong["g"] == ["$: no arguments"] and wrong["z"] == ["$: no call"]
    assert json.loads(got[1, "e"].line)["call"]["arguments"] == '{"x": NaN}'
    assert (got[2, "a"].turn, got[2, "a"].n_calls, got[2, "a"].status) == (1, 3, "linked")


def test_long_chain(spark):
    calls = [(1, f"c{i}", i, "add", '{"x":1}', f"c{i - 1}" if i else None) for i in range(70)]
    got = formatted(spark, calls, [])
    assert [got[1, f"c{i}"].depth for i in range(70)] == list(range(70))


def test_nothing(spark):
    assert formatted(spark, [], []) == {}
    assert formatted(spark, [], [(1, "a", 0, "x")])[1, "a"].status == "orphan"


def test_plain_conversations(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "user", "a b"), (1, 2, "assistant", "c"), (1, 3, "user", None), (2, 0, "assistant", "x"), (1, 5, None, "é")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.call_id): r for r in chat.format_calls(*chat.turns_as_calls(messages), chat.ANSWER).collect()}
    assert {k: (r.status, r.depth, r.valid) for k, r in got.items()} == {
        (1, "call-0"): ("open", 0, True),
        (1, "call-1"): ("linked", 0, True),
        (1, "call-3"): ("open", 1, False),
        (1, "call-5"): ("open", 2, True),
        (2, "call--1"): ("orphan", None, False),
    }
    assert got[1, "call-1"].line == '{"call":{"arguments":{"text":"a b","turn":1,"words":2},"name":"answer"},"id":"call-1","result":"c","status":"linked"}'


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"type": "integer", "minimum": 1}, 1, 0),
        ({"type": "integer"}, 3, True),
        ({"type": ["string", "null"]}, None, 1.5),
        ({"enum": ["a", 2]}, 2, 3),
        ({"type": "string", "minLength": 1, "maxLength": 2}, "ab", "abc"),
        ({"type": "array", "items": {"type": "boolean"}}, [True], [1]),
        ({"type": "object", "additionalProperties": False, "properties": {"a": {}}}, {"a": 1}, {"b": 1}),
    ],
)
def test_schemas(schema, good, bad):
    assert chat.problems(good, schema) == [] and chat.problems(bad, schema)


@pytest.mark.parametrize("text", ['{"x":"\\ud800"}', '"\\udc00"', '{"\\ud800":1}', "[" * 100_000, "1e999", "NaN", "9" * 5000, '{"a":1,"a":1}'])
def test_texts_that_no_line_can_hold(spark, text):
    schema = "conv_id long, call_id string, turn long, name string, arguments string, after string"
    calls = spark.createDataFrame([(1, "c", 0, "t", text, None)], schema)
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    row = chat.format_calls(calls, results, {"t": {}}).collect()[0]
    assert not row.valid and row.problems == ["$: not JSON"] and json.loads(row.line)["call"]["arguments"] == text


def test_enums_compare_kinds_and_large_numbers_are_numbers():
    assert chat.problems(1, {"enum": [True]}) == ["$: not in enum"]
    assert chat.problems(True, {"enum": [1, "true"]}) == ["$: not in enum"]
    assert chat.problems([0, {"a": False}], {"enum": [[0, {"a": 0}]]}) == ["$: not in enum"]
    assert chat.problems(1.0, {"enum": [1]}) == [] and chat.problems(None, {"enum": [None]}) == []
    assert chat.problems(10**400, {"type": "number", "minimum": 5}) == []
