"""Chat formatting with linked tool calls.

Calls and results are joined by identifier, calls are put in the order of what they wait for, arguments
are validated against the schema of their tool, and every link becomes one line of canonical JSON: keys
sorted, no spaces, nothing escaped that need not be.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import fresh_folder

KINDS = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: not isinstance(v, bool) and (isinstance(v, int) or isinstance(v, float) and math.isfinite(v)),
    "boolean": lambda v: isinstance(v, bool),
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "null": lambda v: v is None,
}


def equal(a, b) -> bool:
    """Whether two JSON values are the same; 1 and 1.0 are, 1 and true are not."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    return a == b


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What a value breaks in a schema (type, enum, minimum, maximum, minLength, maxLength, required,
    properties, additionalProperties false, items), sorted."""
    kind = schema.get("type")
    if kind and not any(KINDS[k](value) for k in ([kind] if isinstance(kind, str) else kind)):
        return [f"{at}: not {kind}"]
    found = []
    if "enum" in schema and not any(equal(value, e) for e in schema["enum"]):
        found.append(f"{at}: not in enum")
    if KINDS["number"](value):
        found += [f"{at}: below minimum"] * (value < schema.get("minimum", value))
        found += [f"{at}: above maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, str):
        found += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0))
        found += [f"{at}: too long"] * (len(value) > schema.get("maxLength", len(value)))
    if isinstance(value, dict):
        fields = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for key, own in value.items():
            if key in fields:
                found += problems(own, fields[key], f"{at}.{key}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{key}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, own in enumerate(value):
            found += problems(own, schema["items"], f"{at}[{i}]")
    return sorted(found)


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; numbers that are not finite are refused."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def read_arguments(text: str | None) -> tuple[object, list[str]]:
    """Parsed arguments and what is wrong with the text.

    Equal keys, infinite numbers and escapes of half a character, which no UTF-8 text can hold, are refused.
    """

    def pairs(items):
        found = dict(items)
        if len(found) < len(items):
            raise ValueError("repeated key")
        return found

    def number(text: str) -> float:
        if not math.isfinite(value := float(text)):
            raise ValueError("number out of range")
        return value

    def refuse(name: str):
        raise ValueError(f"{name} is no number")

    if text is None:
        return None, ["$: no arguments"]
    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_float=number, parse_constant=refuse)
        canonical(value).encode()
        return value, []
    except (ValueError, RecursionError):
        return None, ["$: not JSON"]


def _stored(frame: DataFrame, name: str) -> DataFrame:
    folder = fresh_folder(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.parquet(folder)


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row per (conv_id, call_id): the call of the lowest turn, its result, and how they fit.

    ``status``: linked; early (the result's turn is not after the call's); open (no result);
    orphan (a result without a call). ``n_calls`` and ``n_results`` count repeats. Of equal turns the
    smallest row counts. Rows without a conv_id or call_id are not linked and not returned.
    """
    known = "conv_id IS NOT NULL AND call_id IS NOT NULL"
    body = F.min(F.struct("turn", "name", "arguments", "after")).alias("call")
    one = calls.filter(known).groupBy("conv_id", "call_id").agg(body, F.count(F.lit(1)).alias("n_calls"))
    body = F.min(F.struct("turn", "content")).alias("result")
    two = results.filter(known).groupBy("conv_id", "call_id").agg(body, F.count(F.lit(1)).alias("n_results"))
    both = one.join(two, ["conv_id", "call_id"], "full_outer")
    late = F.col("result.turn") <= F.col("call.turn")
    status = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "open")
    return both.select(
        "conv_id",
        "call_id",
        "call",
        "result",
        status.when(late, "early").otherwise("linked").alias("status"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_calls", "n_results")],
    )


def depths(links: DataFrame) -> DataFrame:
    """Rows (conv_id, call_id, depth): how many calls one after another a call waits for.

    A call waits for the one named in ``after``; a name that is no call of the conversation counts as
    none, and calls in a circle, or that wait for one, have no depth. Waiting is followed by doubling,
    so a chain of any length takes a logarithm of rounds, each written to the shared folder.
    """
    calls = links.filter("n_calls > 0").select("conv_id", "call_id", F.col("call.after").alias("after"))
    names = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("known"))
    state = calls.join(names, ["conv_id", "after"], "left").select(
        "conv_id",
        "call_id",
        F.when(F.col("known"), F.col("after")).alias("next"),
        F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth"),
    )
    state = _stored(state, "depths")
    waiting = None
    limit = max(1, state.count()).bit_length() + 1
    for _ in range(limit):
        waiting = state.filter("next IS NOT NULL").count()
        if not waiting:
            break
        ahead = state.select("conv_id", F.col("call_id").alias("next"), F.col("next").alias("_next"), F.col("depth").alias("_depth"))
        state = _stored(
            state.join(ahead, ["conv_id", "next"], "left").select(
                "conv_id",
                "call_id",
                F.col("_next").alias("next"),
                (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            ),
            "depths",
        )
    return state.select("conv_id", "call_id", F.when(F.col("next").isNull(), F.col("depth")).alias("depth"))


LINES = "conv_id long, call_id string, depth long, turn long, status string, n_calls long, n_results long, valid boolean, problems array<string>, line string"


def format_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call or orphan result, with its place in the order, its validity and its JSON line.

    ``calls`` are (conv_id, call_id, turn, name, arguments, after), ``results`` (conv_id, call_id, turn,
    content); other columns are not read. In a conversation, rows ordered by (depth, turn, call_id) put
    every call behind the one it waits for; calls in circles and orphans have no depth and come last.
    Arguments that are no JSON, or whose tool has no schema, are invalid; they are kept as text.
    """
    links = _stored(link(calls, results), "calls")
    rows = links.join(depths(links), ["conv_id", "call_id"], "left")

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                call, result = x["call"] or {}, x["result"]
                value, wrong = read_arguments(call.get("arguments"))
                if x["n_calls"] and not wrong:
                    schema = schemas.get(call["name"])
                    wrong = ["$: unknown tool"] if schema is None else problems(value, schema)
                line = {"id": x["call_id"], "status": x["status"]}
                if x["n_calls"]:
                    line["call"] = {"name": call["name"], "arguments": call["arguments"] if value is None else value}
                else:
                    wrong = ["$: no call"]
                if result is not None:
                    line["result"] = result["content"]
                turn = call.get("turn") if x["n_calls"] else result["turn"]
                own = (x["conv_id"], x["call_id"], x["depth"], turn, x["status"], x["n_calls"], x["n_results"])
                out.append((*own, not wrong, wrong, canonical(line)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.string()]
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = ["conv_id", "call_id", "depth", "turn", "status", "n_calls", "n_results", "valid", "problems", "line"]
    return rows.select("conv_id", "call_id", "depth", "call", "result", "status", "n_calls", "n_results").mapInArrow(run, LINES)


#: The tool that conversations of plain turns call: to answer a turn.
ANSWER = {
    "answer": {
        "type": "object",
        "required": ["text", "turn", "words"],
        "additionalProperties": False,
        "properties": {
            "text": {"type": "string", "minLength": 1},
            "turn": {"type": "integer", "minimum": 0},
            "words": {"type": "integer", "minimum": 1, "maximum": 200},
        },
    }
}


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text).

    Every turn that is not the assistant's calls ``answer`` with its text and waits for the call two
    turns before; an assistant's turn is the result of the call one turn before it.
    """
    name = lambda back: F.concat(F.lit("call-"), (F.col("turn") - back).cast("string"))
    answers = F.col("role").eqNullSafe("assistant")
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    arguments = F.to_json(F.struct("text", "turn", words.alias("words")), {"ignoreNullFields": "false"})
    calls = messages.filter(~answers).select(
        "conv_id",
        name(0).alias("call_id"),
        "turn",
        F.lit("answer").alias("name"),
        arguments.alias("arguments"),
        name(2).alias("after"),
    )
    results = messages.filter(answers).select("conv_id", name(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
