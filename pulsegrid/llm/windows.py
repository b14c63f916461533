"""Exact removal of repeated byte strings: a depth-limited radix sort of all suffixes.

Every start of a ``length``-byte window is a suffix to be ordered no further than ``length`` bytes. A
window is placed under the one 50-byte string it contains that comes first in a fixed random order, so
equal windows are placed alike and about every 76th position is a place. The passes go from coarse to
fine: places of equal 50 bytes, then of equal surroundings (whose windows are all repeated), and only
where surroundings differ the single windows. Groups of equal windows are exactly the repeats.

Fingerprints are two independent 64-bit hashes; counts are combined before every shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.session import drop_folder, fresh_folder

GRAM = 50
BLOCK = 1 << 20
#: Places of one string with more differing surroundings than this (5 MB, and 60 MB of fingerprints in a
#: task) are compared by counting windows across the cluster.
WIDE = 20_000
PLACE_BITS = np.uint64(30)
PLACE = np.uint64((1 << 30) - 1)
FACTORS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
PLACES = "doc_id long, text_hash long, id long, s1 long, s2 long, gram long, around long"


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


VALUES = (_table(11), _table(12))


class Hashes:
    """Fingerprints of any byte ranges of one block, from prefix sums."""

    def __init__(self, raw: np.ndarray, kind: int):
        factor = FACTORS[kind]
        self.back = _powers(pow(factor, -1, 1 << 64), len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(VALUES[kind][raw] * _powers(factor, len(raw) + 1)[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.back[start]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


_POWERS: dict[int, np.ndarray] = {}


def _powers(factor: int, size: int) -> np.ndarray:
    known = _POWERS.get(factor)
    if known is None or len(known) < size:
        steps = np.full(max(size, BLOCK + 4096), factor, np.uint64)
        steps[0] = 1
        known = _POWERS[factor] = np.multiply.accumulate(steps)
    return known[:size]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    span, found = 1, values
    while span * 2 <= width:
        found = np.minimum(found[:-span], found[span:])
        span *= 2
    rest = width - span
    return np.minimum(found[: len(found) - rest], found[rest:]) if rest else found


def block_places(raw: np.ndarray, first: np.ndarray, count: np.ndarray, length: int):
    """Places (p, s1, s2, gram, around) of the windows of a block.

    ``first`` and ``count`` say where runs of window starts lie. Windows s1..s2 are placed at p.
    """
    hashes = Hashes(raw, 0)
    grams = hashes.of(np.arange(len(raw) - GRAM + 1), np.arange(GRAM, len(raw) + 1))
    ranked = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    least = (_sliding_min(ranked, length - GRAM + 1) & PLACE).astype(np.int64)
    runs = np.repeat(np.arange(len(first)), count)
    starts = np.arange(len(runs)) - np.repeat(np.cumsum(count) - count, count) + first[runs]
    at = least[starts]
    change = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (runs[1:] != runs[:-1])))
    last = np.append(change[1:], len(starts)) - 1
    p, s1, s2 = at[change], starts[change], starts[last]
    around = Hashes(raw, 1).of(s1, s2 + length) ^ ((p - s1).astype(np.uint64) * np.uint64(FACTORS[1]))
    return p, s1, s2, grams[p], around


def _blocks(raws: list[bytes], length: int):
    """Blocks of text runs: bytes, and per run its text, offset there, first start and starts."""
    part, runs, size = [], [], 0
    for i, raw in enumerate(raws):
        for offset in range(0, max(0, len(raw) - length + 1), BLOCK):
            piece = raw[offset : offset + BLOCK + length - 1]
            if part and size + len(piece) > BLOCK + length:
                yield np.frombuffer(b"".join(part), np.uint8), np.array(runs)
                part, runs, size = [], [], 0
            runs.append((i, offset, size, len(piece) - length + 1))
            part.append(piece)
            size += len(piece)
    if part:
        yield np.frombuffer(b"".join(part), np.uint8), np.array(runs)


def places(docs: DataFrame, length: int) -> DataFrame:
    """Places of all windows of ``docs`` (doc_id, text_hash, text); positions are bytes of the text."""

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                raws = [(t or "").encode() for t in rows.column(2).to_pylist()]
                for raw, runs in _blocks(raws, length):
                    p, s1, s2, gram, around = block_places(raw, runs[:, 2], runs[:, 3], length)
                    own = np.searchsorted(runs[:, 2], s1, side="right") - 1
                    shift = runs[own, 1] - runs[own, 2]
                    text = pa.array(runs[own, 0])
                    columns = [rows.column(0).take(text), rows.column(1).take(text)]
                    columns += [pa.array(number + np.arange(len(p)))]
                    columns += [pa.array(x + shift) for x in (s1, s2)]
                    columns += [pa.array(x.view(np.int64)) for x in (gram, around)]
                    number += len(p)
                    names = ["doc_id", "text_hash", "id", "s1", "s2", "gram", "around"]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, PLACES)


OPEN = "gram long, single boolean, wide boolean, doc_id long, text_hash long, s1 long, piece binary"


def _surroundings(rows: DataFrame, length: int) -> DataFrame:
    """Cut the bytes of open places out of their texts; ``rows`` have a text and a list of places."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, text_hash, text, listed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                for x in listed:
                    piece = raw[x["s1"] : x["s2"] + length]
                    out.append((x["gram"], x["single"], x["wide"], doc, text_hash, x["s1"], piece))
                if len(out) > 4000:
                    yield _open_batch(out)
                    out = []
            if out:
                yield _open_batch(out)

    return rows.select("doc_id", "text_hash", "text", "listed").mapInArrow(run, OPEN)


def _open_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["gram", "single", "wide", "doc_id", "text_hash", "s1", "piece"]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


def _piece_windows(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, piece and start of every window of every piece."""
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(pieces)), counts)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = start + (np.cumsum(sizes) - sizes)[owner]
    return Hashes(raw, 1).of(at, at + length), owner, start


SPANS = "doc_id long, text_hash long, start long, end long"


def _spans(doc, text_hash, s1, owner, start, length) -> pa.Table:
    """One span per run of neighbouring windows of a piece."""
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    first = np.append(True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)) if len(owner) else []
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(owner)) - 1 if len(at) else at
    own = pa.array(owner[at])
    base = s1.take(own).to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.table(
        {
            "doc_id": doc.take(own),
            "text_hash": text_hash.take(own),
            "start": base + start[at],
            "end": base + start[last] + length,
        }
    )


def _compare(length: int):
    """Repeated windows of the open places of one bucket of strings."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        gram = table.column("gram").to_numpy().view(np.uint64)
        windows, owner, start = _piece_windows(table.column("piece").to_pylist(), length)
        key = windows ^ (gram[owner] * np.uint64(FACTORS[0]))
        _, inverse, seen = np.unique(key, return_inverse=True, return_counts=True)
        single = table.column("single").to_numpy(zero_copy_only=False)
        again = (seen[inverse] > 1) & single[owner]
        columns = [table.column(n).combine_chunks() for n in ("doc_id", "text_hash", "s1")]
        return _spans(*columns, owner[again], start[again], length)

    return run


def _exploded(wide: DataFrame, length: int) -> DataFrame:
    """One row per window of the open places of strings with many surroundings."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                rows = batch.slice(at, 2048)
                windows, owner, start = _piece_windows(rows.column(6).to_pylist(), length)
                own = pa.array(owner)
                columns = [rows.column(i).take(own) for i in (0, 1, 3, 4)]
                base = rows.column(5).to_numpy(zero_copy_only=False)[owner]
                columns += [pa.array(base + start), pa.array(windows.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "single", "doc_id", "text_hash", "start", "window"])

    shape = "gram long, single boolean, doc_id long, text_hash long, start long, window long"
    return wide.mapInArrow(run, shape)


def _stored(frame: DataFrame, name: str) -> tuple[DataFrame, str]:
    folder = fresh_folder(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.parquet(folder), folder


def _meet(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on doc_id and text_hash; null ids meet."""
    right = right.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash")
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return left.join(right, on, how).drop("_id", "_hash")


def repeated_spans(docs: DataFrame, length: int = 200, wide: int = WIDE, buckets: int | None = None) -> DataFrame:
    """Spans (doc_id, text_hash, start, end) whose windows also start elsewhere; spans may overlap.

    ``docs`` are (doc_id, text_hash, text). Nothing is said about texts shorter than ``length``.
    """
    if length < GRAM:
        raise ValueError(f"windows are at least {GRAM} bytes long")
    spark = docs.sparkSession
    buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found, folder = _stored(places(docs, length), "places")
    groups = found.groupBy("gram", "around").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("one"))
    strings = groups.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    strings = strings.filter("kinds > 1 OR least > 1").withColumnRenamed("gram", "_gram")
    groups = groups.join(strings, F.col("gram") == F.col("_gram")).drop("_gram")
    groups = groups.withColumnsRenamed({"gram": "_gram", "around": "_around"})
    same = (F.col("gram") == F.col("_gram")) & (F.col("around") == F.col("_around"))
    # where surroundings differ and some occur once, windows are compared; of equal ones, one is enough
    unsettled = F.expr("kinds > 1 AND least = 1 AND id = one")
    joined = found.join(groups, same).withColumn("open", unsettled).filter("n > 1 OR open")
    place = [F.when(F.col("open"), F.col("gram")).alias("gram"), (F.col("n") == 1).alias("single"), (F.col("kinds") > wide).alias("wide")]
    placed, _ = _stored(joined.select("doc_id", "text_hash", "s1", "s2", *place, "open"), "placed")
    drop_folder(spark, folder)
    whole = placed.filter("NOT single").select("doc_id", "text_hash", F.col("s1").alias("start"), (F.col("s2") + length).alias("end"))
    whole = whole.distinct()
    left = placed.filter("open")
    item = F.struct("gram", "single", "wide", "s1", "s2")
    listed = left.groupBy("doc_id", "text_hash").agg(F.collect_list(item).alias("listed"))
    texts = docs.filter(F.octet_length("text") >= length)
    opened, _ = _stored(_surroundings(_meet(texts, listed, "inner"), length).distinct(), "open")
    bucket = F.pmod(F.xxhash64("gram"), F.lit(buckets)).alias("bucket")
    narrow = opened.filter("NOT wide").groupBy(bucket).applyInArrow(_compare(length), SPANS)
    spread, _ = _stored(_exploded(opened.filter("wide"), length), "windows")
    again = spread.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("seen")).filter("seen > 1")
    spread = spread.filter("single").join(again, ["gram", "window"])
    spread = spread.select("doc_id", "text_hash", "start", (F.col("start") + length).alias("end"))
    return whole.union(narrow).union(spread)


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping and touching spans made one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.append(True, starts[1:] > reach[:-1])
    at = np.flatnonzero(first)
    return list(zip(starts[at].tolist(), reach[np.append(at[1:], len(starts)) - 1].tolist(), strict=True))


def cleaned(docs: DataFrame, length: int = 200, **options) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, any others) with its bytes kept and what was removed.

    Each byte inside a ``length``-byte string that starts anywhere else too, in the same text or
    another, is removed; matches never cross texts. Null texts are empty; a repeated row is another
    place of its strings. Bytes are cut without regard to characters: ``kept`` has the bytes, and
    ``kept_text`` the whole characters among them. All other columns are in the struct ``row``.
    """
    others = [F.col(c) for c in docs.columns if c != "text"]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        "text",
        F.struct(*others).alias("row"),
    )
    spans = repeated_spans(rows.drop("row"), length, **options)
    lists = spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    met = _meet(rows, lists, "left").select("doc_id", "text_hash", "text", "spans.start", "spans.end", "row")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for text, start, end in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    raw = (text or "").encode()
                    cut = merged(np.array(start), np.array(end)) if start else []
                    edges = [0, *(x for span in cut for x in span), len(raw)]
                    parts = [raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    kept = b"".join(parts)
                    whole = "".join(x.decode("utf-8", "ignore") for x in parts)
                    out.append((len(raw), len(raw) - len(kept), len(cut), kept, whole))
                columns = [part.column(0), part.column(1), *(pa.array(c) for c in zip(*out, strict=True)), part.column(5)]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "text_hash", "n_bytes", "n_removed", "n_spans", "kept", "kept_text", "row"]
    kinds = ["long", "long", "long", "long", "long", "binary", "string", rows.schema["row"].dataType]
    shape = StructType()
    for name, kind in zip(names, kinds, strict=True):
        shape = shape.add(name, kind)
    return met.mapInArrow(run, shape)
