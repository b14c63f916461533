"""Stretches of words that repeat with a period, found from minimizers at several scales.

A run is a stretch whose words equal those ``period`` words on, at least ``max(24, 3 * period)`` words
long, that no neighbouring word extends; its period is the smallest one. Texts of a block lie behind one
another as word numbers, with a number of its own between two texts, so no run crosses texts.

* Periods below ``SHORT`` come from comparing the block with itself, shifted by the period.
* Periods from ``2^j`` to ``2^(j+1) - 1`` come from scale ``j``. Of every ``2^(j-1)`` places on end, the
  leftmost one whose next ``2^(j-1)`` words hash lowest is a minimizer. Two windows a period apart in a
  run hold the same words, so their minimizers lie a period apart. Equal minimizers at most a quarter of
  ``2^j`` behind another are left out: such words repeat with a shorter period, and their first place has
  a counterpart a period on as well. So a place has at most seven partners per scale.
* Pairs are extended to both sides with prefix hashes, and then compared word by word. Where a hash
  lied, the period's shift is compared over the whole block instead.

Each text takes ``O(n log^2 n)`` steps of array operations; a text is one row and one task's work.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.codes import small_batches

LEAST_WORDS = 24
TIMES = 3
#: Periods below this are found by shifting; a power of two, 16 at least.
SHORT = 16
BLOCK_WORDS = 1 << 17
ODD = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _least(period: int) -> int:
    return max(LEAST_WORDS, TIMES * period)


def _shifted(x: np.ndarray, period: int) -> list[tuple[int, int]]:
    """Bounds of the long stretches of ``x`` that equal themselves ``period`` on."""
    unlike = np.flatnonzero(x[period:] != x[:-period])
    first = np.append(0, unlike + 1)
    last = np.append(unlike, len(x) - period)
    long = np.flatnonzero(last - first + period >= _least(period))
    return [(int(first[i]), int(last[i]) + period) for i in long]


def _minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the leftmost lowest hash of every ``window`` (a power of two) places on end."""
    low, at, size = hashes, np.arange(len(hashes)), 1
    while size < window:
        left = low[:-size] <= low[size:]
        low = np.where(left, low[:-size], low[size:])
        at = np.where(left, at[:-size], at[size:])
        size *= 2
    return at[np.append(True, at[1:] != at[:-1])] if len(at) else at


def _pairs(hashes: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of equal minimizers whose distance belongs to the scale."""
    span = 1 << scale
    at = _minimizers(hashes, span // 2)
    order = np.argsort(hashes[at], kind="stable")
    at = at[order]
    codes = hashes[at]
    near = (codes[1:] == codes[:-1]) & (at[1:] - at[:-1] <= span // 4)
    kept = np.append(True, ~near)
    at, codes = at[kept], codes[kept]
    places, distances = [], []
    for step in range(1, 8):
        apart = at[step:] - at[:-step]
        seen = np.flatnonzero((codes[step:] == codes[:-step]) & (apart >= span) & (apart < 2 * span))
        places.append(at[seen])
        distances.append(apart[seen])
    return np.concatenate(places), np.concatenate(distances)


class _Hashes:
    """Prefix hashes of a block; they say how far two places agree."""

    def __init__(self, values: np.ndarray):
        self.powers = np.full(len(values) + 1, ODD, np.uint64)
        self.powers[0] = 1
        self.powers = np.multiply.accumulate(self.powers)
        self.sums = np.append(np.uint64(0), np.cumsum(values * self.powers[:-1]))
        self.size = len(values)

    def equal(self, a: np.ndarray, lag: np.ndarray, length: np.ndarray) -> np.ndarray:
        one = self.sums[a + length] - self.sums[a]
        two = self.sums[a + lag + length] - self.sums[a + lag]
        return one * self.powers[lag] == two

    def agree(self, places: np.ndarray, lags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the stretch around each place that equals itself ``lag`` on, the copy included."""
        left, right = np.zeros_like(places), np.zeros_like(places)
        step = 1 << max(0, self.size.bit_length() - 1)
        while step:
            reach = left + step
            free = np.flatnonzero(places - reach >= 0)
            same = self.equal(places[free] - reach[free], lags[free], reach[free])
            left[free[same]] += step
            reach = right + step
            free = np.flatnonzero(places + lags + reach <= self.size)
            same = self.equal(places[free], lags[free], reach[free])
            right[free[same]] += step
            step //= 2
        return places - left, places + lags + right


def _is_run(x: np.ndarray, start: int, stop: int, period: int) -> bool:
    if not np.array_equal(x[start : stop - period], x[start + period : stop]):
        return False
    before = start > 0 and x[start - 1] == x[start - 1 + period]
    return not before and not (stop < len(x) and x[stop] == x[stop - period])


def _shorter(x: np.ndarray, start: int, stop: int, period: int) -> bool:
    """Whether a shorter period repeats the stretch too; as it is long, that divides ``period``."""
    rest, prime = period, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            part = period // prime
            if np.array_equal(x[start : stop - part], x[start + part : stop]):
                return True
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return False


def find_runs(x: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """All runs of ``x`` (word numbers) as (start, length, period), by start, then period.

    ``longest`` bounds the length of any stretch that can repeat, as the longest text of a block does.
    """
    longest = len(x) if longest is None else min(longest, len(x))
    found: set[tuple[int, int, int]] = set()
    for period in range(1, SHORT):
        if longest >= _least(period):
            found |= {(a, b, period) for a, b in _shifted(x, period)}
    scale = SHORT.bit_length() - 1
    if longest >= _least(1 << scale):
        values = _mixed(x.astype(np.uint64) + ODD)
        whole, hashes, size = _Hashes(values), values, 1
        while longest >= _least(1 << scale):
            while size < 1 << (scale - 1):
                hashes = _mixed(hashes[:-size] * ODD + hashes[size:])
                size *= 2
            places, lags = _pairs(hashes, scale)
            starts, stops = whole.agree(places, lags)
            long = stops - starts >= np.maximum(LEAST_WORDS, TIMES * lags)
            again = set()
            for a, b, period in set(zip(starts[long].tolist(), stops[long].tolist(), lags[long].tolist(), strict=True)):
                if _is_run(x, a, b, period):
                    found.add((a, b, period))
                else:
                    again.add(period)
            for period in again:
                found |= {(a, b, period) for a, b in _shifted(x, period)}
            scale += 1
    return sorted((a, b - a, q) for a, b, q in found if not _shorter(x, a, b, q))


def _block(texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int, int]], str]]:
    """Runs and collapsed text of every list of words."""
    table: dict[bytes, int] = {}
    parts, bounds = [], [0]
    for number, words in enumerate(texts):
        here = bounds[-1]
        parts.append(np.fromiter(map(table.setdefault, words, count(here)), np.int64, len(words)))
        parts.append(np.array([-1 - number], np.int64))
        bounds.append(here + len(words) + 1)
    owner = [[] for _ in texts]
    runs = find_runs(np.concatenate(parts), max(map(len, texts)))
    for (start, length, period), text in zip(runs, np.searchsorted(bounds, [r[0] for r in runs], "right") - 1, strict=True):
        owner[text].append((start - bounds[text], length, period))
    found = []
    for words, mine in zip(texts, owner, strict=True):
        if mine:
            kept = np.ones(len(words), bool)
            for start, length, period in mine:
                kept[start + period : start + length] = False
            words = [words[i] for i in np.flatnonzero(kept)]
        found.append((mine, b" ".join(words).decode()))
    return found


def _blocks(batch):
    """Lists of words of some rows on end, ``BLOCK_WORDS`` together or one longer text."""
    part, size = [], 0
    for text in batch.column(1):
        words = (text.as_py() or "").encode().split()  # exactly at [\x20\x09-\x0D]
        if part and size + len(words) > BLOCK_WORDS:
            yield part
            part, size = [], 0
        part.append(words)
        size += len(words)
    if part:
        yield part


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, runs, collapsed) of ``docs`` (doc_id, text, any others): one per row of ``docs``.

    ``runs`` are sorted by start, then period; ``collapsed`` joins the words that are kept by one space:
    a word goes if any run holds it after that run's first period. A null or empty text has no runs and
    an empty ``collapsed``. Repeated rows and null doc_ids are rows like others.
    """

    def run(batches):
        for batch in small_batches(batches):
            found = [row for part in _blocks(batch) for row in _block(part)]
            runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in mine] for mine, _ in found]
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
            columns = [batch.column(0), pa.array(runs, kind), pa.array([text for _, text in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def with_repeats(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) in which a tenth of the texts, by doc_id, repeats a part up to its end.

    Words are joined by one space. With h = crc32(doc_id as text), g = h // 10 and n words, texts with
    h % 10 = 0 have word a + (i - a) % p in place of each word i from a = g % n on, where
    p = 1 + (n - a) // (3 + g % 8). Texts without words and rows without doc_id stay.
    """

    def run(batches):
        for batch in small_batches(batches):
            texts = []
            for text, h in zip(batch.column(1), batch.column(2), strict=True):
                text, h = text.as_py(), h.as_py()
                words = (text or "").encode().split() if h is not None and h % 10 == 0 else []
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    part = words[a : a + p]
                    words = words[:a] + (part * ((n - a) // p + 1))[: n - a]
                    text = b" ".join(words).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    key = F.col("doc_id").cast("long")
    rows = docs.select(key.alias("doc_id"), "text", F.crc32(key.cast("string").cast("binary")).alias("h"))
    return rows.mapInArrow(run, "doc_id long, text string")


def digest(found: DataFrame) -> DataFrame:
    """Per row of ``periodic_runs``: how many runs, the one of most repeats, and hashes of the results."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    # repeats compared exactly, as fractions; runs come by start, then period, so the first of equals stays
    more = "r.length * best.period > best.length * r.period"
    best = F.expr(f"reduce(runs, runs[0], (best, r) -> CASE WHEN {more} THEN r ELSE best END)")
    rows = found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.when(F.size("runs") > 0, best).alias("best"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")
