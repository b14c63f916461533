"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are put into bins. Boosting goes round the features in turn: a tree of one feature
with few leaves is fitted to the gradient and added to that feature's lookup table. The strongest pairs
then get tables of two features the same way, from four-leaf trees. A score is the sum of table entries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from pulsegrid.llm.codes import small_batches
from pulsegrid.llm.shingle_join import BLOCK_BYTES, word_codes

FEATURES = [
    "log_bytes", "upper", "exclaim", "bar", "symbol", "digit", "stop", "comma", "other_ascii", "non_ascii",
    "word_bytes", "short_words", "long_words", "repeats", "distinct", "top_word", "lines", "repeated_lines",
]
#: Labelled rows the model is fitted on, at most; those of the smallest hashes of doc_id.
SAMPLE_ROWS = 30_000
BINS = 64
PAIR_BINS = 16
PAIRS = 10
ROUNDS = 150
RATE = 0.1
RIDGE = 2.0


def _class_table() -> np.ndarray:
    """Class of every byte: upper, !, |, symbol, digit, stop, comma, other ASCII, non-ASCII, none."""
    table = np.full(256, 9, np.uint8)
    table[33:127] = 7
    table[128:] = 8
    table[[ord(c) for c in "%*$&#@~^=+<>_\\/"]] = 3
    table[48:58] = 4
    table[65:91] = 0
    table[97:123] = 9
    for char, kind in (("!", 1), ("|", 2), (".", 5), (",", 6)):
        table[ord(char)] = kind
    return table


CLASSES = _class_table()


def _counts_by(owner: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per owner: distinct codes, and the largest count of one code."""
    if not len(codes):
        return np.zeros(size), np.zeros(size)
    order = np.lexsort((codes, owner))
    own, codes = owner[order], codes[order]
    at = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (own[1:] != own[:-1])))
    runs = np.diff(np.append(at, len(codes)))
    most = np.zeros(size)
    np.maximum.at(most, own[at], runs)
    return np.bincount(own[at], minlength=size).astype(float), most


def _block_features(raws: list[bytes]) -> np.ndarray:
    n = len(raws)
    raw = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    sizes = np.array([len(r) for r in raws], np.int64)
    ends = np.cumsum(sizes + 1)
    owner = np.repeat(np.arange(n), sizes + 1)
    kinds = np.bincount(owner * 10 + CLASSES[raw], minlength=10 * n).reshape(n, 10).astype(float)
    share = kinds[:, :9] / np.maximum(sizes, 1)[:, None]
    codes, starts = word_codes(raw)
    own = np.searchsorted(ends, starts, side="right")
    words = np.bincount(own, minlength=n).astype(float)
    some = np.maximum(words, 1)
    space = np.flatnonzero((raw == 32) | ((raw >= 9) & (raw <= 13)))
    lengths = space[np.searchsorted(space, starts)] - starts
    again = np.append(False, (codes[1:] == codes[:-1]) & (own[1:] == own[:-1]))
    distinct, most = _counts_by(own, codes, n)
    line_ends = np.flatnonzero(raw == 10)
    line_own = owner[line_ends]
    first = np.append(0, line_ends[:-1] + 1)
    word_sums = np.append(np.uint64(0), np.cumsum(codes))
    a, b = np.searchsorted(starts, first), np.searchsorted(starts, line_ends)
    full = b > a
    line_codes = (word_sums[b] - word_sums[a])[full]
    lines = np.bincount(line_own[full], minlength=n).astype(float)
    unlike, _ = _counts_by(line_own[full], line_codes, n)
    columns = [
        np.log1p(sizes), *share.T,
        np.bincount(own, lengths, minlength=n) / some,
        np.bincount(own, lengths <= 3, minlength=n) / some,
        np.bincount(own, lengths >= 15, minlength=n) / some,
        np.bincount(own, again, minlength=n) / some,
        distinct / some,
        most / some,
        lines / some,
        1 - unlike / np.maximum(lines, 1),
    ]
    return np.stack(columns, axis=1)


def features(texts: list[str | None]) -> np.ndarray:
    """One row of ``FEATURES`` per text, from the whole text; null is empty."""
    found, part, size = [], [], 0
    for text in texts:
        raw = (text or "").encode()
        if part and size + len(raw) > BLOCK_BYTES:
            found.append(_block_features(part))
            part, size = [], 0
        part.append(raw)
        size += len(raw)
    if part:
        found.append(_block_features(part))
    return np.concatenate(found) if found else np.empty((0, len(FEATURES)))


@dataclass
class Model:
    """Edges of the bins, one table per feature, one per pair of features."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        total = np.full(len(rows), self.base)
        for i, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, rows[:, i], side="right")]
        if self.pairs:
            bins = [np.searchsorted(e, rows[:, i], side="right") for i, e in enumerate(self.pair_edges)]
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[bins[i], bins[j]]
        return 1 / (1 + np.exp(-total))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Bounds of bins of about equal numbers of rows, between different values."""
    cuts = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))
    low = np.unique(values)
    at = np.searchsorted(low, cuts)
    at = at[at > 0]
    return np.unique((low[at - 1] + low[np.minimum(at, len(low) - 1)]) / 2)


def _leaf(g, h):
    return g / (h + RIDGE)


def _gain(g, h):
    return g * g / (h + RIDGE)


def _line_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Values per bin of a tree that cuts the bins into at most ``leaves`` ranges, best cut first."""
    gs, hs = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    ranges = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-6, None, 0)
        for a, b in ranges:
            cut = np.arange(a + 1, b)
            if not len(cut):
                continue
            gl, hl, gr, hr = gs[cut] - gs[a], hs[cut] - hs[a], gs[b] - gs[cut], hs[b] - hs[cut]
            gains = _gain(gl, hl) + _gain(gr, hr) - _gain(gs[b] - gs[a], hs[b] - hs[a])
            k = int(gains.argmax())
            if gains[k] > best[0]:
                best = (float(gains[k]), (a, b), int(cut[k]))
        if best[1] is None:
            break
        ranges.remove(best[1])
        ranges += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.empty(len(g))
    for a, b in ranges:
        out[a:b] = _leaf(gs[b] - gs[a], hs[b] - hs[a])
    return out


def _plane_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of the best four-leaf tree of two features, one cut each, and its gain."""
    gs = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    hs = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    quarters = []
    for s in (gs, hs):
        whole, rows, columns = s[-1, -1], s[:, -1:], s[-1:, :]
        quarters.append([s, rows - s, columns - s, whole - rows - columns + s])
    gains = sum(_gain(a, b) for a, b in zip(*quarters, strict=True))
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    leaf = [_leaf(a[i, j], b[i, j]) for a, b in zip(*quarters, strict=True)]
    out = np.empty_like(g, dtype=float)
    out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = leaf
    return out, float(gains[i, j] - _gain(gs[-1, -1], hs[-1, -1]))


def fit(rows: np.ndarray, labels: np.ndarray) -> Model:
    """Fit to feature rows and 0/1 labels; without rows of both labels, the score is their smoothed share."""
    ones = float(labels.sum())
    if not 0 < ones < len(labels):
        return Model(base=float(np.log((ones + 1) / (len(labels) - ones + 1))))
    model = Model(base=float(np.log(ones / (len(labels) - ones))))
    model.edges = [_edges(rows[:, i], BINS) for i in range(rows.shape[1])]
    bins = [np.searchsorted(e, rows[:, i], side="right") for i, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(rows), model.base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i, table in enumerate(model.tables):
            if len(table) > 1:
                g, h = slope()
                step = _line_tree(np.bincount(bins[i], g, len(table)), np.bincount(bins[i], h, len(table)))
                table += RATE * step
                total += RATE * step[bins[i]]
    model.pair_edges = [_edges(rows[:, i], PAIR_BINS) for i in range(rows.shape[1])]
    coarse = [np.searchsorted(e, rows[:, i], side="right") for i, e in enumerate(model.pair_edges)]
    shape = [len(e) + 1 for e in model.pair_edges]

    def plane(i: int, j: int) -> tuple[np.ndarray, float, np.ndarray]:
        cell = coarse[i] * shape[j] + coarse[j]
        sums = (np.bincount(cell, x, shape[i] * shape[j]).reshape(shape[i], shape[j]) for x in slope())
        return *_plane_tree(*sums), cell

    every = [(i, j) for i in range(len(shape)) for j in range(i) if shape[i] > 1 and shape[j] > 1]
    model.pairs = sorted(every, key=lambda p: (-plane(*p)[1], p))[:PAIRS]
    model.pair_tables = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    for _ in range(ROUNDS // 3):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            step, _, cell = plane(i, j)
            table += RATE * step
            total += RATE * step.ravel()[cell]
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of doc_ids that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def feature_rows(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, features...) of ``docs`` (doc_id, text, any others); no other column is read."""

    def run(batches):
        for batch in small_batches(batches, 2048):
            rows = features(batch.column(1).to_pylist())
            columns = [batch.column(0), *(pa.array(c) for c in rows.T)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *FEATURES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def train(rows: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled rows that are not held out.

    ``rows`` come from ``feature_rows``; labels that are null count as none. Only features and labels
    of the sample reach the driver.
    """
    marks = labels.select("doc_id", "quality").filter("doc_id IS NOT NULL AND quality IN (0, 1)").distinct()
    known = rows.join(marks.filter(~held_out()), "doc_id")
    # rows of small hashes only, about a fifth more than wanted: tasks need not send each a whole sample
    share = min(1.0, 1.2 * sample_rows / max(1, known.count()))
    if share < 1:
        known = known.filter(F.xxhash64("doc_id") <= int(share * (1 << 64)) - (1 << 63))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("quality"), *map(F.col, FEATURES)]
    sample = known.orderBy(*order).limit(sample_rows).select("quality", *FEATURES).toPandas()
    return fit(sample[FEATURES].to_numpy(float), sample["quality"].to_numpy(float))


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score) of rows from ``feature_rows``."""

    def run(batches):
        for batch in batches:
            table = np.stack([batch.column(f).to_numpy() for f in FEATURES], axis=1)
            columns = [batch.column("doc_id"), pa.array(model.score(table))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def score_column(text: Column, model: Model) -> Column:
    """Score of a text column, for use beside any other columns."""

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        found = [model.score(features(texts[at : at + 2048].tolist())) for at in range(0, len(texts), 2048)]
        return pd.Series(np.concatenate(found) if found else np.empty(0))

    return score(text)
