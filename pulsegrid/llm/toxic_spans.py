"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

A token is a stretch of ASCII letters, digits and non-ASCII characters. It is clean or toxic. Potentials
depend on its word, the word's beginnings and endings, the words beside it, and the state before it.
Labels come per document, so tokens are labelled first: in a toxic document those whose features occur
in surely more toxic than clean documents, compared with the strongest token of the document; after
a first fit, those the field itself marks, at least one per toxic document. The field is then fitted once
more. Marginals of whole texts come from forward and backward passes; a small logistic model, fitted on
documents the field has not seen, turns the strongest marginal and the expected number of toxic tokens
into the score.

The passes run over all tokens of a block of texts at once: states are carried as one ratio, chunks of
tokens as 2 x 2 matrices that are composed first, so the number of steps does not grow with a text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.codes import small_batches
from pulsegrid.llm.ranked_search import TERM_BYTES, blocks_of_text
from pulsegrid.llm.shingle_join import BACK, STEP, VALUES
from pulsegrid.llm.shingle_join import _mixed as mixed

#: Labelled documents the model is fitted on, at most, half of each label; those of the smallest hashes of
#: doc_id among documents of at most SAMPLE_BYTES. Scores cover all documents and whole texts.
SAMPLE_ROWS = 4_000
SAMPLE_BYTES = 8_192
BUCKETS = 1 << 18
ENDS = (3, 4, 5)
KINDS = 1 + 2 * len(ENDS) + 2
SALTS = mixed(np.arange(1, KINDS + 1, dtype=np.uint64))
CHUNK = 64
STEPS = 50
RATE = 0.25
RIDGE = 1e-3
#: Least lower bound of a feature's log ratio of toxic to clean documents for a token to be labelled.
SURE = 1.0
MOST = 25.0


@dataclass
class Tokens:
    """Tokens of some texts: owner, byte bounds within the block, feature buckets (0 is none)."""

    texts: int
    owner: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    features: np.ndarray
    first: np.ndarray


def tokens(raws: list[bytes]) -> Tokens:
    """Tokens of encoded texts that lie behind one another, one byte between two."""
    raw = TERM_BYTES[np.frombuffer(b" ".join(raws) + b" ", np.uint8)]
    word = raw != 32
    starts = np.flatnonzero(word & np.append(True, ~word[:-1]))
    ends = np.flatnonzero(word & np.append(~word[1:], True)) + 1
    owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raws]), starts, side="right")
    powers = np.full(len(raw) + 1, STEP, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    back = np.full(len(raw) + 1, BACK, np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    sums = np.append(np.uint64(0), np.cumsum(VALUES[raw] * powers[:-1]))

    def bucket(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
        code = mixed((sums[b] - sums[a]) * back[a] + SALTS[kind])
        return (code % np.uint64(BUCKETS - 1)).astype(np.int32) + 1

    features = np.zeros((KINDS, len(starts)), np.int32)
    features[0] = bucket(starts, ends, 0)
    for i, size in enumerate(ENDS):
        long = np.flatnonzero(ends - starts > size)
        features[1 + i, long] = bucket(starts[long], starts[long] + size, 1 + i)
        features[1 + len(ENDS) + i, long] = bucket(ends[long] - size, ends[long], 1 + len(ENDS) + i)
    first = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
    inner = np.flatnonzero(~first)
    features[-2, inner] = bucket(starts[inner - 1], ends[inner - 1], KINDS - 2)
    features[-1, inner - 1] = bucket(starts[inner], ends[inner], KINDS - 1)
    return Tokens(len(raws), owner, starts, ends, features, first)


def _ratios(own: np.ndarray, reset: np.ndarray, at_reset: np.ndarray, move: tuple[float, float, float, float]) -> np.ndarray:
    """x[t] = own[t] (b + d x[t-1]) / (a + c x[t-1]) with move = a, b, c, d; at a reset, at_reset[t].

    Every chunk of steps is one matrix first; chunks are carried on one by one, then filled in.
    """
    n = len(own)
    if not n:
        return np.zeros(0)
    rows = -(-n // CHUNK)
    pad = rows * CHUNK - n
    own = np.ascontiguousarray(np.append(own, np.ones(pad)).reshape(rows, CHUNK).T)
    reset = np.ascontiguousarray(np.append(reset, np.ones(pad, bool)).reshape(rows, CHUNK).T)
    fixed = np.ascontiguousarray(np.append(at_reset, np.ones(pad)).reshape(rows, CHUNK).T)
    a, b, c, d = move
    p, q, r, s = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for t in range(CHUNK):
        p, q, r, s = p * a + q * c, (p * b + q * d) * own[t], r * a + s * c, (r * b + s * d) * own[t]
        # a reset forgets: both rows of the matrix become (1, at_reset)
        p, q = np.where(reset[t], 1.0, p), np.where(reset[t], fixed[t], q)
        r, s = np.where(reset[t], 1.0, r), np.where(reset[t], fixed[t], s)
        size = p + q + r + s
        p, q, r, s = p / size, q / size, r / size, s / size
    carried, x = np.empty(rows), 1.0
    for i, (w, y, z, v) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        carried[i] = x
        x = (y + v * x) / (w + z * x)
    out = np.empty((CHUNK, rows))
    x = carried
    for t in range(CHUNK):
        x = np.where(reset[t], fixed[t], own[t] * (b + d * x) / (a + c * x))
        out[t] = x
    return out.T.ravel()[:n]


@dataclass
class Model:
    """Potentials of the field, and the logistic model of document scores."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    bias: float = 0.0
    start: float = 0.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros(3))  # clean-toxic, toxic-clean, toxic-toxic
    shape: np.ndarray = field(default_factory=lambda: np.zeros(4))
    trained: bool = False

    def passes(self, found: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: potential of toxic, and ratios toxic to clean of the forward and backward passes."""
        total = np.full(len(found.owner), self.bias)
        for kind in found.features:
            total += self.weights[kind]
        own = np.exp(np.clip(total, -MOST, MOST))
        into, back, stay = np.exp(np.clip(self.moves, -MOST, MOST))
        forth = _ratios(own, found.first, np.exp(np.clip(self.start, -MOST, MOST)) * own, (1.0, into, back, stay))
        # backwards, step t goes from t + 1 to t with the potential of t + 1; the last token of a text starts anew
        last = np.append(found.first[1:], True)[: len(own)]
        ahead = np.append(own[1:], 1.0)[: len(own)]
        reverse = _backward(ahead[::-1], last[::-1], into, back, stay)[::-1]
        return own, forth, reverse

    def marginals(self, found: Tokens) -> np.ndarray:
        """Probability of every token to be toxic, given the whole text."""
        _, forth, reverse = self.passes(found)
        both = forth * reverse
        return both / (1 + both)

    def summary(self, found: Tokens, p: np.ndarray) -> np.ndarray:
        """Per text: 1, strongest marginal and expected toxic tokens on log scales, log of its tokens."""
        top = np.full(found.texts, 1e-6)
        np.maximum.at(top, found.owner, np.clip(p, 1e-6, 1 - 1e-6))
        expected = np.bincount(found.owner, p, minlength=found.texts)
        number = np.bincount(found.owner, minlength=found.texts)
        return np.stack([np.ones(found.texts), np.log(top / (1 - top)), np.log(expected + 1e-3), np.log1p(number)], axis=1)

    def score(self, found: Tokens, p: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.summary(found, p) @ self.shape, -MOST, MOST)))


def _backward(ahead: np.ndarray, reset: np.ndarray, into: float, back: float, stay: float) -> np.ndarray:
    """y[t] = (back + stay z) / (1 + into z) with z = ahead[t] y[t-1]; 1 at a reset (a text's last token)."""
    # with x[t] = ahead[t+1] y[t] the step has the form of ``_ratios``
    nxt = np.append(ahead[1:], 1.0)[: len(ahead)]
    x = _ratios(nxt, reset, nxt, (1.0, back, into, stay))
    return x / nxt


def _fit_field(found: Tokens, labels: np.ndarray) -> Model:
    """Most likely potentials for labelled tokens, with a ridge, by gradient steps of adapted size."""
    model = Model(bias=-3.0, start=0.0, moves=np.zeros(3), trained=True)
    n = len(found.owner)
    inner = np.flatnonzero(~found.first)
    y = labels.astype(float)
    was, now = y[inner - 1], y[inner]
    seen = np.array([((1 - was) * now).sum(), (was * (1 - now)).sum(), (was * now).sum()])
    size = BUCKETS + 5
    low, high = np.zeros(size), np.zeros(size)
    flat = found.features.ravel()
    for step in range(1, STEPS + 1):
        own, forth, reverse = model.passes(found)
        p = forth * reverse / (1 + forth * reverse)
        into, back, stay = np.exp(np.clip(model.moves, -MOST, MOST))
        x, z = forth[inner - 1], own[inner] * reverse[inner]
        cells = np.stack([np.ones(len(inner)), into * z, back * x, stay * x * z])
        expected = (cells[1:] / cells.sum(axis=0)).sum(axis=1)
        rest = y - p
        slope = np.empty(size)
        slope[:BUCKETS] = np.bincount(flat, np.tile(rest, KINDS), BUCKETS) - RIDGE * n / 1000 * model.weights
        slope[0] = 0.0
        slope[BUCKETS] = rest.sum()
        slope[BUCKETS + 1] = rest[found.first].sum()
        slope[BUCKETS + 2 :] = seen - expected
        low = 0.9 * low + 0.1 * slope
        high = 0.99 * high + 0.01 * slope**2
        change = RATE * (low / (1 - 0.9**step)) / (np.sqrt(high / (1 - 0.99**step)) + 1e-3)
        model.weights += change[:BUCKETS]
        model.bias += change[BUCKETS]
        model.start += change[BUCKETS + 1]
        model.moves = model.moves + change[BUCKETS + 2 :]
    return model


def _seeds(found: Tokens, toxic: np.ndarray) -> np.ndarray:
    """Labels of tokens by how surely their features belong to toxic documents."""
    sums = np.zeros((2, BUCKETS))
    kinds = found.features[: 1 + 2 * len(ENDS)]
    for kind in kinds:
        pairs = np.unique(found.owner.astype(np.int64) * BUCKETS + kind)
        owner, bucket = pairs // BUCKETS, pairs % BUCKETS
        for label in (0, 1):
            sums[label] += np.bincount(bucket[toxic[owner] == label], minlength=BUCKETS)
    ones, zeros = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    ratio = np.log((sums[1] + 0.5) / (ones + 1)) - np.log((sums[0] + 0.5) / (zeros + 1))
    sure = ratio - 2 * np.sqrt(1 / (sums[1] + 0.5) + 1 / (sums[0] + 0.5))
    sure[0] = -np.inf
    evidence = sure[kinds].max(axis=0) if len(found.owner) else np.zeros(0)
    return _strongest(found, toxic, evidence, SURE, 0.5)


def _strongest(found: Tokens, toxic: np.ndarray, value: np.ndarray, least: float, share: float) -> np.ndarray:
    """Tokens of toxic documents of ``least`` value that come near the best token of their document."""
    best = np.full(found.texts, -np.inf)
    np.maximum.at(best, found.owner, value)
    near = value >= np.maximum(least, share * best[found.owner])
    return near & (toxic[found.owner] == 1)


def _logistic(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    w = np.zeros(rows.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -MOST, MOST)))
        slope = rows.T @ (weights * (labels - p)) - 0.1 * w
        bend = (rows * (weights * p * (1 - p) + 1e-9)[:, None]).T @ rows + 0.1 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step / max(1.0, np.abs(step).max() / 2)
    return w


def fit(texts: list[str], labels: np.ndarray, share: float | None = None) -> Model:
    """Fit on texts and their 0/1 labels; without texts of both labels, the score is their smoothed share.

    ``share`` is the share of label 1 among all documents, where the texts were chosen by label.
    """
    labels = np.asarray(labels, int)
    ones = int(labels.sum())
    if not 0 < ones < len(labels):
        return Model(shape=np.array([np.log((ones + 1) / (len(labels) - ones + 1)), 0.0, 0.0, 0.0]))
    # two of three texts of each label for the field, the third for the scores
    turn = np.empty(len(labels), int)
    for label in (0, 1):
        turn[labels == label] = np.arange((labels == label).sum())
    for_field = (turn % 3 != 2) | (min(ones, len(labels) - ones) < 6)
    raws = [t.encode() for t in texts]
    found = tokens([r for r, u in zip(raws, for_field, strict=True) if u])
    toxic = labels[for_field]
    model = _fit_field(found, _seeds(found, toxic))
    p = model.marginals(found)
    model = _fit_field(found, _strongest(found, toxic, p, 0.0, 1.0) | ((p > 0.5) & (toxic[found.owner] == 1)))
    rest = ~for_field if (~for_field).any() else for_field
    found, toxic = tokens([r for r, u in zip(raws, rest, strict=True) if u]), labels[rest]
    share = ones / len(labels) if share is None else min(max(share, 1e-3), 1 - 1e-3)
    weights = np.where(toxic == 1, share / max(1, toxic.sum()), (1 - share) / max(1, (1 - toxic).sum())) * len(toxic)
    model.shape = _logistic(model.summary(found, model.marginals(found)), toxic.astype(float), weights)
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of doc_ids that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled documents that are not held out, half of each label.

    Labels that are null or no 0 or 1, and texts that are null, count as none; equal texts count once.
    Only the sample reaches the driver: ``sample_rows`` texts of at most ``SAMPLE_BYTES``.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").distinct().filter(~held_out())
    numbers = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    half = max(1, sample_rows // 2)
    # twice as many ids as wanted, as some texts are too long or missing: a list of bounded size
    ids = [marks.filter(F.col("toxic") == label).orderBy(*by_hash).limit(2 * half) for label in (0, 1)]
    wanted = F.broadcast(ids[0].unionByName(ids[1]))
    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.octet_length("text") <= SAMPLE_BYTES)
    once = short.join(wanted, "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    texts: dict[str, int] = {}
    for label in (0, 1):
        rows = once.filter(F.col("toxic") == label).orderBy(*by_hash).limit(half).collect()
        texts |= {r.text: r.toxic for r in rows}
    share = numbers.get(1, 0) / max(1, sum(numbers.values()))
    return fit(list(texts), np.array(list(texts.values()), int), share)


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("p", pa.float64())]))


def _spans(raws: list[bytes], found: Tokens, p: np.ndarray) -> list[list[dict]]:
    """Stretches of toxic tokens per text, in characters, with their strongest marginal."""
    out: list[list[dict]] = [[] for _ in raws]
    hot = np.flatnonzero(p > 0.5)
    if not len(hot):
        return out
    begin = np.flatnonzero(np.append(True, (np.diff(hot) > 1) | found.first[hot[1:]]))
    finish = np.append(begin[1:], len(hot))
    raw = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    offsets = np.append(0, np.cumsum([len(r) + 1 for r in raws]))
    for a, b in zip(begin.tolist(), finish.tolist(), strict=True):
        one, two = hot[a], hot[b - 1]
        text = int(found.owner[one])
        start = chars[found.starts[one]] - chars[offsets[text]]
        length = chars[found.ends[two]] - chars[found.starts[one]]
        out[text].append({"start": int(start), "length": int(length), "p": float(p[hot[a:b]].max())})
    return out


def toxic_spans(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score, spans) of ``docs`` (doc_id, text, any others), one per row.

    ``spans`` (start, length, p) are in characters of the whole text. Null and empty texts have no spans
    and the score of a text without tokens; repeated rows and null doc_ids are rows like others.
    """

    def run(batches):
        for batch in small_batches(batches):
            at = 0
            for raws in blocks_of_text(batch.column(1).to_pylist()):
                found = tokens(raws)
                p = model.marginals(found)
                spans = _spans(raws, found, p)
                columns = [batch.column(0).slice(at, len(raws)), pa.array(model.score(found, p)), pa.array(spans, SPAN)]
                at += len(raws)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, spans array<struct<start: long, length: long, p: double>>")
