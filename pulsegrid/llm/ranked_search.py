"""Ranked lexical search over an index of documents grouped by their length normaliser.

Documents of one normaliser ``m`` are a stratum. A stratum is cut into blocks of bounded size, and
neighbouring blocks are a chunk, of bounded size too; a chunk gives the best documents of an item once. A block
holds, per term, the documents in order of falling term frequency. As ``m`` is one number per block, the
impact of a frequency is computed once and serves all postings that have it. The largest impact of each
item term in a stratum bounds every score there: strata are visited in the order of their bounds, the
best documents of the first ones give a threshold, and only strata whose bound reaches it are visited
after them. The bounds hold for all documents, so the ranking is exact.

Terms are 64-bit fingerprints. Postings of terms that no item has are left out by a bit filter of fixed
size; lengths and the corpus totals count all terms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.codes import small_batches
from pulsegrid.llm.shingle_join import BLOCK_BYTES, word_codes
from pulsegrid.session import fresh_folder

#: Bits of the filter of item terms (128 KB, whatever the items); its size affects speed only.
FILTER_BITS = 1 << 20
BLOCK_DOCS = 4096
BLOCK_POSTINGS = 1 << 20
#: A chunk is closed after the block with which it holds this many documents or postings.
CHUNK_DOCS = 1 << 16
CHUNK_POSTINGS = 1 << 21
#: Documents whose scores give the first threshold of an item, about; affects speed only.
FIRST_DOCS = 4096


def _term_bytes() -> np.ndarray:
    """What each byte counts as: A-Z as a-z, digits, a-z and all of non-ASCII as itself, the rest a space."""
    table = np.full(256, 32, np.uint8)
    for first, last in ((48, 57), (97, 122), (128, 255)):
        table[first : last + 1] = np.arange(first, last + 1)
    table[65:91] = np.arange(97, 123)
    return table


TERM_BYTES = _term_bytes()


def blocks_of_text(texts: list[str | None]):
    """Encoded texts, about ``BLOCK_BYTES`` together or one longer text."""
    part, size = [], 0
    for text in texts:
        raw = (text or "").encode()
        if part and size + len(raw) > BLOCK_BYTES:
            yield part
            part, size = [], 0
        part.append(raw)
        size += len(raw)
    if part:
        yield part


def term_counts(texts: list[str | None], wanted: np.ndarray | None = None):
    """Per block of texts: terms per text, then text number, term and frequency, sorted, of wanted terms.

    ``wanted`` has a true entry for each remainder of a wanted term by its length (a power of two).
    """
    for part in blocks_of_text(texts):
        raw = TERM_BYTES[np.frombuffer(b" ".join(part) + b" ", np.uint8)]
        codes, starts = word_codes(raw)
        ends = np.cumsum([len(r) + 1 for r in part])
        own = np.searchsorted(ends, starts, side="right")
        lengths = np.bincount(own, minlength=len(part))
        if wanted is not None:
            seen = wanted[codes & np.uint64(len(wanted) - 1)]
            codes, own = codes[seen], own[seen]
        codes = codes.view(np.int64)
        order = np.lexsort((codes, own))
        codes, own = codes[order], own[order]
        new = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (own[1:] != own[:-1]))[: len(codes)])
        yield lengths, own[new], codes[new], np.diff(np.append(new, len(codes)))


def _lists(owner: np.ndarray, rows: int, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.searchsorted(owner, np.arange(rows + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def terms(rows: DataFrame, key: str, wanted: np.ndarray | None = None) -> DataFrame:
    """Rows (key, n, terms, tfs) of rows (key, text): all terms counted in ``n``, wanted ones listed."""

    def run(batches):
        for batch in small_batches(batches):
            at = 0
            for lengths, own, codes, tfs in term_counts(batch.column(1).to_pylist(), wanted):
                columns = [
                    batch.column(0).slice(at, len(lengths)),
                    pa.array(lengths, pa.int64()),
                    _lists(own, len(lengths), codes, pa.int64()),
                    _lists(own, len(lengths), tfs, pa.int32()),
                ]
                at += len(lengths)
                yield pa.RecordBatch.from_arrays(columns, [key, "n", "terms", "tfs"])

    found = rows.select(F.col(key).cast("long").alias(key), "text")
    return found.mapInArrow(run, f"{key} long, n long, terms array<long>, tfs array<int>")


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of ``items`` (item_id, text); rows of one item_id are one item."""
    listed = terms(items.filter("item_id IS NOT NULL"), "item_id")
    return listed.select("item_id", F.explode("terms").alias("term")).distinct()


def _filter(wanted: DataFrame) -> np.ndarray:
    """Remainders of the terms of ``wanted`` by FILTER_BITS, as true entries."""
    place = F.expr(f"pmod(term, {FILTER_BITS})")
    maps = wanted.select(place.alias("place")).groupBy(F.expr("bitmap_bucket_number(place)").alias("part"))
    found = maps.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bits")).collect()
    bits = np.zeros(FILTER_BITS + (1 << 15), bool)
    for row in found:  # numbered from 1 (0 holds place 0 only), 32 768 places each
        part = np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little").astype(bool)
        at = (row.part - 1) * (1 << 15) + 1 if row.part > 0 else 0
        bits[at : at + len(part)] |= part[: len(bits) - at]
    return bits[:FILTER_BITS]


@dataclass(frozen=True)
class Index:
    """A stored index: its folder, the number of documents with terms, and all their terms."""

    spark: SparkSession
    folder: str
    documents: int
    terms: int

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)


BLOCK = "part int, m long, doc_ids array<long>, terms array<long>, dfs array<int>, most array<int>, places array<int>, tfs array<int>"


def _block(part: int, m: int, docs: list) -> pa.RecordBatch:
    """One block, in the task's chunk ``part``, of documents (doc_id, terms, tfs) of normaliser ``m``."""
    sizes = [len(d[1]) for d in docs]
    place = np.repeat(np.arange(len(docs)), sizes)
    codes = np.concatenate([d[1] for d in docs])
    tfs = np.concatenate([d[2] for d in docs])
    order = np.lexsort((place, -tfs, codes))
    codes, tfs, place = codes[order], tfs[order], place[order]
    new = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
    row = {
        "part": part,
        "m": m,
        "doc_ids": [d[0] for d in docs],
        "terms": codes[new],
        "dfs": np.diff(np.append(new, len(codes))),
        "most": tfs[new],
        "places": place,
        "tfs": tfs,
    }
    kinds = [pa.int32(), pa.int64(), *[pa.list_(k) for k in (pa.int64(), pa.int64(), *[pa.int32()] * 4)]]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))


def _cut(batches):
    """Documents (m, doc_id, terms, tfs) that come by m, as blocks."""
    m, docs, postings = None, [], 0
    part, held, held_postings = 0, 0, 0
    for batch in small_batches(batches, 1024):
        lists = []
        for name in ("terms", "tfs"):
            column = batch.column(name)
            ends = np.asarray(column.offsets)
            values = np.asarray(column.values)
            lists.append([values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
        for here, doc_id, codes, tfs in zip(batch.column("m").to_pylist(), batch.column("doc_id").to_pylist(), *lists, strict=True):
            if docs and (here != m or len(docs) >= BLOCK_DOCS or postings >= BLOCK_POSTINGS):
                yield _block(part, m, docs)
                held, held_postings = held + len(docs), held_postings + postings
                if held >= CHUNK_DOCS or held_postings >= CHUNK_POSTINGS:
                    part, held, held_postings = part + 1, 0, 0
                docs, postings = [], 0
            m = here
            docs.append((doc_id, codes, tfs))
            postings += len(codes)
    if docs:
        yield _block(part, m, docs)


def build_index(docs: DataFrame, wanted: DataFrame | None = None) -> Index:
    """Index every row of ``docs`` (doc_id, text, any others) that has a term.

    ``wanted`` (term) restricts the postings to these terms, and a few others, not the lengths.
    Repeated rows are documents of their own; a null doc_id stays null.
    """
    spark = docs.sparkSession
    counted = fresh_folder(spark, "counted")
    bits = None if wanted is None else _filter(wanted)
    terms(docs, "doc_id", bits).withColumn("row", F.monotonically_increasing_id()).write.parquet(counted)
    rows = spark.read.parquet(counted).filter("n > 0")
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    folder = fresh_folder(spark, "index")
    m = F.expr(f"10 + (90 * n * {totals.n}L) div {max(1, totals.l or 0)}L").alias("m")
    # the row number spreads a stratum that holds many of the documents over several tasks
    placed = rows.select(m, "row", "doc_id", "terms", "tfs").repartitionByRange("m", "row")
    blocks = placed.sortWithinPartitions("m", "row").drop("row").mapInArrow(_cut, BLOCK)
    chunk = (F.spark_partition_id().cast("long") * (1 << 32) + F.col("part")).alias("chunk")
    blocks.select("*", chunk, F.monotonically_increasing_id().alias("block")).drop("part").write.parquet(folder)
    return Index(spark, folder, totals.n, totals.l or 0)


def _weighted(asked: DataFrame, stats: DataFrame, documents: int) -> DataFrame:
    """Rows (item_id, term, w) for the terms that a document has."""
    dfs = stats.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.expr(f"CAST(floor(1000 * ln((2 * {documents}L + 2) / (2 * df + 1))) AS BIGINT)")
    return asked.join(dfs, "term").select("item_id", "term", weight.alias("w"))


def _scored(visits: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Rows (item_id, doc_id, score): the k best of an item in each chunk, by (chunk, item_id, floor, terms, ws, blocks).

    An item visits the ``blocks`` of the chunk that it names. Only scores of at least ``floor`` count, and
    after k documents of the chunk only those that reach the worst of the k.
    """

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = [
            (row["item_id"], np.array(row["terms"], np.int64), np.array(row["ws"], np.int64))
            for row in right.select(["item_id", "terms", "ws"]).to_pylist()
        ]
        floors = [max(1, floor) for floor in right.column("floor").to_pylist()]
        nothing = np.empty(0, np.int64)
        best = [(nothing, nothing, nothing)] * len(asked)  # scores, doc_ids, 1 for a null doc_id
        callers: dict[int, list[int]] = {}
        for i, blocks_ in enumerate(right.column("blocks").to_pylist()):
            for b in blocks_:
                callers.setdefault(b, []).append(i)
        for batch in left.to_batches():
            for at, (block, m) in enumerate(zip(batch.column("block").to_pylist(), batch.column("m").to_pylist(), strict=True)):
                docs = batch.column("doc_ids")[at].values
                terms_, dfs, most, places, tfs = (
                    np.asarray(batch.column(c)[at].values) for c in ("terms", "dfs", "most", "places", "tfs")
                )
                if not len(terms_):
                    continue
                unknown = docs.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                doc_ids = docs.fill_null(0).to_numpy()
                ends = np.cumsum(dfs)
                found, rank = np.unique(tfs, return_inverse=True)
                found = found.astype(np.int64)
                impact = 1_000_000_000 * found // (1000 * found + 8 * m)
                impacts = impact[rank]
                highest = impact[np.searchsorted(found, most)]
                for i in callers.get(block, ()):
                    _, codes, ws = asked[i]
                    spot = np.minimum(np.searchsorted(terms_, codes), len(terms_) - 1)
                    here = terms_[spot] == codes
                    spot, ws = spot[here], ws[here]
                    if (ws * highest[spot]).sum() < floors[i]:
                        continue
                    total = np.zeros(len(doc_ids), np.int64)
                    for j, w in zip(spot.tolist(), ws.tolist(), strict=True):
                        part = slice(ends[j] - dfs[j], ends[j])
                        total[places[part]] += w * impacts[part]
                    own = np.flatnonzero(total >= floors[i])
                    if not len(own):
                        continue
                    scores, ids, nulls = (
                        np.concatenate(pair) for pair in zip(best[i], (total[own], doc_ids[own], unknown[own]), strict=True)
                    )
                    order = np.lexsort((ids, nulls, -scores))[:k]
                    best[i] = scores[order], ids[order], nulls[order]
                    if len(order) == k:
                        floors[i] = max(floors[i], int(best[i][0][-1]))
        sizes = [len(scores) for scores, _, _ in best]
        items = np.repeat(np.array([item for item, _, _ in asked], np.int64), sizes)
        scores, ids, nulls = (np.concatenate([nothing, *(b[c] for b in best)]) for c in range(3))
        columns = [pa.array(items), pa.array(ids, mask=nulls.astype(bool)), pa.array(scores)]
        return pa.table(columns, ["item_id", "doc_id", "score"])

    asked = visits.withColumnRenamed("chunk", "at")
    touched = blocks.join(visits.select(F.explode("blocks").alias("block")).distinct(), "block", "left_semi")
    pairs = touched.groupBy("chunk").cogroup(asked.groupBy("at"))
    return pairs.applyInArrow(score, "item_id long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, asked: DataFrame, k: int = 10) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``k`` best documents of each item of ``item_terms``.

    Equal scores come by ascending doc_id, nulls last. Items without terms, or whose terms no document
    has, have no rows. Scores and weights are whole numbers, so reruns agree.
    """
    spark = index.spark
    blocks = index.blocks()
    each = F.explode(F.arrays_zip("terms", "dfs", "most")).alias("t")
    stats = blocks.select("m", each).select("m", F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"), F.col("t.most").alias("most"))
    stored = fresh_folder(spark, "weights")
    _weighted(asked, stats, index.documents).write.parquet(stored)
    weighted = spark.read.parquet(stored)
    strata = stats.groupBy("m", "term").agg(F.max("most").cast("long").alias("most"))
    impact = F.expr("(1000000000 * most) div (1000 * most + 8 * m)")
    bounds = strata.join(weighted, "term").groupBy("item_id", "m").agg(F.sum(F.col("w") * impact).alias("bound"))
    sizes = blocks.groupBy("m").agg(F.sum(F.size("doc_ids")).alias("docs"))
    best_first = Window.partitionBy("item_id").orderBy(F.desc("bound"), "m")
    before = F.coalesce(F.sum("docs").over(best_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ordered = fresh_folder(spark, "strata")
    bounds.join(sizes, "m").withColumn("first", before < FIRST_DOCS).write.parquet(ordered)
    strata = spark.read.parquet(ordered)
    listed = weighted.groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("t"))
    listed = listed.select("item_id", F.col("t.term").alias("terms"), F.col("t.w").alias("ws"))

    def visits(wanted: DataFrame) -> DataFrame:
        where = wanted.join(blocks.select("m", "chunk", "block"), "m")
        where = where.groupBy("chunk", "item_id").agg(F.first("floor").alias("floor"), F.collect_list("block").alias("blocks"))
        return where.join(listed, "item_id")

    first = fresh_folder(spark, "first")
    _scored(visits(strata.filter("first").withColumn("floor", F.lit(1).cast("long"))), blocks, k).write.parquet(first)
    scored = spark.read.parquet(first)
    floors = _ranked(scored, k).filter(F.col("rank") == k).select("item_id", F.col("score").alias("floor"))
    rest = strata.filter("NOT first").join(floors, "item_id", "left").withColumn("floor", F.coalesce("floor", F.lit(1)))
    later = _scored(visits(rest.filter("bound >= floor")), blocks, k)
    return _ranked(scored.unionByName(later), k).select("item_id", "rank", "doc_id", "score")


#: The whole ranking restated: every document is scored for every item.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
totals AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, totals),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * len(t) * n) // l) AS m FROM d, totals WHERE len(t) > 0),
s AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY item_id, r),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id
    ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM s JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
