"""Exact n-gram Jaccard join as a blocked sparse product of documents and their shingles.

Documents become sets of 64-bit shingle fingerprints; equal sets are one row of the product. Only the
part of a set that a partner of enough similarity must meet is multiplied: the first
``n - ceil(t n) + 1`` shingles in one order for all documents, frequent shingles last. Blocks of
shingles are multiplied apart: short columns give all their pairs, long ones give stars that connect
groups of copies, and are then multiplied again between documents not connected yet, but for pairs whose
sketches show that too many shingles differ. Pairs whose overlap so far cannot reach the size-derived bound
are dropped; the rest are compared whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.codes import small_batches
from pulsegrid.llm.components import components
from pulsegrid.session import fresh_folder

#: Columns of at most this many documents give all their pairs at once.
SHORT_COLUMN = 8
#: Passes that take entries out of long columns before these are multiplied; speed only.
CONTESTS = 3
#: At most this many shingles are moved to the end of the order; any choice gives the same links.
FREQUENT = 1 << 18
#: 64-bit words of a set's sketch, whatever its size; speed only.
SKETCH = 16
BLOCK_BYTES = 1 << 18
#: Texts of an Arrow batch that are Python strings at one time.
TEXTS = 512
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A-Z to a-z; every other byte stays.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
VALUES = _mixed(np.arange(1, 257, dtype=np.uint64) * STEP)
IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def word_codes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and first positions of the words in lower-cased bytes."""
    space = IS_SPACE[raw]
    word = ~space
    starts = np.flatnonzero(word & np.append(True, space[:-1]))
    ends = np.flatnonzero(word & np.append(space[1:], True)) + 1
    powers = np.full(len(raw) + 1, STEP, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    back = np.full(len(raw) + 1, BACK, np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    sums = np.append(np.uint64(0), np.cumsum(VALUES[raw] * powers[:-1]))
    lengths = (ends - starts).astype(np.uint64)
    return _mixed((sums[ends] - sums[starts]) * back[starts] + lengths * BACK), starts


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of every text; fewer than ``n`` words make one shingle."""
    empty = np.empty(0, np.uint64)
    found = [empty] * len(texts)
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < BLOCK_BYTES):
            size += len(texts[stop] or "")
            stop += 1
        raws = [(t or "").encode() for t in texts[at:stop]]
        raw = LOWER[np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)]
        codes, starts = word_codes(raw)
        breaks = np.cumsum([len(r) + 1 for r in raws])
        bounds = np.append(0, np.searchsorted(starts, breaks))
        weights = _mixed(np.arange(2, n + 2, dtype=np.uint64))
        whole = np.zeros(max(0, len(codes) - n + 1), np.uint64)
        for k in range(n):
            whole += _mixed(codes[k : k + len(whole)] ^ weights[k]) * (weights[k] | np.uint64(1))
        whole = _mixed(whole)
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if b - a >= n:
                found[at + i] = np.unique(whole[a : b - n + 1])
            elif b > a:
                short = xxhash.xxh3_64_intdigest(codes[a:b].tobytes())
                found[at + i] = np.array([short], np.uint64)
        at = stop
    return found


def _name(shingles: np.ndarray) -> int:
    """Fingerprint of a set, as a signed 64-bit integer; the empty set is 0."""
    if not len(shingles):
        return 0
    name = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return name - (1 << 64) if name >> 63 else name


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """``SKETCH`` words per set: each bit is the parity of the shingles that fall on it.

    A shingle that two sets share cancels, so at least as many shingles differ as bits do.
    """
    bits = 64 * SKETCH
    if not sets:
        return np.empty((0, SKETCH), np.int64)
    shingles = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    odd = np.bincount(owner * bits + (shingles >> np.uint64(40)).astype(np.int64) % bits, minlength=len(sets) * bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).reshape(len(sets), SKETCH)


MEMBERS = ["doc_id", "text_hash", "set_id", "n_shingles", "sketch"]


def members(docs: DataFrame, n: int = 5) -> DataFrame:
    """Rows (doc_id, text_hash, set_id, n_shingles, sketch), one per row of ``docs``."""

    def run(batches):
        for batch in small_batches(batches, TEXTS):
            sets = shingle_sets(batch.column(2).to_pylist(), n)
            names = pa.array([_name(s) for s in sets], pa.int64())
            sizes = pa.array([len(s) for s in sets], pa.int64())
            words = sketches(sets)
            drawn = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * SKETCH, pa.int32()), pa.array(words.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names, sizes, drawn], MEMBERS)

    return docs.mapInArrow(run, "doc_id long, text_hash long, set_id long, n_shingles long, sketch array<long>")


def _repeated(docs: DataFrame, n: int) -> DataFrame:
    """Rows (shingle, seen): shingles that occur again within a task's documents, with their counts."""

    def run(batches):
        for batch in batches:
            parts = [shingle_sets(part.column(0).to_pylist(), n) for part in small_batches([batch], TEXTS)]
            sets = [s for part in parts for s in part]
            if sets and (whole := np.concatenate(sets)).size:
                shingles, seen = np.unique(whole, return_counts=True)
                own = seen > 1
                columns = [pa.array(shingles[own].view(np.int64)), pa.array(seen[own])]
                yield pa.RecordBatch.from_arrays(columns, ["shingle", "seen"])

    return docs.select("text").mapInArrow(run, "shingle long, seen long")


def frequent_shingles(docs: DataFrame, n: int, most: int = FREQUENT) -> np.ndarray:
    """At most ``most`` of the shingles that many documents share, sorted: 8 bytes each.

    They only order the shingles, so the links do not depend on which are chosen.
    """
    counts = _repeated(docs, n).groupBy("shingle").agg(F.sum("seen").alias("seen"))
    top = counts.filter(F.col("seen") > SHORT_COLUMN).orderBy(F.desc("seen"), "shingle").limit(most)
    found = top.select("shingle").toPandas()["shingle"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def least_overlap(size: int | np.ndarray, percent: int):
    """Fewest shingles a set of this size shares with any partner: ceil(t n)."""
    return (size * percent + 99) // 100


def _entries(docs: DataFrame, n: int, percent: int, frequent, blocks: int) -> DataFrame:
    """Non-zero entries of the product's columns, gathered per task and block of shingles."""

    def run(batches):
        done: set[int] = set()
        late = frequent.value
        for batch in small_batches(batches, 4 * TEXTS):
            parts = []
            for shingles in shingle_sets(batch.column(0).to_pylist(), n):
                name = _name(shingles)
                if not len(shingles) or name in done:
                    continue
                if len(done) < 1_000_000:
                    done.add(name)
                if len(late):
                    at = np.minimum(np.searchsorted(late, shingles), len(late) - 1)
                    often = late[at] == shingles
                    ordered, rare = np.concatenate([shingles[~often], shingles[often]]), int((~often).sum())
                else:
                    ordered, rare = shingles, len(shingles)
                size = len(shingles)
                first = ordered[: size - least_overlap(size, percent) + 1]
                parts.append((first, name, size, 255 * rare // size))
            if not parts:
                continue
            shingles = np.concatenate([p[0] for p in parts])
            lengths = [len(p[0]) for p in parts]
            names = np.repeat(np.array([p[1] for p in parts], np.int64), lengths)
            sizes = np.repeat(np.array([p[2] for p in parts], np.int32), lengths)
            rare = np.repeat(np.array([p[3] for p in parts], np.uint8), lengths)
            block = (shingles >> np.uint64(40)) % np.uint64(blocks)
            order = np.argsort(block, kind="stable")
            edges = np.append(np.flatnonzero(np.diff(block[order], prepend=-1)), len(order))
            rows = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = order[a:b]
                rows.append((int(block[own[0]]), *(x[own].tobytes() for x in (shingles, names, sizes, rare))))
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            columns[0] = columns[0].cast(pa.int32())
            yield pa.RecordBatch.from_arrays(columns, ["block", "shingles", "names", "sizes", "rare"])

    return docs.select("text").mapInArrow(run, "block int, shingles binary, names binary, sizes binary, rare binary")


PRODUCT = "kind int, shingle long, a long, b long, size int, need int"


def least_met(low: np.ndarray, high: np.ndarray, percent: int) -> np.ndarray:
    """Fewest columns that similar sets of these sizes share in the multiplied part.

    Together they share ``percent (low + high) / (100 + percent)`` shingles. Behind the part of the
    set whose part ends first lie fewer than ``t n`` of its own; all that are shared before count.
    """
    shared = -(-percent * (low + high) // (100 + percent))
    return shared - least_overlap(high, percent) + 1


def _product(percent: int):
    """Multiply one block: pairs (kind 0) of short columns and stars (kind 1), members of long ones (kind 2)."""

    def run(table: pa.Table) -> pa.Table:
        shingles = np.frombuffer(b"".join(table.column("shingles").to_pylist()), np.uint64)
        names = np.frombuffer(b"".join(table.column("names").to_pylist()), np.int64)
        sizes = np.frombuffer(b"".join(table.column("sizes").to_pylist()), np.int32)
        rare = np.frombuffer(b"".join(table.column("rare").to_pylist()), np.uint8)
        order = np.lexsort((names, shingles))
        shingles, names, sizes, rare = shingles[order], names[order], sizes[order], rare[order]
        fresh = np.append(True, (shingles[1:] != shingles[:-1]) | (names[1:] != names[:-1])) if len(names) else []
        shingles, names, sizes, rare = shingles[fresh], names[fresh], sizes[fresh], rare[fresh]
        starts = np.flatnonzero(np.append(True, shingles[1:] != shingles[:-1]))
        counts = np.diff(np.append(starts, len(shingles)))
        column = np.repeat(np.arange(len(starts)), counts)
        place = np.arange(len(shingles)) - starts[column]
        short = counts[column] <= SHORT_COLUMN
        left, right = [], []
        for back in range(1, SHORT_COLUMN):
            b = np.flatnonzero(short & (place >= back))
            left.append(b - back)
            right.append(b)
        left, right = np.concatenate(left), np.concatenate(right)
        low, high = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
        fits = low.astype(np.int64) * 100 >= high.astype(np.int64) * percent
        left, right = left[fits], right[fits]
        sizes = sizes.astype(np.int64)
        long = np.flatnonzero(~short)
        # one of a few pivots per column, of the sizes next to the member's: the one with the smallest
        # share of rare shingles, because copies that were changed least are near most of the others
        level = (np.log(np.maximum(sizes, 1)) / math.log(100 / percent) * 2).astype(np.int64)
        stars = long[np.lexsort((names[long], rare[long], level[long], column[long]))]
        group = np.append(True, (column[stars][1:] != column[stars][:-1]) | (level[stars][1:] != level[stars][:-1]))
        heads = stars[group] if len(stars) else stars
        pivot = heads[np.cumsum(group) - 1] if len(stars) else stars
        own = pivot != stars
        pivot, stars = pivot[own], stars[own]
        for step in (1, 2):  # similar sets are at most two levels apart: link the pivots of these too
            one, two = heads[:-step], heads[step:]
            low, high = np.minimum(sizes[one], sizes[two]), np.maximum(sizes[one], sizes[two])
            near = (column[one] == column[two]) & (low * 100 >= high * percent)
            pivot, stars = np.append(pivot, one[near]), np.append(stars, two[near])
        kind = np.repeat(np.array([0, 1, 2], np.int32), [len(left), len(stars), len(long)])
        nothing = np.zeros(len(left) + len(stars), np.int64)
        a = np.concatenate([names[left], names[pivot], names[long]])
        b = np.concatenate([names[right], names[stars], np.zeros(len(long), np.int64)])
        one, two = np.minimum(a, b), np.maximum(a, b)
        pairs = kind < 2
        first, second = np.concatenate([left, pivot]), np.concatenate([right, stars])
        low, high = np.minimum(sizes[first], sizes[second]), np.maximum(sizes[first], sizes[second])
        need = np.concatenate([least_met(low, high, percent), np.zeros(len(long), np.int64)])
        return pa.table(
            {
                "kind": kind,
                "shingle": np.concatenate([nothing, shingles[long].view(np.int64)]),
                "a": np.where(pairs, one, a),
                "b": np.where(pairs, two, b),
                "size": np.concatenate([nothing, sizes[long]]).astype(np.int32),
                "need": need.astype(np.int32),
            }
        )

    return run


#: Bits of the filter of wanted sets, whatever their number: 2 MB. It only spares sending sets.
FILTER_BITS = 1 << 24
FILTER_PARTS = 16


def _filter_places(names: np.ndarray) -> list[np.ndarray]:
    mixed = _mixed(names.view(np.uint64))
    return [(mixed >> np.uint64(shift)) % np.uint64(FILTER_BITS) for shift in (0, 31)]


def name_filter(nodes: DataFrame) -> np.ndarray:
    """Bits that tell which sets are surely not among ``nodes``; of a fixed size."""

    def mark(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            for place in _filter_places(batch.column(0).to_numpy()):
                bits[place] = True
        parts = np.packbits(bits).reshape(FILTER_PARTS, -1)
        rows = [(i, p.tobytes()) for i, p in enumerate(parts) if p.any()]
        if rows:
            columns = [pa.array([i for i, _ in rows], pa.int32()), pa.array([p for _, p in rows])]
            yield pa.RecordBatch.from_arrays(columns, ["part", "bits"])

    def merge(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(raw, np.uint8)
                parts[i] = parts[i] | own if i in parts else own
        if parts:
            columns = [pa.array(list(parts), pa.int32()), pa.array([p.tobytes() for p in parts.values()])]
            yield pa.RecordBatch.from_arrays(columns, ["part", "bits"])

    marked = nodes.mapInArrow(mark, "part int, bits binary")
    found = marked.repartition("part").mapInArrow(merge, "part int, bits binary").collect()
    whole = np.zeros((FILTER_PARTS, FILTER_BITS // 8 // FILTER_PARTS), np.uint8)
    for row in found:
        whole[row.part] |= np.frombuffer(row.bits, np.uint8)
    return whole.ravel()


def maybe_in(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    keep = np.ones(len(names), bool)
    for place in _filter_places(names):
        keep &= (bits[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1 == 1
    return keep


def _packed(shingles: np.ndarray) -> bytes:
    """The upper 48 bits of every fingerprint, enough to tell the shingles of two sets apart."""
    return shingles.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view(">u8").ravel().astype(np.uint64)


def _linked(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of distinct pairs (a, b) of sets that are similar enough, compared whole."""

    def read(batches):
        done: set[int] = set()
        for batch in small_batches(batches, 1024):
            sets = {_name(s): s for s in shingle_sets(batch.column(0).to_pylist(), n) if len(s)}
            names = np.fromiter(sets, np.int64, len(sets))
            names = [k for k in names[maybe_in(wanted.value, names)].tolist() if k not in done]
            if len(done) < 1_000_000:
                done.update(names)
            columns = [pa.array(names, pa.int64()), pa.array([_packed(sets[k]) for k in names], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "shingles"])

    def compare(batches):
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = _unpacked(one), _unpacked(two)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = docs.sparkSession.sparkContext.broadcast(name_filter(pairs.select(F.explode(F.array("a", "b")).alias("node"))))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node"), "a", "b")
    sets = docs.select("text").mapInArrow(read, "node long, shingles binary")
    sets = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))
    sides = asked.join(sets, "node")
    met = sides.groupBy("a", "b").agg(F.min("shingles").alias("x"), F.max("shingles").alias("y"))
    return met.mapInArrow(compare, "a long, b long")


def _reachable(pairs: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs whose overlap so far, with what long columns may add, reaches what similar sets need."""
    counts = long.groupBy("node").agg(F.count(F.lit(1)).alias("_in"))
    for side in "ab":
        own = counts.select(F.col("node").alias(side), F.col("_in").alias(f"_in_{side}"))
        pairs = pairs.join(own, side, "left")
    more = F.least(*[F.coalesce(f"_in_{s}", F.lit(0)) for s in "ab"])
    return pairs.filter(F.col("met") + more >= F.col("need")).select("a", "b")


def _write(frame: DataFrame, name: str) -> DataFrame:
    folder = fresh_folder(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.parquet(folder)


def _need(small: Column, large: Column, percent: int) -> Column:
    """``least_met`` as a column."""
    shared = F.ceil((small + large) * percent / (100 + percent))
    return shared - F.floor((large * percent + 99) / 100) + 1


def _contested(long: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """Entries of long columns at which a set may meet a similar one of another group.

    Two such sets meet on at most as many columns as either has among the contested ones (``inside``)
    or shares short ones with any other set (``most``). An entry whose set cannot reach, that way, what
    the partner of the most favourable size in its column needs, goes; then fewer columns are contested,
    and fewer columns are left to count. Every entry that a similar pair of two groups shares stays.
    """
    ends = met.select(F.explode(F.array("a", "b")).alias("node"), "met").filter("met > 0")
    most = ends.groupBy("node").agg(F.max("met").alias("most"))
    long = long.join(most, "node", "left").withColumn("most", F.coalesce("most", F.lit(0)))
    names = ["shingle", "node", "size", "component", "most"]
    spans = [F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.min("size").alias("_small"), F.max("size").alias("_large")]
    for _ in range(CONTESTS):
        open_columns = long.groupBy("shingle").agg(*spans).filter("_lo < _hi")
        long = _write(long.select(*names).join(open_columns, "shingle"), "columns")
        long = long.join(long.groupBy("node").agg(F.count(F.lit(1)).alias("inside")), "node")
        small = F.greatest(F.col("_small"), F.col("size") * percent / 100)
        large = F.least(F.col("_large"), F.col("size") * 100 / percent)
        # least_met without rounding up: it falls with the larger size and grows with the smaller
        least = [(x + y) * percent / (100 + percent) - (y * percent + 99) / 100 + 1 for x, y in ((small, F.col("size")), (F.col("size"), large))]
        long = long.filter(F.col("inside") + F.col("most") >= F.least(*least) - 1e-6)
    return _write(long.select(*names, "inside"), "contested")


def _may_be_similar(percent: int) -> Column:
    """False where the sketches ``_s0_a``, ``_s0_b``, ... of two sets differ in more bits than similar sets in shingles."""
    differ = sum((F.bit_count(F.col(f"_s{i}_a").bitwiseXOR(F.col(f"_s{i}_b"))) for i in range(SKETCH)), F.lit(0))
    return differ * (100 + percent) <= (F.col("size_a") + F.col("size_b")) * (100 - percent)


def links(docs: DataFrame, named: DataFrame, n: int = 5, percent: int = 75, blocks: int | None = None) -> DataFrame:
    """Rows (a, b): links that connect all similar sets; links inside a found group may be left out.

    ``named`` are the ``members`` of ``docs``. ``blocks`` sets how many parts the product has (by
    default one per shuffle partition).
    """
    spark: SparkSession = docs.sparkSession
    blocks = blocks or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, n))
    entries = _entries(docs, n, percent, frequent, blocks)
    product = _write(entries.groupBy("block").applyInArrow(_product(percent), PRODUCT), "product")
    long = product.filter("kind = 2").select("shingle", F.col("a").alias("node"), "size")
    met = product.filter("kind < 2").groupBy("a", "b").agg(F.sum(1 - F.col("kind")).alias("met"), F.min("need").alias("need"))
    met = _write(met, "met")
    pairs = _write(_reachable(met, long), "pairs")
    first = _write(_linked(pairs, docs, n, percent), "links")
    found = components(first)
    label = F.coalesce("component", "node").alias("component")
    long = _contested(long.join(found, "node", "left").select("shingle", "node", "size", label), met, percent)
    drawn = named.join(long.select(F.col("node").alias("set_id")).distinct(), "set_id", "left_semi")
    drawn = drawn.groupBy(F.col("set_id").alias("node")).agg(F.first("sketch").alias("_sketch"))
    long = long.join(drawn, "node").select(*long.columns, *[F.col("_sketch")[i].alias(f"_s{i}") for i in range(SKETCH)])
    sides = ("node", "size", "component", "inside", "most", *[f"_s{i}" for i in range(SKETCH)])
    one, two = (long.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in sides]) for s in "ab")
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    reach = F.least("inside_a", "inside_b") + F.least("most_a", "most_b")
    across = one.join(two, "shingle").filter("component_a < component_b").filter(small * 100 >= large * percent)
    across = across.filter(reach >= _need(small, large, percent)).filter(_may_be_similar(percent))
    across = across.groupBy(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    counted = across.agg(F.count(F.lit(1)).alias("_long"), F.min(small).alias("small"), F.min(large).alias("large"))
    counted = counted.join(met.select("a", "b", "met"), ["a", "b"], "left")
    need = _need(F.col("small"), F.col("large"), percent)
    more = counted.filter(F.col("_long") + F.coalesce("met", F.lit(0)) >= need).select("a", "b")
    more = _write(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
    return first.union(_linked(more, docs, n, percent))


def similar_groups(docs: DataFrame, n: int = 5, percent: int = 75, blocks: int | None = None) -> DataFrame:
    """Rows (doc_id, text_hash, n_shingles, group, component_id), one per row of ``docs`` (doc_id, text, others).

    Documents link when ``100 * intersection >= percent * union`` of their shingle sets; the component
    is the smallest doc_id reachable. Null and empty texts, and texts of spaces, link with nothing.
    Rows without a doc_id link like others, but give no component its name; a component of none but
    such rows has none. ``group`` names the component in any case (null: the row links with nothing).
    Repeated rows and equal doc_ids all stay.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    named = _write(members(rows, n), "members")
    found = components(links(rows, named, n, percent, blocks)).withColumnRenamed("node", "set_id")
    own = named.drop("sketch").join(found, "set_id", "left").withColumn("_group", F.coalesce("component", "set_id"))
    least = own.filter("n_shingles > 0").groupBy("_group").agg(F.min("doc_id").alias("_least"))
    named = own.join(least, "_group", "left")
    label = F.when(F.col("n_shingles") > 0, F.col("_least")).otherwise(F.col("doc_id"))
    group = F.when(F.col("n_shingles") > 0, F.col("_group")).alias("group")
    return named.select("doc_id", "text_hash", "n_shingles", group, label.alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one of the smallest doc_id, then text hash.

    Rows without words are no copies of anything and all stay. All columns are kept as they are.
    """
    least = (1 << 63) - 1
    groups = similar_groups(docs, n, percent).filter("group IS NOT NULL")
    name = F.struct(F.coalesce("doc_id", F.lit(least)).alias("_id"), F.col("text_hash").alias("_hash"))
    chosen = groups.groupBy("group").agg(F.min(name).alias("_first")).select("_first.*").distinct()
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("_id")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.filter(worded).select(F.struct("*").alias("_row"), key, F.xxhash64("text").alias("_hash"))
    kept = rows.join(chosen, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
    return kept.select("_row.*").unionByName(docs.filter(~worded))
