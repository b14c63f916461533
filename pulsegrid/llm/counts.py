"""Token counts by a compiled finite-state machine.

Byte-pair encoding of a word read from left to right needs only a bounded look back: the last token of
every prefix is the one vocabulary entry that ends there and may follow the last token of the prefix
before it. A state is therefore the longest suffix that can still grow into a vocabulary entry, with
the last tokens and relative counts at its positions; a transition on a byte says how many tokens
became certain. The byte that ends a pre-token leads back to the start state.

States and transitions are made when first met and kept by the Python worker. Texts are cut into
chunks that run side by side: a chunk with a word end maps every entry state to the same exit, found
from the start state; the others are composed in a scan once their entry is known.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.codes import BLOCK_CHARS, BREAK, BYTE_CHARS, ODD, SPACE, Cutter, slices, small_batches

CHUNK = 128
MOST_STATES = 250_000
SPARE_STATES = 50_000
RESULT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Machine(Cutter):
    """Counts tokens of texts as the library does; built from the tokenizer file's merges."""

    def __init__(self, path: str):
        super().__init__(path)
        model = self.model
        self.ending = model.get("end_of_word_suffix") or ""
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.vocabulary = model["vocab"].keys()
        self.prefixes = {""}
        for token in self.vocabulary:
            plain = token.removesuffix(self.ending) if self.ending else token
            self.prefixes.update(plain[:i] for i in range(1, len(plain)))
        del self.model
        self._clear()

    def _clear(self) -> None:
        self.valid: dict[tuple[str | None, str], bool] = {}
        self.states = [("", (None,), (0,))]
        self.number = {self.states[0]: 0}
        self.symbol = np.zeros(512, np.int64)
        self.symbols = [None]  # column 0 pads: it counts nothing
        # next state + 1; 0 where no transition is made yet. Unused rows take no memory.
        self.next = np.zeros((MOST_STATES + SPARE_STATES, 128), np.int32)
        self.emit = np.zeros(self.next.shape, np.int16)

    def merged(self, parts: list[str]) -> list[str]:
        """Byte-pair encoding of a list of symbols: the lowest-ranked pair first, the leftmost of equals."""
        while len(parts) > 1:
            ranks = [self.rank.get(pair, len(self.rank)) for pair in zip(parts, parts[1:])]
            low = min(ranks)
            if low == len(self.rank):
                break
            at = ranks.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def parts(self, token: str) -> list[str]:
        if self.ending and token.endswith(self.ending):
            plain = token[: -len(self.ending)]
            return [*plain[:-1], plain[-1] + self.ending]
        return list(token)

    def follows(self, last: str | None, token: str) -> bool:
        """True if ``token`` may stand right after ``last`` (None: at the start of the word)."""
        found = self.valid.get((last, token))
        if found is None:
            whole = (self.parts(last) if last is not None else []) + self.parts(token)
            found = self.merged(whole) == ([token] if last is None else [last, token])
            self.valid[last, token] = found
        return found

    def _last(self, seen: str, lasts: tuple, char: str, ending: str) -> tuple[str, int]:
        """The last token after ``char``, and how many positions back it begins."""
        grown = seen + char
        for size in range(len(grown), 0, -1):
            token = grown[-size:] + ending
            if token in self.vocabulary and self.follows(lasts[len(lasts) - size], token):
                return token, size
        raise ValueError("the vocabulary has no entry for a single byte")

    def step(self, state: int, column: int) -> tuple[int, int]:
        """Next state and the count that became certain."""
        seen, lasts, counts = self.states[state]
        char, ends = self.symbols[column]
        token, size = self._last(seen, lasts, char, self.ending if ends else "")
        count = counts[len(counts) - size] + 1
        if ends:
            return 0, count
        grown = seen + char
        while grown not in self.prefixes:
            grown = grown[1:]
        lasts = (*lasts, token)[-len(grown) - 1 :]
        counts = (*counts, count)[-len(grown) - 1 :]
        key = (grown, lasts, tuple(c - counts[0] for c in counts))
        place = self.number.setdefault(key, len(self.states))
        if place == len(self.states):
            self.states.append(key)
        return place, counts[0]

    def _widen(self, rows: int, columns: int) -> None:
        shape = self.next.shape
        if rows > shape[0] or columns > shape[1]:
            for name in ("next", "emit"):
                old = getattr(self, name)
                new = np.zeros((max(shape[0], 2 * rows if rows > shape[0] else rows), max(shape[1], columns)), old.dtype)
                new[: shape[0], : shape[1]] = old
                setattr(self, name, new)

    def _columns(self, stream: np.ndarray) -> np.ndarray:
        for value in np.flatnonzero(np.bincount(stream, minlength=512)):
            if not self.symbol[value]:
                self.symbol[value] = len(self.symbols)
                self.symbols.append((chr(BYTE_CHARS[int(value) & 255]), value > 255))
        self._widen(1, -(-len(self.symbols) // 64) * 64)
        return self.symbol[stream]

    def _advance(self, states: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = self.next[states, columns] - 1
        missing = np.flatnonzero((after < 0) & (columns > 0))
        if len(missing):
            width = self.next.shape[1]
            for pair in np.unique(states[missing] * width + columns[missing]).tolist():
                state, column = divmod(pair, width)
                place, count = self.step(state, column)
                self._widen(place + 1, 1)
                self.next[state, column], self.emit[state, column] = place + 1, count
            after = self.next[states, columns] - 1
        return np.maximum(after, 0).astype(np.int64), self.emit[states, columns]

    def run(self, stream: np.ndarray) -> np.ndarray:
        """Counts emitted at every symbol of a stream that ends with a word end."""
        if len(self.states) > MOST_STATES:
            self._clear()
        lanes = -(-len(stream) // CHUNK)
        table = np.zeros(lanes * CHUNK, np.int64)
        table[: len(stream)] = self._columns(stream)
        resets = np.zeros(lanes * CHUNK, bool)
        resets[: len(stream)] = stream > 255
        table, resets = table.reshape(lanes, CHUNK).T.copy(), resets.reshape(lanes, CHUNK)
        head = np.where(resets.any(axis=1), resets.argmax(axis=1) + 1, CHUNK)
        out = np.zeros((CHUNK, lanes), np.int16)
        # maps of the chunks: behind the first word end, whatever the entry state
        states = np.zeros(lanes, np.int64)
        for i in range(CHUNK):
            own = np.flatnonzero(head <= i)
            if len(own):
                states[own], out[i, own] = self._advance(states[own], table[i, own])
        # scan: heads run once their entry is known
        known = np.append(True, head[:-1] < CHUNK)
        known[1:] |= resets[:-1, -1]
        entry = np.append(0, states[:-1])
        ready = np.flatnonzero(known)
        while len(ready):
            states[ready] = entry[ready]
            for i in range(int(head[ready].max())):
                own = ready[head[ready] > i]
                after, out[i, own] = self._advance(entry[own], table[i, own])
                entry[own] = after
            after = ready[(head[ready] == CHUNK) & (ready + 1 < lanes)] + 1
            after = after[~known[after]]
            entry[after] = entry[after - 1]
            known[after] = True
            ready = after
        return out.T.ravel()[: len(stream)]

    def _block(self, texts: list[str]) -> np.ndarray:
        joined = "\n".join(texts) + "\n"
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        breaks = np.cumsum(lengths + 1) - 1
        points, kinds = self.points(joined)
        kinds[breaks] = BREAK
        odd = np.flatnonzero(kinds == ODD)
        if len(odd):
            whole = set(np.searchsorted(breaks, odd).tolist())
            return np.array([self._whole(t) if i in whole else self._block([t])[0] for i, t in enumerate(texts)])
        starts, ends = self.bounds(points, kinds)
        if not len(starts):
            return np.zeros(len(texts), np.int64)
        raw = np.frombuffer(points.astype("<u4", copy=False).tobytes().decode("utf-32-le").encode(), np.uint8)
        sizes = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        keep = kinds != BREAK if self.spaced else (kinds != BREAK) & (kinds != SPACE)
        kept = np.cumsum(np.where(keep, sizes, 0))
        stream = raw[np.repeat(keep, sizes)].astype(np.int64)
        stream[kept[ends - 1] - 1] += 256
        total = np.append(0, np.cumsum(self.run(stream), dtype=np.int64))
        return np.diff(np.append(0, total[kept[breaks]]))

    def _whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, texts: Sequence[str | None]) -> np.ndarray:
        """Tokens of every text; null is empty."""
        result = np.zeros(len(texts), np.int64)
        pieces: list[str] = []
        owners: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.odd(text):
                result[i] += self._whole(text)
                continue
            for piece in slices(text):
                if pieces and size + len(piece) > BLOCK_CHARS:
                    np.add.at(result, owners, self._block(pieces))
                    pieces, owners, size = [], [], 0
                pieces.append(piece)
                owners.append(i)
                size += len(piece)
        if pieces:
            np.add.at(result, owners, self._block(pieces))
        return result


@lru_cache(maxsize=4)
def machine(path: str) -> Machine:
    """One machine per Python worker and tokenizer file."""
    return Machine(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """Bytes and tokens of ``docs`` (doc_id, text, any others), one row per row, without a shuffle.

    Null and empty texts have none. Rows without a doc_id and repeated rows are counted like others.
    """

    def run(batches):
        counts = machine(tokenizer)
        for batch in small_batches(batches, 1024):
            found = counts.count(batch.column(2).to_pylist())
            columns = [batch.column(0), batch.column(1), pa.array(found), pa.array(found > limit)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("text").alias("text"),
    )
    return rows.mapInArrow(run, RESULT)
