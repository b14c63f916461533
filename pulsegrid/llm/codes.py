"""Token ids of whole texts by the ``tokenizers`` library, each distinct word encoded once.

A text is cut into the library's own pre-tokens with array operations over whole blocks of text, the
words of a block are looked up at once in a table kept by the Python worker, and only new words go
through the library. Character classes and case folding are asked of the tokenizer itself, one code
point at a time. Texts the cut does not cover (special strings, text that normalising would recompose)
go through the library as they are.
"""

from __future__ import annotations

import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

# Pre-token patterns of the two public tokenizer files this module can cut.
SPACED_PATTERN = "ByteLevel"
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

SPACE, LETTER, DIGIT, OTHER, BREAK, ODD = range(6)
UNSEEN = 255
BLOCK_CHARS = 1 << 18
LONG_WORD = 32
TABLE_WORDS = 1_000_000
FACTOR = 0x9E3779B97F4A7C15


def byte_chars() -> dict[int, int]:
    """Printable stand-ins of byte-level vocabularies: visible Latin-1 as it is, the rest from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


BYTE_CHARS = byte_chars()


def slices(text: str, limit: int = BLOCK_CHARS) -> Iterator[str]:
    """Cut a long text where a space follows a non-space; no pre-token crosses such a place."""
    place = re.compile(r"(?<=\S)\s")
    at = 0
    while len(text) - at > limit:
        found = place.search(text, at + limit)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def small_batches(batches, rows: int = 256):
    """Arrow batches of few rows, so that what is made of long texts is never held for many at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Cutter:
    """Classes of code points and pre-token bounds of one tokenizer."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.model = spec["model"]
        pre = spec["pre_tokenizer"]
        parts = pre.get("pretokenizers", [pre])
        self.spaced = parts[0]["type"] == SPACED_PATTERN
        if not self.spaced and parts[0].get("pattern", {}).get("Regex") != PLAIN_PATTERN:
            raise ValueError(f"{path}: unknown pre-token pattern")
        self.folds = spec["normalizer"] is not None
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.kind = np.full(0x110000, UNSEEN, np.uint8)
        self.fold = np.arange(0x110000, dtype=np.uint32)

    def _learn(self, points: np.ndarray) -> None:
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for point in points.tolist():
            char = chr(point)
            if self.folds:
                low = self.tokenizer.normalizer.normalize_str(char)
                if len(low) != 1:
                    self.kind[point] = ODD
                    continue
                self.fold[point] = ord(low)
                char = low
            if not self.spaced and not cut(char):
                self.kind[point] = SPACE
            elif len(cut("a" + char)) == 1:
                self.kind[point] = LETTER
            elif len(cut("!" + char)) == 1:
                self.kind[point] = OTHER
            elif not self.spaced or len(cut("1" + char)) == 1:
                self.kind[point] = DIGIT
            else:
                self.kind[point] = SPACE

    def odd(self, text: str) -> bool:
        """True if the text must go through the library as a whole."""
        if any(s in text for s in self.specials):
            return True
        return self.folds and not text.isascii() and not unicodedata.is_normalized("NFC", text)

    def points(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Folded code points and classes."""
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kind[points]
        if (kinds == UNSEEN).any():
            self._learn(np.unique(points[kinds == UNSEEN]))
            kinds = self.kind[points]
        return (self.fold[points] if self.folds else points), kinds

    def bounds(self, points: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-end position of each pre-token. ``kinds`` ends with BREAK."""
        size = len(kinds)
        first = np.empty(size, bool)
        first[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=first[1:])
        start = first.copy()
        quote = first & (points == 39) & (kinds == OTHER)
        if self.spaced:
            text = (kinds != SPACE) & (kinds != BREAK)
            before = np.flatnonzero((kinds[:-1] == SPACE) & text[1:])
            start[before] = True
            joins = before[points[before] == 32] + 1
            start[joins] = False
            quote[joins] = False
        else:
            start |= kinds == DIGIT
        marks = np.flatnonzero(quote)
        marks = marks[kinds[np.minimum(marks + 1, size - 1)] == LETTER]
        if len(marks):
            second = points[marks + 1]
            third = points[np.minimum(marks + 2, size - 1)]
            one = np.isin(second, [ord(c) for c in "stmd"])
            two = (third == ord("e")) & ((second == ord("r")) | (second == ord("v")))
            two |= (second == ord("l")) & (third == ord("l"))
            # the third character counts only inside the same run of letters
            two &= kinds[np.minimum(marks + 2, size - 1)] == LETTER
            for hit, length in ((one, 2), (two & ~one, 3)):
                at = marks[hit]
                start[at + 1] = False
                after = at + length
                start[after[kinds[after] == LETTER]] = True
        at = np.flatnonzero(start)
        ends = np.append(at[1:], size)
        keep = kinds[at] != BREAK
        if not self.spaced:
            keep &= kinds[at] != SPACE
        return at[keep], ends[keep]


class Places:
    """Open-addressed table from 64-bit keys to small numbers, asked and filled by whole arrays."""

    def __init__(self, bits: int = 16):
        self._keys = np.empty(1 << bits, np.uint64)
        self._values = np.full(1 << bits, -1, np.int32)
        self._bits, self._used = bits, 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(FACTOR)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of every key; -1 if it has none."""
        slots = self._slots(keys)
        found = self._values[slots]
        todo = np.flatnonzero((found >= 0) & (self._keys[slots] != keys))
        while len(todo):  # another key is there: look at the next slot
            slots[todo] = (slots[todo] + 1) & (len(self._keys) - 1)
            at = slots[todo]
            found[todo] = self._values[at]
            todo = todo[(found[todo] >= 0) & (self._keys[at] != keys[todo])]
        return found

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add different keys that are not in the table."""
        if 2 * (self._used + len(keys)) > len(self._keys):
            full = np.flatnonzero(self._values >= 0)
            keys = np.concatenate([self._keys[full], keys])
            values = np.concatenate([self._values[full], values])
            self.__init__((4 * len(keys)).bit_length())
        self._used += len(keys)
        slots, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            at = slots[todo]
            free = self._values[at] < 0
            # of several keys for one free slot the last stays, in both arrays
            self._keys[at[free]] = keys[todo[free]]
            self._values[at[free]] = values[todo[free]]
            todo = todo[self._keys[at] != keys[todo]]
            slots[todo] = (slots[todo] + 1) & (len(self._keys) - 1)


class Encoder(Cutter):
    """Ids of whole texts, without added special tokens, exactly as the library gives them."""

    def __init__(self, path: str):
        super().__init__(path)
        del self.model  # the library has its own
        self._powers = np.ones(1, np.uint64)
        self._inverse = np.ones(1, np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.places = Places()
        self.long: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.used = self.words = 0
        self.at = np.empty(1 << 14, np.int64)
        self.count = np.empty(1 << 14, np.int64)

    def _raise(self, size: int) -> None:
        if len(self._powers) < size:
            back = pow(FACTOR, -1, 1 << 64)
            for name, factor in (("_powers", FACTOR), ("_inverse", back)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def _add(self, words: list[str]) -> np.ndarray:
        """Places of new words, which are folded pre-tokens: only the library's BPE model is left to run."""
        tokenize = self.tokenizer.model.tokenize
        # byte 255 is in no UTF-8 text
        shown = b"\xff".join([w.encode() for w in words]).decode("latin-1").translate(BYTE_CHARS)
        ids, ends = [], []
        for word in shown.split(chr(BYTE_CHARS[255])):
            ids += [t.id for t in tokenize(word)]
            ends.append(len(ids))
        first, last, size = self.words, self.words + len(words), self.used + len(ids)
        while last > len(self.at):
            self.at = np.resize(self.at, 2 * len(self.at))
            self.count = np.resize(self.count, 2 * len(self.count))
        while size > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : size] = ids
        bounds = np.append(0, ends)
        self.at[first:last], self.count[first:last] = self.used + bounds[:-1], np.diff(bounds)
        self.used, self.words = size, last
        return np.arange(first, last, dtype=np.int32)

    def _block(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\n".join(texts) + "\n"
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        breaks = np.cumsum(lengths + 1) - 1
        points, kinds = self.points(joined)
        kinds[breaks] = BREAK
        owner_odd = np.flatnonzero(kinds == ODD)
        if len(owner_odd):
            whole = np.unique(np.searchsorted(breaks, owner_odd))
            return self._mixed(texts, set(whole.tolist()))
        starts, ends = self.bounds(points, kinds)
        self._raise(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self._powers[: len(points)], out=sums[1:])
        keys = (sums[ends] - sums[starts]) * self._inverse[starts]
        long = np.flatnonzero(ends - starts > LONG_WORD)
        joined = points.astype("<u4", copy=False).tobytes().decode("utf-32-le")
        names = {joined[starts[i] : ends[i]] for i in long.tolist()}
        if self.words > TABLE_WORDS:
            self._clear()
        places = self.places.get(keys)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            unique, first = np.unique(keys[missing], return_index=True)
            self.places.put(unique, self._add([joined[starts[i] : ends[i]] for i in missing[first].tolist()]))
            places[missing] = self.places.get(keys[missing])
        fresh = [w for w in names if w not in self.long]
        if fresh:
            self.long.update(zip(fresh, self._add(fresh).tolist(), strict=True))
        if len(long):
            places[long] = [self.long[joined[starts[i] : ends[i]]] for i in long.tolist()]
        counts = self.count[places]
        total = np.cumsum(counts)
        size = int(total[-1]) if len(total) else 0
        index = np.arange(size) + np.repeat(self.at[places] - (total - counts), counts)
        per_text = np.searchsorted(starts, breaks)
        bounds = np.append(0, np.append(0, total)[per_text])
        return self.flat[index], bounds

    def _mixed(self, texts: Sequence[str], whole: set[int]) -> tuple[np.ndarray, np.ndarray]:
        parts, bounds = [], [0]
        for i, text in enumerate(texts):
            if i in whole:
                ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
            else:
                ids = self._block([text])[0]
            parts.append(ids)
            bounds.append(bounds[-1] + len(ids))
        return np.concatenate(parts), np.array(bounds)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and bounds: text ``i`` has ``ids[bounds[i]:bounds[i + 1]]``; null is empty."""
        pieces: list[str] = []
        owners: list[int] = []
        results: list[tuple[np.ndarray, np.ndarray]] = []
        counts = np.zeros(len(texts), np.int64)
        size = 0

        def flush() -> None:
            nonlocal size
            if pieces:
                ids, bounds = self._block(pieces)
                results.append(ids)
                np.add.at(counts, owners, np.diff(bounds))
            pieces.clear()
            owners.clear()
            size = 0

        for i, text in enumerate(texts):
            if not text:
                continue
            if self.odd(text):
                flush()
                ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
                results.append(ids)
                counts[i] += len(ids)
                continue
            for piece in slices(text):
                if size + len(piece) > BLOCK_CHARS:
                    flush()
                pieces.append(piece)
                owners.append(i)
                size += len(piece)
        flush()
        flat = np.concatenate(results) if results else np.empty(0, np.int32)
        return flat, np.append(0, np.cumsum(counts))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and tokenizer file."""
    return Encoder(path)
