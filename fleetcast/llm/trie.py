"""Compact n-gram tries: monotone sequences in Elias-Fano form, side by side in one buffer that is read where it lies.

A trie has words on its first level and, below each word, the words that precede it. Pointers from the first level to the second are
one monotone sequence; so are the children, since the ids of a word's children are stored on top of the last value of the word before
it. A child is found relative to its word: the word's start value plus the child's id is looked up by successor search, and counts
only if the place is between the word's pointers. Probabilities are one byte each, a place in a codebook of bin means.
"""

from __future__ import annotations

import mmap

import numpy as np

U64 = np.uint64
BINS = 256


def _bits(words: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``words`` 64-bit words with ``values`` set from the bit places ``at`` on; places do not overlap."""
    out = np.zeros(words, U64)
    word, shift = at >> 6, (at & 63).astype(U64)
    np.bitwise_or.at(out, word, values << shift)
    over = (shift > 0) & (values >> np.where(shift > 0, U64(64) - shift, U64(63)) > 0)
    np.bitwise_or.at(out, word[over] + 1, values[over] >> (U64(64) - shift[over]))
    return out


class EliasFano:
    """A monotone sequence of unsigned integers. ``EliasFano(buffer)`` reads what ``encode`` wrote without copying it."""

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, U64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = values & U64((1 << width) - 1)
        lows = _bits(n * width // 64 + 2, np.arange(n, dtype=np.int64) * width, low) if width else np.zeros(1, U64)
        places = (values >> U64(width)).astype(np.int64) + np.arange(n)
        size = (int(places[-1]) if n else 0) // 64 + 2
        highs = _bits(size, places, np.ones(n, U64))
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(highs))]).astype(np.int64)
        return np.array([n, width, len(lows), len(highs)], np.int64).tobytes() + lows.tobytes() + highs.tobytes() + ranks.tobytes()

    def __init__(self, buffer: memoryview | bytes):
        self.n, self.width, lows, highs = (int(x) for x in np.frombuffer(buffer, np.int64, 4))
        self.low = np.frombuffer(buffer, U64, lows, 32)
        self.high = np.frombuffer(buffer, U64, highs, 32 + 8 * lows)
        self.ones = np.frombuffer(buffer, np.int64, highs + 1, 32 + 8 * (lows + highs))
        self.zeros = np.arange(highs + 1, dtype=np.int64) * 64 - self.ones

    def __len__(self) -> int:
        return self.n

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(U64)
        out = self.low[word] >> shift
        wraps = shift > U64(64 - self.width)
        out[wraps] |= self.low[word[wraps] + 1] << (U64(64) - shift[wraps])
        return out & U64((1 << self.width) - 1)

    @staticmethod
    def _select(directory: np.ndarray, words: np.ndarray, flip: bool, k: np.ndarray) -> np.ndarray:
        """Bit place of the ``k``-th one (or zero, if ``flip``), from the counts before each word."""
        word = np.searchsorted(directory, k, "right") - 1
        rest = (k - directory[word]).astype(np.int64)
        bits = words[np.minimum(word, len(words) - 1)]
        bits = ~bits if flip else bits
        at = np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count(bits & U64((1 << half) - 1)).astype(np.int64)
            go = rest >= here
            rest -= np.where(go, here, 0)
            at += np.where(go, half, 0)
            bits = np.where(go, bits >> U64(half), bits)
        return word * 64 + at

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = self._select(self.ones, self.high, False, i) - i
        return (high.astype(U64) << U64(self.width)) | self._lows(i)

    def all(self) -> np.ndarray:
        return self.get(np.arange(self.n))

    def _seek(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(place, end, low)``: the first value of the bucket of ``x`` that is ``x`` or more, the bucket's end, and the low bits of ``x``."""
        bucket = np.minimum(x >> U64(self.width), U64(int(self.zeros[-1]))).astype(np.int64)
        # values of a bucket stand between the zeros before and after it
        start = np.where(bucket > 0, self._select(self.zeros, self.high, True, np.maximum(bucket - 1, 0)) - bucket + 1, 0)
        place = np.minimum(start, self.n)
        end = np.minimum(self._select(self.zeros, self.high, True, np.minimum(bucket, self.zeros[-1] - 1)) - bucket, self.n)
        low = x & U64((1 << self.width) - 1)
        upto = end.copy()  # by halves, as a bucket can hold many children of one word
        todo = np.flatnonzero(place < upto)
        while len(todo):
            middle = (place[todo] + upto[todo]) >> 1
            right = self._lows(middle) < low[todo]
            place[todo[right]] = middle[right] + 1
            upto[todo[~right]] = middle[~right]
            todo = todo[place[todo] < upto[todo]]
        return place, end, low

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value that is ``x`` or more; ``len(self)`` if there is none."""
        return self._seek(np.asarray(x, U64))[0]

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place, whether the value there is x)``."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        place, end, low = self._seek(np.asarray(x, U64))
        there = place < end  # a value of the same bucket: its low bits decide
        place = np.minimum(place, self.n - 1)
        there[there] = self._lows(place[there]) == low[there]
        return place, there


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(codes, codebook)``: equally filled bins and their means; exact where there are no more different values than bins."""
    different = np.unique(values)
    if len(different) <= BINS:
        return np.searchsorted(different, values).astype(np.uint8), np.resize(different if len(different) else np.zeros(1), BINS).astype(np.float64)
    ordered = np.sort(values)
    edges = np.unique(ordered[np.arange(1, BINS) * len(ordered) // BINS])
    codes = np.searchsorted(edges, values, "right")
    sums, held = np.bincount(codes, values, BINS), np.bincount(codes, minlength=BINS)
    return codes.astype(np.uint8), sums / np.maximum(held, 1)


def pack(sections: list[bytes]) -> bytes:
    """Sections in one buffer, each from a multiple of eight bytes on, after a list of their places."""
    padded = [s + b"\0" * (-len(s) % 8) for s in sections]
    ends = np.cumsum([0, *map(len, padded)]) + 8 * (len(sections) + 2)
    return np.array([len(sections), *ends], np.int64).tobytes() + b"".join(padded)


def sections(buffer: memoryview | bytes) -> list[memoryview]:
    view = memoryview(buffer)
    n = int(np.frombuffer(view, np.int64, 1)[0])
    ends = np.frombuffer(view, np.int64, n + 1, 8)
    return [view[a:b] for a, b in zip(ends[:-1], ends[1:])]


class Trie:
    """Levels of a trie in a buffer: words, sums of their counts, pointers, contexts, children, and bytes of probabilities or sums of counts."""

    def __init__(self, buffer: memoryview | bytes):
        self.parts = sections(buffer)
        self.words, self.counts, self.pointers, self.contexts, self.children = (EliasFano(p) for p in self.parts[:5])
        self.codebook = np.frombuffer(self.parts[5], np.float64, BINS) if len(self.parts) == 7 else None
        self.codes = np.frombuffer(self.parts[6], np.uint8) if len(self.parts) == 7 else None

    @staticmethod
    def mapped(path: str) -> Trie:
        """A trie in a file, which is mapped into memory and read page by page."""
        with open(path, "rb") as file:
            return Trie(memoryview(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)))

    @staticmethod
    def counted(word: np.ndarray, context: np.ndarray, count: np.ndarray) -> bytes:
        """A trie with counts, of distinct pairs in the order of words and contexts."""
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        pointers = np.concatenate([first, [len(word)]])
        sums = np.concatenate([[0], np.cumsum(count)])
        contexts = np.unique(context)
        ids = np.searchsorted(contexts, context).astype(U64)
        last = ids[pointers[1:] - 1] + U64(1) if len(word) else np.zeros(0, U64)
        base = np.concatenate([[0], np.cumsum(last)[:-1]]).astype(U64) if len(word) else np.zeros(0, U64)
        children = ids + np.repeat(base, np.diff(pointers))
        return pack([EliasFano.encode(x) for x in (word[first], sums[pointers], pointers, contexts, children, sums)])

    def weighed(self, logs: np.ndarray) -> bytes:
        """The same trie with one byte for each child's ``logs`` in place of the counts."""
        codes, codebook = quantised(logs)
        return pack([*map(bytes, self.parts[:5]), codebook.astype(np.float64).tobytes(), codes.tobytes()])

    def child_counts(self) -> np.ndarray:
        sums = EliasFano(self.parts[5]).all().astype(np.int64)
        return np.diff(sums)

    def word_counts(self, place: np.ndarray) -> np.ndarray:
        return (self.counts.get(place + 1) - self.counts.get(place)).astype(np.int64) if len(place) else np.zeros(0, np.int64)

    def find_children(self, word: np.ndarray, known: np.ndarray, owner: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place, found)`` of each context below its word: ``word`` are places of words, as far as ``known``, ``owner`` names the word of a context."""
        low, high = self.pointers.get(word).astype(np.int64), self.pointers.get(word + 1).astype(np.int64)
        start = np.where(low > 0, self.children.get(np.maximum(low - 1, 0)) + U64(1), U64(0))
        place, found = np.zeros(len(context), np.int64), known[owner]
        asked = np.flatnonzero(found)
        ids, met = self.contexts.find(context[asked])
        found[asked] = met
        asked, ids = asked[met], ids[met]
        of = owner[asked]
        place[asked], there = self.children.find(start[of] + ids.astype(U64))
        found[asked] = there & (place[asked] >= low[of]) & (place[asked] < high[of])
        return place, found
