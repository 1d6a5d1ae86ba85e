"""The rules of line dedup in Python, a few documents at a time: what the DataFrame form in `linededup` is held against.

Queries don't run this. Hashes are those of Spark's `xxhash64`, so both forms have
the same lines, chunks and keys.
"""

from __future__ import annotations

from functools import cached_property, lru_cache

import numpy as np

#: A line ends with a gap that holds a line feed or follows the end of a sentence, and, since passages are
#: also set into running lines, one after some last letters: about each fifth word. The gap is the line's.
LAST = ".!?dhlm"
GAPS = " \t\n\r\x0b\x0c"
LONG = 80  # bytes from which a line is cut at words by their hash, whatever their last letter
EVERY = 2  # words between such cuts, on average
SEED = 42
_is_blank, _is_last = np.zeros(256, bool), np.zeros(256, bool)
_is_blank[list(GAPS.encode())] = _is_last[list(LAST.encode())] = True
_ALL = 2**64 - 1
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _turn(x: int, n: int) -> int:
    x &= _ALL
    return (x << n | x >> 64 - n) & _ALL


@lru_cache(1 << 18)
def xxhash64(data: bytes, seed: int = SEED) -> int:
    """Spark's hash of a string, unsigned; that of a long is the hash of its 8 bytes, and a seed is the hash of what stands before."""
    at, n, mixed = 0, len(data), lambda k: _turn(k * _P2, 31) * _P1
    word = lambda i, k=8: int.from_bytes(data[i : i + k], "little")
    h = seed + _P5
    if n >= 32:
        v = [seed + _P1 + _P2, seed + _P2, seed, seed - _P1]
        while at <= n - 32:
            v = [_turn(x + word(at + 8 * i) * _P2, 31) * _P1 & _ALL for i, x in enumerate(v)]
            at += 32
        h = sum(_turn(x, k) for x, k in zip(v, (1, 7, 12, 18), strict=True))
        for x in v:
            h = ((h ^ mixed(x)) & _ALL) * _P1 + _P4
    h += n
    while at <= n - 8:
        h = _turn(h ^ mixed(word(at)), 27) * _P1 + _P4
        at += 8
    if at <= n - 4:
        h = _turn(h ^ word(at, 4) * _P1, 23) * _P2 + _P3
        at += 4
    for b in data[at:]:
        h = _turn(h ^ b * _P5, 11) * _P1
    h &= _ALL
    h = (h ^ h >> 33) * _P2 & _ALL
    h = (h ^ h >> 29) * _P3 & _ALL
    return h ^ h >> 32


def hashed(*values: int) -> int:
    """Spark's hash of longs, one after the other."""
    h = SEED
    for x in values:
        h = xxhash64((int(x) & _ALL).to_bytes(8, "little"), h)
    return h


class Lines:
    """The lines of some documents, given as UTF-8.

    `data` holds the documents with a line feed after each, `base` where each
    starts. Of all lines, in order: `start` (of the first word; the blanks before a
    document's first line and after each line belong to it), `end` of the last
    word, `fed`, whether a line feed follows, and `hash` of the bytes from start
    to end; `first` has the first line of each document and the number of lines.
    """

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        x = np.frombuffer(self.data, np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.base = np.r_[0, np.cumsum(size + 1)[:-1]]
        word = ~_is_blank[x]
        edge = np.flatnonzero(np.diff(np.r_[False, word, False]))
        ws, we = edge[::2], edge[1::2]  # words
        fed = np.add.reduceat(np.r_[x == 10, False].astype(np.int32), np.r_[we, len(x)])[:-1] > 0 if len(we) else np.zeros(0, bool)
        ends = fed | _is_last[x[we - 1]]  # the line feed after a document ends its last line
        first, last = self._lines(ends)
        long_ = np.flatnonzero(we[last] - ws[first] > LONG)
        if len(long_):
            inside = np.zeros(len(ws) + 1, np.int64)
            np.add.at(inside, first[long_], 1)
            np.add.at(inside, last[long_] + 1, -1)
            w = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
            ends[w] |= np.array([xxhash64(self.data[a:z]) % EVERY == 0 for a, z in zip(ws[w].tolist(), we[w].tolist(), strict=True)], bool)
            first, last = self._lines(ends)
        self.start, self.end, self.fed = ws[first], we[last], fed[last]
        self.first = np.searchsorted(self.start, np.r_[self.base, len(x)])

    @cached_property
    def hash(self) -> np.ndarray:
        return np.array([xxhash64(x) for x in self.plain(0, len(self.start))], np.uint64)

    @staticmethod
    def _lines(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last word of each line."""
        last = np.flatnonzero(ends)
        return np.r_[0, last[:-1] + 1] if len(last) else last, last

    def span(self, doc: int) -> slice:
        return slice(self.first[doc], self.first[doc + 1])

    def plain(self, i: int, j: int) -> list[bytes]:
        """Lines i to j without what separates them."""
        d = self.data
        return [d[a:b] for a, b in zip(self.start[i:j].tolist(), self.end[i:j].tolist(), strict=True)]


def lines(text: str | None) -> list[str]:
    """The lines of a text; joined, they are the text, but for one without words, which has none."""
    t = (text or "").encode("utf-8", "surrogatepass")
    cuts = [0, *Lines([t]).start[1:].tolist(), len(t)]
    return [t[a:b].decode("utf-8", "surrogatepass") for a, b in zip(cuts, cuts[1:], strict=False)] if t.strip(GAPS.encode()) else []


class Chunks:
    """Chunks of the lines of some documents: `start` and `end` among all lines, `doc`, `k` within it, `hash`; `several` tells which have two lines or more.

    A chunk starts where the rolling hash of two lines on end falls, and where a
    paragraph starts, if it is not a line away from the next. A boundary depends on
    three lines at most, so chunks inside a repeated passage are alike whatever
    stands around it; of n values on end, all but 1 / n! of cases have a fall.
    """

    def __init__(self, h: np.ndarray, fed: np.ndarray, sizes: np.ndarray):
        n, first = len(h), np.r_[0, np.cumsum(sizes)[:-1]][sizes > 0]
        heads = set(first.tolist())
        rolled = np.array([hashed(x) if i in heads else hashed(h[i - 1], x) for i, x in enumerate(h)], np.uint64).view(np.int64)
        begins = np.zeros(n, bool)
        if n:
            begins[1:] = (rolled[1:] < rolled[:-1]) | (fed[:-1] & ~fed[1:])
            begins[first] = True
        self.start = np.flatnonzero(begins)
        self.end = np.r_[self.start[1:], n] if n else self.start
        self.several = self.end - self.start > 1
        self.doc = np.repeat(np.arange(len(sizes)), sizes)[self.start] if n else self.start
        self.k = np.arange(len(self.start)) - np.searchsorted(self.start, np.r_[0, np.cumsum(sizes)[:-1]])[self.doc] if n else self.start
        self.hash = np.array([hashed(*h[a:b]) for a, b in zip(self.start, self.end, strict=True)], np.uint64)


_WANT = np.dtype([("k", "<u4"), ("salts", "<u4"), ("first", "u1")])


class Sides:
    """What is compared of documents with lines `x`, of which doc[i] wants the chunk k[i]: each of these, and at the ends of a run of them the lines beside it.

    Side 0 is the chunk itself, under its hash, from line `at` on. Sides -1 and 1 are
    the lines before it and after it, away from line `at`, under a hash of the
    chunk and the nearest line, so that only passages that go on alike are
    compared. They reach over the next chunk of several lines, and before the
    chunk one line more: no passage that begins or ends there goes further, as
    boundaries from its third line on are its own. Lines `low` to `high` (of all) are
    compared; `at` counts from the document's first.
    """

    def __init__(self, x: Lines, doc: np.ndarray, want: np.ndarray):
        sizes = np.diff(x.first)
        c = Chunks(x.hash, x.fed, sizes)
        n = len(c.start)
        begin = np.searchsorted(c.start, x.first[:-1])
        at = begin[doc] + want["k"]  # among all chunks
        wanted = np.zeros(n + 2, bool)
        wanted[at + 1] = True
        index = np.arange(n)
        back = np.maximum.accumulate(np.where(c.several, index, -1)) if n else index
        ahead = np.minimum.accumulate(np.where(c.several, index, n)[::-1])[::-1] if n else index
        lo, hi = x.first[doc], x.first[doc + 1]
        s, e = c.start[at], c.end[at]
        # before
        i = np.flatnonzero((s > lo) & ~wanted[at])
        near = back[at[i] - 1]
        low = np.where(near >= begin[doc[i]], np.maximum(c.start[np.maximum(near, 0)] - 1, lo[i]), lo[i])
        # after
        j = np.flatnonzero((e < hi) & ~wanted[at + 2])
        near = ahead[at[j] + 1]
        ends = np.r_[c.end, 0][np.minimum(near, n)]
        high = np.where((near < n) & (ends <= hi[j]), ends, hi[j])
        code = c.hash[at]
        left = np.array([hashed(ch, y, -1) for ch, y in zip(code[i], x.hash[s[i] - 1], strict=True)], np.uint64)
        right = np.array([hashed(ch, y, 1) for ch, y in zip(code[j], x.hash[e[j]], strict=True)], np.uint64)
        join = lambda *parts: np.concatenate(parts)
        self.row = join(np.arange(len(at)), i, j)  # which of the wanted chunks
        self.key = join(code, left, right)
        self.side = join(np.zeros(len(at), np.int64), np.full(len(i), -1), np.full(len(j), 1))
        self.low, self.high = join(s, low, e[j]), join(e, s[i], high)
        self.at = join(s - lo, s[i] - lo[i], e[j] - lo[j])


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Spans, each a number a * 2 ** 32 + b, in order and joined where they meet."""
    spans = np.sort(spans)
    a, b = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    begins = np.r_[True, a[1:] > b[:-1]]
    return list(zip(a[begins].tolist(), b[np.r_[begins[1:], True]].tolist(), strict=True))


def without(x: Lines, doc: int, cuts: list[tuple[int, int]], min_words: int) -> tuple[str, int]:
    """A document without the spans (`merged`) of its lines that have `min_words` words or more, and how many words went."""
    mine = x.span(doc)
    lo, end = int(x.base[doc]), int(x.base[doc + 1]) - 1 if doc + 1 < len(x.base) else len(x.data) - 1
    starts = [lo, *x.start[mine][1:].tolist(), end]
    kept, upto, gone = [], 0, 0
    for a, b in cuts:
        n = len(x.data[starts[a] : starts[b]].split())
        if n >= min_words:
            kept.append(x.data[starts[upto] : starts[a]])
            upto, gone = b, gone + n
    return (b"".join(kept) + x.data[starts[upto] : end]).decode("utf-8", "surrogatepass"), gone
