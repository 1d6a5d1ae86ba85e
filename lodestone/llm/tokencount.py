"""Token counts by a compiled finite-state transducer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, ship

SPACE = "▁"  # how the vocabulary writes a space
_NO = ""  # the last token after a reset: it joins with nothing


class Transducer:
    """A deterministic transducer whose transitions carry numbers of emitted tokens.

    Merge-based segmentation has a local form: a sequence of tokens is the
    segmentation of its text exactly if each two neighbours are that of theirs.
    So the last token of every prefix follows from the last tokens at the few
    places where the vocabulary's trie can still reach back to. That is the
    state: the longest suffix that begins a piece, and the last token and
    relative count at each place within it. A character leads to one next
    state and changes the count by a number, at times below zero, when it joins
    what was counted apart. Characters outside the vocabulary emit one token per
    UTF-8 byte and lead to the start.

    States are made when first reached and forgotten all at once beyond `most`
    transitions, so memory is bounded whatever the texts.
    """

    def __init__(self, scores: dict[str, float], most: int = 900_000):
        self.scores, self.most = scores, most
        self.prefixes = {p[:k] for p in scores for k in range(1, len(p) + 1)}
        self.letters = {p for p in scores if len(p) == 1}
        #: no piece holds a space after another character, so a space there ends everything before it
        self.resets = not any(SPACE in p.lstrip(SPACE) for p in scores)
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self.state(("", (_NO,), (0,)))
        self.fits: dict[tuple, bool] = {}
        self.reach: dict[str, tuple] = {}
        self.n_edges = 0

    def state(self, key: tuple) -> State:
        q = self.states.get(key)
        if q is None:
            q = self.states[key] = State(self, key)
        return q

    def merge(self, text: str) -> list[str]:
        """The segmentation of a short string by its definition: best-scored pair first, leftmost of equals."""
        out = list(text)
        while True:
            best, at = None, -1
            for i in range(len(out) - 1):
                s = self.scores.get(out[i] + out[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return out
            out[at : at + 2] = [out[at] + out[at + 1]]

    def joins(self, a: str, b: str) -> bool:
        """Whether tokens a, b may stand side by side; a is empty after a reset."""
        key = (a, b)
        if key not in self.fits:
            self.fits[key] = self.merge(a + b) == ([a, b] if a else [b])
        return self.fits[key]

    def suffixes(self, text: str) -> tuple:
        """Of the longest suffix that begins a piece: itself, the lengths of the tokens that end it, and the places from which a piece can go on."""
        found = self.reach.get(text)
        if found is None:
            s = text
            while s not in self.prefixes:
                s = s[1:]
            ends = [k for k in range(len(s), 0, -1) if s[-k:] in self.scores]
            live = [i for i in range(len(s)) if s[i:] in self.prefixes] + [len(s)]
            found = self.reach[text] = (s, ends, live)
        return found

    def step(self, q: State, c: str) -> tuple[State, int]:
        """Next state and change of the count."""
        self.n_edges += 1
        if c not in self.letters:
            return self.start, len(c.encode("utf-8", "surrogatepass"))
        held, last, count = q.key
        s, ends, live = self.suffixes(held + c)
        n = len(held) + 1
        for k in ends:
            t = s[-k:]
            if last[n - k] is not None and self.joins(last[n - k], t):
                break
        else:
            raise ValueError(f"no segmentation ends in {s!r}")
        now = count[n - k] + 1
        change = now - count[-1]
        off = n - len(s)  # where s begins in what was held
        new_last, new_count = [None] * (len(s) + 1), [0] * (len(s) + 1)
        for i in live[:-1]:
            new_last[i], new_count[i] = last[off + i], count[off + i] - now
        new_last[-1] = t
        if self.resets and s[0] == SPACE and new_last[0] and new_last[0][-1] != SPACE:
            new_last[0] = _NO
        return self.state((s, tuple(new_last), tuple(new_count))), change

    def run(self, q: State, text: str) -> tuple[State, int]:
        """State and count after `text` from state `q`."""
        total = 0
        for c in text:
            q, n = q[c]
            total += n
        return q, total

    def count(self, text: str) -> int:
        if self.n_edges > self.most:
            self.forget()
        return self.run(self.start, text)[1]

    def counts(self, texts: list[str]) -> dict[str, int]:
        """Counts of many strings; in their order, each goes on from what it shares with the one before."""
        if self.n_edges > self.most:
            self.forget()
        out, path, before = {}, [(self.start, 0)], ""
        for text in sorted(texts):
            k = len(commonprefix((before, text)))
            del path[k + 1 :]
            q, total = path[k]
            for c in text[k:]:
                q, n = q[c]
                total += n
                path.append((q, total))
            out[text], before = total, text
        return out


class State(dict):
    """A state with its transitions so far: character -> (state, change of the count)."""

    __slots__ = ("key", "machine")

    def __init__(self, machine: Transducer, key: tuple):
        super().__init__()
        self.machine, self.key = machine, key

    def __missing__(self, c: str) -> tuple[State, int]:
        e = self[c] = self.machine.step(self, c)
        return e


class TextMap:
    """What a stretch of text does to any entry state, as (head, inner, tail).

    `head` lies before the first place that resets the transducer, `tail` after
    the last one, and `inner` is the count between them, the same from every
    state; without such a place inner is None and head is all. Maps compose,
    and composing is associative.
    """

    __slots__ = ("head", "inner", "tail")

    def __init__(self, head: str, inner: int | None = None, tail: str = ""):
        self.head, self.inner, self.tail = head, inner, tail


class Counter(dict):
    """Counts tokens of texts: chunk maps, composed pairwise in rounds."""

    def __init__(self, machine: Transducer, most: int = 600_000, block: int = 65_536):
        super().__init__()
        self.machine, self.most, self.block = machine, most, block
        self.reset = re.compile(f"[^{SPACE}]{SPACE}").search
        self.groups = re.compile(f"{SPACE}+[^{SPACE}]*").findall

    def __missing__(self, word: str) -> int:
        """Tokens of a space and `word`, which holds no space: the map of a chunk between resets."""
        n = self[word] = self.machine.count(SPACE + word)
        return n

    def map(self, text: str) -> TextMap:
        """The map of a block, in which spaces are written as SPACE."""
        first = self.machine.resets and self.reset(text)
        if not first:
            return TextMap(text)
        at = first.start() + 1
        groups = self.groups(text[at:])
        inner = sum(self[g[1:]] if g[1:2] != SPACE else self.machine.count(g) for g in groups[:-1])
        return TextMap(text[:at], inner, groups[-1])

    def compose(self, a: TextMap, b: TextMap) -> TextMap:
        if a.inner is None:
            if b.inner is None:
                return TextMap(a.head + b.head)
            mid = self.map(a.head + b.head)  # resets may lie where the two meet
            if mid.inner is None:
                return TextMap(mid.head, b.inner, b.tail)
            return TextMap(mid.head, mid.inner + self.machine.count(mid.tail) + b.inner, b.tail)
        mid = self.map(a.tail + b.head)
        head_count = 0 if mid.inner is None else self.machine.count(mid.head) + mid.inner
        open_ = mid.head if mid.inner is None else mid.tail
        if b.inner is None:
            return TextMap(a.head, a.inner + head_count, open_)
        return TextMap(a.head, a.inner + head_count + self.machine.count(open_) + b.inner, b.tail)

    def learn(self, texts: list[str]) -> None:
        """Count the words of a batch that aren't known yet, all in one walk."""
        if len(self) > self.most:
            self.clear()
        new = {w for t in texts if len(t) <= self.block for w in t.split(" ") if w not in self and SPACE not in w}
        if self.machine.resets:
            self.update((w[1:], n) for w, n in self.machine.counts([SPACE + w for w in new]).items())

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        t = SPACE + text.replace(" ", SPACE)
        if len(t) <= self.block and self.machine.resets and SPACE + SPACE not in t:
            return sum(map(self.__getitem__, t[1:].split(SPACE)))
        maps = [self.map(t[i : i + self.block]) for i in range(0, len(t), self.block)]
        while len(maps) > 1:  # each round halves them; the rounds of a prefix scan that the total needs
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        m = maps[0]
        return self.machine.count(m.head) + (0 if m.inner is None else m.inner + self.machine.count(m.tail))


_compiled: dict[str, Counter] = {}


def compile_pieces(path: str) -> Transducer:
    """The transducer of a merge-based piece vocabulary with byte fallback."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    special = lambda i: p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)
    return Transducer({p.id_to_piece(i): p.get_score(i) for i in range(p.get_piece_size()) if not special(i)})


def forget_counters() -> None:
    _compiled.clear()


def counter(path: str) -> Counter:
    """One per Python worker, so that later tasks start with the states that earlier ones made."""
    if path not in _compiled:
        _compiled[path] = Counter(compile_pieces(path))
    return _compiled[path]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Tokens of every whole text, counted by the transducer compiled from the vocabulary at `model_path`.

    Returns `id_col`, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > `limit`).
    A null or empty text has no bytes and no tokens; texts of any length are
    counted whole, in blocks whose maps compose; repeated rows are counted each;
    an empty table gives an empty result; null ids stay; other columns are
    ignored. No shuffle.
    """
    ship(docs)
    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    kind = d.schema["_id"].dataType.simpleString()
    d = d.select("_id", F.octet_length("_t").cast("long").alias("n_bytes"), "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tokencount", forget_counters)
        count = counter(model_path)
        for b in batches:
            texts = b.column(2).to_pylist()
            for i in range(0, len(texts), 1000):
                count.learn(texts[i : i + 1000])
            counts = pa.array(map(count, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), counts], ["_id", "n_bytes", "n_tokens"])

    d = d.mapInArrow(run, f"_id {kind}, n_bytes long, n_tokens long")
    return d.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
