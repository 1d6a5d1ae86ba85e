"""Packing tokenised documents into sequences by the sum-of-squares rule."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress
from operator import not_
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _gap_split, _odd_gap, claim, ship

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: A full stop or comma beside other punctuation, with which it would form one piece.
_bound = re.compile(r"[.,](?:(?=[^\w\s]|_)|(?<=[^\w\s].)|(?<=_.))").search
#: Words the tokenizer neither normalises nor splits: lower-case Latin-1 letters.
_plain = re.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch
#: Such letters and then ASCII punctuation, which forms a piece of its own; without "'" (contractions) and "<" (special tokens).
_ended = re.compile(r"([a-z\xdf-\xf6\xf8-\xff]+)([!-&(-/:;=-@\[-`{-~]+)").fullmatch
_known: dict[str, WordIds] = {}


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet for the characters beyond ASCII of Latin-1: printable bytes stand for themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = dict(zip(own, own, strict=True)) | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in own)}
    return {c: "".join(chr(letter[b]) for b in chr(c).encode()) for c in range(128, 256)}


class WordIds:
    """Token ids of whole texts, as bytes, through a bounded memo of white-space-free strings.

    The tokenizer drops white space and none of its pieces reaches across it,
    so a text's ids are those of its gap-separated strings in turn. Nor does a
    piece join letters or digits to punctuation: full stops and commas that only
    touch those are strings of their own, and ASCII is lower-cased at once, as
    the tokenizer would, so that fewer strings are new. Texts with "<|" keep
    their case, since special tokens are matched before it is folded.

    Words of plain letters go to the tokenizer's own model without the steps
    before it, which leave them as they are, many at a time with a mark between,
    also those before signs, which are pieces of their own;
    so they do only where the file has the steps known to do so (`plain`).

    The memo has two halves of about `most` strings: what is still in use comes over from
    the older one, so that a full memo does not cost the frequent words.
    """

    def __init__(self, path: str, most: int = 125_000, mark: str = "|"):
        from tokenizers import Tokenizer

        self.tok, self.memo, self.before, self.most, self.mark = Tokenizer.from_file(path), {}, {}, most, mark
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        spec |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.model, self.letters = Tokenizer.from_str(json.dumps(spec)), _byte_letters()
        ids = self.model.encode(mark, add_special_tokens=False).ids
        self.plain, self.mark_id = self.plain and len(ids) == 1, ids[0] if ids else -1
        # ids below 2 ** 16 end with two zero bytes, so that a mark without zeros before these is found at whole ids only
        whole = self.mark_id & 0xFF and self.mark_id >> 8 and self.tok.get_vocab_size() <= 1 << 16
        self.split_at = struct.pack("<I", self.mark_id) if self.plain and whole else b""

    @staticmethod
    def split(t: str) -> list[str]:
        if "<|" not in t:
            if t.isascii():
                t, steady = t.lower(), True
            else:  # a letter may become a letter and a mark, which forms one piece with punctuation
                steady = "\u0130" not in t and is_normalized("NFC", t)
            if steady and not _bound(t):
                t = t.replace(".", " . ").replace(",", " , ")
        return t.split() if not _odd_gap(t) else [w for w in _gap_split(t) if w]

    def learn(self, new: list[str], group: int = 32) -> None:
        """Put the ids of new strings into the memo."""
        memo, rest, ended = self.memo, new, []
        if self.plain and new:
            lows, easy, rest = "\n".join(new).lower().split("\n"), {}, {}  # no string holds a line feed
            for w, low in zip(new, lows, strict=True):
                if _plain(low):
                    easy[w] = low
                elif m := _ended(low):
                    ended.append((w, *m.groups()))
                else:
                    rest[w] = None
            for _, letters, signs in ended:
                if letters not in memo:
                    easy[letters] = letters
                if signs not in memo:
                    rest[signs] = None
            rest, names = list(rest), list(easy)
            spelt = [x if x.isascii() else x.translate(self.letters) for x in easy.values()]
            texts = [f" {self.mark} ".join(spelt[i : i + group]) for i in range(0, len(spelt), group)]
            for at, e in enumerate(self.model.encode_batch_fast(texts, add_special_tokens=False)):
                memo.update(zip(names[at * group : (at + 1) * group], self.cut(e.ids), strict=True))
        for lo in range(0, len(rest), 8192):
            some = rest[lo : lo + 8192]
            for w, e in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False), strict=True):
                memo[w] = array("I", e.ids).tobytes()
        for w, letters, signs in ended:
            memo[w] = memo[letters] + memo[signs]

    def cut(self, ids: list[int]) -> list[bytes]:
        """The ids between marks, as bytes."""
        if self.split_at:
            return array("I", ids).tobytes().split(self.split_at)
        out, ids, lo = [], array("I", ids), 0
        for _ in range(ids.count(self.mark_id)):
            hi = ids.index(self.mark_id, lo)
            out.append(ids[lo:hi].tobytes())
            lo = hi + 1
        return [*out, ids[lo:].tobytes()]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > self.most:
            self.memo, self.before = {}, self.memo
        memo, before = self.memo, self.before
        parts = [self.split(t) for t in texts]
        found = [list(map(memo.get, p)) for p in parts]
        gaps = [list(compress(range(len(f)), map(not_, f))) for f in found]
        new = {p[i] for p, g in zip(parts, gaps, strict=True) for i in g}
        memo.update((w, before[w]) for w in new if w in before)
        self.learn([w for w in new if w not in before])
        for p, f, g in zip(parts, found, gaps, strict=True):
            for i in g:
                f[i] = memo[p[i]]
        return [b"".join(f) for f in found]


def forget_ids() -> None:
    _known.clear()


def word_ids(path: str) -> WordIds:
    """One per Python worker, so that later tasks know the strings of earlier ones."""
    if path not in _known:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _known[path] = WordIds(path)
    return _known[path]


class SumOfSquares:
    """Online bin packing into windows of `size` tokens that keeps squared fill counts small.

    `level[h]` is the number of open windows that hold h tokens. A piece of s
    tokens moves one window from h to h + s, which changes the sum of squares
    by 2 * (level[h + s] - level[h]) + 2; a full window leaves the sum and a
    new one comes from level 0. The smallest change wins, the fullest window
    among equal ones.
    """

    def __init__(self, size: int):
        self.size, self.level = size, np.zeros(size + 1, np.int64)
        self.open: dict[int, list[int]] = {}
        self.windows: list[list | None] = []

    def put(self, piece: tuple, s: int) -> None:
        """Place `piece`, whose last item but one is its length s, 0 < s <= size."""
        size, level = self.size, self.level
        if s == size:
            self.windows.append([piece])
            return
        now = level[1 : size - s + 1]
        change = np.empty(size - s + 1)
        change[0] = 2 * level[s] + 1
        change[1:] = 2 * (level[s + 1 :] - now) + 2
        change[-1] = -2 * level[size - s] + 1
        change[1:][now == 0] = np.inf
        at = size - s - int(np.argmin(change[::-1]))
        if at:
            w = self.open[at].pop()
            self.windows[w].append(piece)
            level[at] -= 1
        else:
            w = len(self.windows)
            self.windows.append([piece])
        if at + s < size:
            level[at + s] += 1
            self.open.setdefault(at + s, []).append(w)

    def close(self) -> list[list]:
        """The windows; those still open are refilled by cutting, so that all but the last are full.

        The emptiest windows give up their pieces to the fullest ones. The rest
        of r tokens becomes one window for each power of two in r, which needs
        no padding.
        """
        left = sorted(((h, w) for h, ws in self.open.items() for w in ws), reverse=True)
        fill, give = 0, len(left) - 1
        room = {w: self.size - h for h, w in left}
        while fill < give:
            target, source = left[fill][1], left[give][1]
            pieces = self.windows[source]
            while pieces and room[target]:
                *key, start, length, data = pieces.pop()
                take = min(length, room[target])
                if take < length:
                    pieces.append((*key, start, length - take, data[: 4 * (length - take)]))
                self.windows[target].append((*key, start + length - take, take, data[4 * (length - take) :]))
                room[target] -= take
            if not pieces:
                give -= 1
            if not room[target]:
                fill += 1
        rest = [p for _, w in left[fill : give + 1] for p in self.windows[w] if room[w]] if left else []
        gone = {w for _, w in left[fill:] if room[w]}
        done = [x for i, x in enumerate(self.windows) if x and i not in gone]
        total = sum(p[-2] for p in rest)
        for bit in range(total.bit_length() - 1, -1, -1):
            if total >> bit & 1:
                need, window = 1 << bit, []
                while need:
                    *key, start, length, data = rest.pop()
                    take = min(length, need)
                    if take < length:
                        rest.append((*key, start + take, length - take, data[4 * take :]))
                    window.append((*key, start, take, data[: 4 * take]))
                    need -= take
                done.append(window)
        return done


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 2, shard_tokens: int = 8_000_000) -> DataFrame:
    """Cut documents into pieces and place them into sequences of at most `size` tokens.

    A document is its text's ids (null: none) and then `end_id`. Whole windows
    are cut off its front; the rest is placed by the sum-of-squares rule over
    the fill levels of its shard. A shard is a stretch of one input partition of
    about `shard_tokens` tokens (the bound of memory), closed by refilling its
    open windows. Sequences need padding only where they are neither full nor a
    power of two long, which closing avoids.

    Returns per piece `id_col`, start, length, ids_crc32 (of the ids as unsigned
    little-endian 32-bit numbers), doc_tokens, sequence_id and offset. Without a
    shuffle: the shard is the unit that a lost task computes again, from the
    same rows. An empty text is one piece of one token; repeated rows are packed
    each; an empty table gives no piece; null ids stay null; other columns are
    ignored.
    """
    ship(docs)
    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    kind = d.schema["_id"].dataType.simpleString()
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing", forget_ids)
        ids_of = word_ids(tokenizer_path)
        part, n_shard, tokens, packer = TaskContext.get().partitionId(), 0, 0, SumOfSquares(size)

        def flush(kinds: pa.DataType) -> Iterator[pa.RecordBatch]:
            rows: tuple[list, ...] = ([], [], [], [], [], [], [])
            for k, window in enumerate(packer.close()):
                at = 0
                for key, total, start, length, data in window:
                    for col, v in zip(rows, (key, start, length, zlib.crc32(data), total, (part << 40) + (n_shard << 24) + k, at), strict=True):
                        col.append(v)
                    at += length
            names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            for i in range(0, len(rows[0]), 20_000):
                cols = [pa.array(rows[0][i : i + 20_000], kinds), *(pa.array(c[i : i + 20_000], pa.int64()) for c in rows[1:])]
                yield pa.RecordBatch.from_arrays(cols, names)

        kinds = pa.int64()
        for b in batches:
            kinds = b.schema.field(0).type
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(texts), 256):
                for key, data in zip(keys[lo : lo + 256], ids_of(texts[lo : lo + 256]), strict=True):
                    data += end
                    total, cut = len(data) // 4, 0
                    tokens += total
                    while total - cut >= size:
                        packer.put((key, total, cut, size, data[4 * cut : 4 * (cut + size)]), size)
                        cut += size
                    if cut < total:
                        packer.put((key, total, cut, total - cut, data[4 * cut :]), total - cut)
                    if tokens >= shard_tokens:
                        yield from flush(kinds)
                        packer, tokens, n_shard = SumOfSquares(size), 0, n_shard + 1
        if tokens:
            yield from flush(kinds)

    return d.mapInArrow(run, f"_id {kind}, {PIECES}").withColumnRenamed("_id", id_col)
