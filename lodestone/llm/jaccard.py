"""N-gram Jaccard self-join by T-occurrence search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, forget, fresh, py_lower, py_words, release, ship, table
from .components import Forest, components

_BYTES = 7  # of a shingle hash that leave the task that made it
_PART = 1_000_000  # shingles of the documents that are sent as one part
_P = 0x9E3779B97F4A7C15
_words: dict[str, int] = {}


def forget_words() -> None:
    _words.clear()


def shingles(text: str | None, k: int) -> np.ndarray:
    """Distinct 64-bit hashes (sorted) of a text's k-word shingles; of the whole sequence if it has fewer words."""
    w = py_words(py_lower(text or ""))
    if not w:
        return np.empty(0, np.uint64)
    if len(_words) > 200_000:
        _words.clear()
    for x in set(w):
        if x not in _words:
            _words[x] = xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(_words.__getitem__, w), np.uint64, len(w))
    n = min(k, len(w))
    out, factor = np.zeros(len(w) - n + 1, np.uint64), n
    for j in range(n):
        factor = factor * _P % 2**64
        out += h[j : len(w) - n + 1 + j] * np.uint64(factor)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _cut(h: np.ndarray) -> np.ndarray:
    """The bits of sorted hashes that are sent."""
    h = h >> np.uint64(64 - 8 * _BYTES)
    return h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h


def _short(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h, "<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES].tobytes()


def _long(b: bytes) -> np.ndarray:
    raw = np.zeros((len(b) // _BYTES, 8), np.uint8)
    raw[:, :_BYTES] = np.frombuffer(b, np.uint8).reshape(-1, _BYTES)
    return raw.view("<u8").reshape(-1).astype(np.uint64)


def needed(n: int, m: int, percent: int) -> int:
    """Smallest overlap of sets of n and m items with 100 * overlap >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


_ROW = "kind int, part long, bucket int, id long, n int, k1 long, k2 long, at int, blob binary, more binary"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_DOC, _ONCE, _OFTEN, _PLACES, _GOT_ONCE, _GOT_OFTEN = range(6)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES)


def _level(df: np.ndarray) -> np.ndarray:
    """A byte that orders shingles by the number of documents they are in."""
    return np.minimum(255, 8 * np.log2(df)).astype(np.uint8)


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, bucket_bytes: int = 6_000_000) -> DataFrame:
    """Per document: id, n (shingles), k1, k2 (hash of the set), and for documents that can
    have a partner the shared shingles and, of these, the short lists.

    Documents form parts of about `_PART` shingles, so that what a task holds
    does not follow the size of a scan partition. A part sends its distinct shingle
    hashes, once each, to buckets by hash. A bucket sees how many documents hold a
    hash and answers for those that are in two or more. A partner shares at least
    percent % of a document's shingles, so a document with fewer shared ones is
    done; for the others, rarest shingles first, those after which fewer than the
    needed overlap remain are long lists, and those before are short: two partners
    share one of the latter.
    """
    ship(docs)
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    size = d.agg(F.coalesce(F.sum(F.octet_length("_t")), F.lit(0))).first()[0]
    n_buckets = max(16, min(1 << 20, int(size) // bucket_bytes))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("jaccard", forget_words)
        part, rows, held, n_held = TaskContext.get().partitionId() << 32, [], [], 0
        for df in batches:
            for key, text in zip(df["_id"].array, df["_t"], strict=True):
                h = shingles(text, k)
                sums = (int(h.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(h * np.uint64(_P)))) if len(h) else (0, 0)
                k1, k2 = (int(np.uint64(x).astype(np.int64)) for x in sums)
                rows.append((_DOC, part, (part + len(rows)) % n_buckets, None if pd.isna(key) else int(key), len(h), k1, k2, len(rows), None, None))
                held.append(_cut(h))
                n_held += len(h)
                if n_held >= _PART or len(rows) >= 20_000:
                    yield from lists(part, rows, held)
                    part, rows, held, n_held = part + 1, [], [], 0
        if rows:
            yield from lists(part, rows, held)

    def lists(part: int, rows: list[tuple], held: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        """The rows of one part: its documents, and its shingles by bucket."""
        yield _frame(rows)
        h = np.concatenate(held)
        at = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x) for x in held])
        by = np.argsort(h, kind="stable")
        h, at = h[by], at[by]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
        count = np.diff(np.r_[first, len(h)])
        once, often = first[count == 1], first[count > 1]
        many = np.minimum(255, count[count > 1]).astype(np.uint8)
        again = np.repeat(count > 1, count)
        rows = [(_PLACES, part, part % n_buckets, None, 0, 0, 0, 0, _short(h[again]), at[again].tobytes())]
        for kind, places, more in ((_ONCE, once, at[once]), (_OFTEN, often, many)):
            hs = h[places]
            bucket = (hs % np.uint64(n_buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            hs, more, bucket = hs[by], more[by], bucket[by]
            for b, lo, hi in zip(*_runs(bucket), strict=True):
                rows.append((kind, part, b, None, 0, 0, 0, 0, _short(hs[lo:hi]), more[lo:hi].tobytes()))
        for i in range(0, len(rows), 500):
            yield _frame(rows[i : i + 500])

    def answer(df: pd.DataFrame) -> pd.DataFrame:
        asked = df[df.kind.isin([_ONCE, _OFTEN])]
        out = [df[df.kind.isin([_DOC, _PLACES])]]
        if len(asked):
            hs = [_long(b) for b in asked.blob]
            weight = [np.ones(len(h)) if kind == _ONCE else np.frombuffer(m, np.uint8).astype(float) for h, kind, m in zip(hs, asked.kind, asked.more, strict=True)]
            _, inverse = np.unique(np.concatenate(hs), return_inverse=True)
            df_of = np.bincount(inverse, weights=np.concatenate(weight))[inverse]
            rows, lo = [], 0
            for h, kind, part, more in zip(hs, asked.kind, asked.part, asked.more, strict=True):
                n = df_of[lo : lo + len(h)]
                lo += len(h)
                if kind == _OFTEN:
                    rows.append((_GOT_OFTEN, part, 0, None, 0, 0, 0, 0, _short(h), _level(n).tobytes()))
                elif (yes := n > 1).any():
                    levels = _level(n[yes]).tobytes()
                    rows.append((_GOT_ONCE, part, 0, None, 0, 0, 0, len(levels), _short(h[yes]), np.frombuffer(more, np.uint32)[yes].tobytes() + levels))
            out.append(_frame(rows))
        return pd.concat(out)

    def gather(df: pd.DataFrame) -> pd.DataFrame:
        h, at, level = [np.empty(0, np.uint64)], [np.empty(0, np.uint32)], [np.empty(0, np.uint8)]
        for blob, more, n in df[df.kind == _GOT_ONCE][["blob", "more", "at"]].itertuples(index=False):
            h.append(_long(blob))
            at.append(np.frombuffer(more[: 4 * n], np.uint32))
            level.append(np.frombuffer(more[4 * n :], np.uint8))
        often = df[df.kind == _GOT_OFTEN]
        if len(often):
            oh = np.concatenate([_long(b) for b in often.blob])
            ol = np.concatenate([np.frombuffer(m, np.uint8) for m in often.more])
            by = np.argsort(oh)
            oh, ol = oh[by], ol[by]
            for blob, more in df[df.kind == _PLACES][["blob", "more"]].itertuples(index=False):
                ph = _long(blob)
                h.append(ph)
                at.append(np.frombuffer(more, np.uint32))
                level.append(ol[np.searchsorted(oh, ph)])
        h, at, level = np.concatenate(h), np.concatenate(at), np.concatenate(level)
        by = np.lexsort((h, level, at))
        h, at = h[by], at[by]
        docs = df[df.kind == _DOC][["id", "n", "k1", "k2", "at"]].reset_index(drop=True)
        lo, hi = np.searchsorted(at, docs["at"]), np.searchsorted(at, docs["at"], side="right")
        shared, short = [], []
        for n, a, b in zip(docs.n, lo, hi, strict=True):
            least = -(-percent * n // 100)
            if n and b - a >= least:
                own = h[a:b]
                short.append(own[: (n - least + 1) - (n - len(own))].astype(np.int64))
                shared.append(_short(np.sort(own)))
            else:
                shared.append(None)
                short.append(None)
        docs["shared"], docs["short"] = shared, short
        return docs[["id", "n", "k1", "k2", "shared", "short"]]

    sent = d.mapInPandas(send, _ROW)
    answered = sent.groupBy("bucket").applyInPandas(answer, _ROW)
    return answered.groupBy("part").applyInPandas(gather, "id long, n int, k1 long, k2 long, shared binary, short array<long>")


def _runs(x: np.ndarray) -> tuple[list, list, list]:
    """Value, start and end of each run of a sorted array."""
    if not len(x):
        return [], [], []
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return x[first].tolist(), first.tolist(), [*first[1:].tolist(), len(x)]


def search(queries: list[tuple], docs: list[tuple], percent: int, same: dict | None = None) -> list[tuple]:
    """Links (a, b) that connect all linked pairs of a query and a document.

    Both are (id, n, shared hashes, sorted). T-occurrence search over the inverted
    lists of `docs`: of a query's lists, up to T - 1 of the longest are set aside;
    the short ones are merged; what occurs T - L times or more in them is probed
    by binary search in the L long ones; documents that reach the overlap that the
    two sizes require are linked. `same` gives components known before; only links
    that connect more are returned.
    """
    ids = np.array([x[0] for x in docs])
    n = np.array([x[1] for x in docs])
    h = np.concatenate([x[2] for x in docs])
    owner = np.repeat(np.arange(len(docs)), [len(x[2]) for x in docs])
    by = np.lexsort((owner, h))
    h, owner = h[by], owner[by]
    keys, lo, hi = (np.array(x) for x in _runs(h))
    keys = keys.astype(np.uint64)
    forest = Forest(np.concatenate([ids, [q[0] for q in queries]]))
    if same:
        labels = np.array([same[i] for i in forest.ids.tolist()])
        forest.label = np.unique(labels, return_inverse=True)[1]
    places, out = forest.places(ids), []
    for me, size, own in queries:
        at = np.searchsorted(keys, own)
        at = at[at < len(keys)][keys[at[at < len(keys)]] == own[at < len(keys)]] if len(keys) else at[:0]
        least = -(-percent * size // 100)
        if len(at) < least:
            continue
        length = hi[at] - lo[at]
        at = at[np.argsort(length, kind="stable")]
        n_long = least - 1  # the most that still leaves one occurrence in the short lists
        short, long_ = at[: len(at) - n_long], at[len(at) - n_long :]
        merged = np.sort(np.concatenate([owner[lo[i] : hi[i]] for i in short]))
        cand, first = np.unique(merged, return_index=True)
        count = np.diff(np.r_[first, len(merged)])
        ok = (n[cand] * 100 >= percent * size) & (size * 100 >= percent * n[cand]) & (ids[cand] != me)
        mine = forest.label[forest.places(me)]
        ok &= forest.label[places[cand]] != mine
        cand, count = cand[ok], count[ok]
        if not len(cand):
            continue
        want = -(-percent * (size + n[cand]) // (100 + percent))
        if len(cand) < len(long_):  # the same binary probes, by document instead of by list
            for x, c in enumerate(cand):
                theirs = docs[c][2]
                count[x] = (theirs[np.minimum(np.searchsorted(theirs, own), len(theirs) - 1)] == own).sum()
            long_ = long_[:0]
        for i, left in zip(long_, range(len(long_) - 1, -1, -1), strict=True):
            lst = owner[lo[i] : hi[i]]
            p = np.searchsorted(lst, cand)
            count = count + ((p < len(lst)) & (lst[np.minimum(p, len(lst) - 1)] == cand))
            if left % 16 == 0:
                go = count + left >= want
                cand, count, want = cand[go], count[go], want[go]
                if not len(cand):
                    break
        for other in forest.join(me, places[cand[count >= want]]):
            out.append((me, int(other)))
    return out


_EDGES = "a long, b long"


def _docs(df: pd.DataFrame) -> list[tuple]:
    return [(int(i), int(n), _long(s)) for i, n, s in zip(df.id, df.n, df.shared, strict=True)]


def linked(sig: DataFrame, percent: int, block_bytes: int = 4_000_000) -> DataFrame:
    """Edges (a, b) that connect all linked pairs of documents in the table `sig` of signatures.

    Copies hang on the smallest id. Linked documents share a short list, so they
    meet in the cell of that list's smallest id, which holds the documents of all
    short lists with that smallest id; a document is in the cells of its lists. A
    cell of up to `block_bytes` of shingles is searched whole. A larger one is cut
    into blocks, each searched in itself; then the components' first documents
    with one another; then, exactly, every document outside a cell's largest
    component against every block of the cell, since the pairs that are left
    are connected already. No step holds more than two blocks.
    """
    same = ["k1", "k2", "n"]
    real = sig.where("n > 0 and id is not null")
    heads = real.groupBy(*same).agg(F.min("id").alias("head"), F.count("*").alias("_c"))
    copies = real.join(heads.where("_c > 1"), same).where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    # ids of one set differ, so no key of this join is hot
    first_of = heads.select(*[F.col(c).alias(f"_{c}") for c in same], "head")
    alive = real.where("shared is not null").join(first_of, (F.col("id") == F.col("head")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & (F.col("n") == F.col("_n")))
    alive = alive.select("id", "n", "shared", "short").dropDuplicates(["id", "n", "shared"])
    alive = table(alive, "jaccard-alive")
    lists = alive.select("id", F.explode("short").alias("h"))
    low = lists.groupBy("h").agg(F.min("id").alias("cell"), F.count("*").alias("c")).where("c > 1").select("h", "cell")
    cells = table(lists.join(low, "h").select("id", "cell").distinct(), "jaccard-lists")
    d = alive.select("id", "n", "shared").join(cells, "id")
    sizes = d.groupBy("cell").agg(F.ceil(F.sum(F.octet_length("shared") + 64) / block_bytes).cast("int").alias("m"), F.sum(F.octet_length("shared") + 64).alias("bytes"))
    sizes = table(sizes, "jaccard-sizes")
    d = table(d.join(sizes.select("cell", "m"), "cell").withColumn("slot", F.pmod(F.xxhash64("id"), F.col("m")).cast("int")), "jaccard-cells")

    def within(df: pd.DataFrame) -> pd.DataFrame:
        docs = _docs(df.drop_duplicates(["id", "n", "shared"]))  # a document may come in several cells
        return pd.DataFrame(search(docs, docs, percent) if len(docs) > 1 else [], columns=["a", "b"])

    # cells of one block are searched together, about a quarter of a block at a time
    n_bins = max(1, -(-4 * (sizes.where("m = 1").agg(F.sum("bytes")).first()[0] or 0) // block_bytes))
    shelf = F.when(F.col("m") > 1, F.col("cell")).otherwise(F.pmod(F.xxhash64("cell"), F.lit(n_bins)))
    edges = d.groupBy((F.col("m") > 1).alias("_large"), shelf.alias("_shelf"), "slot").applyInPandas(within, _EDGES)
    edges = table(edges, "jaccard-edges")
    forget(cells, alive)
    large = d.where("m > 1")
    blocks = F.ceil(F.sum(F.octet_length("shared") + 64) / block_bytes).cast("int")
    if large.limit(1).count():
        label = lambda e: table(large.join(components(e), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component"), "jaccard-known")
        known = label(edges)
        first = known.join(known.groupBy("cell", "comp").agg(F.min("id").alias("id")), ["cell", "comp", "id"])
        slots = first.groupBy("cell").agg(blocks.alias("k"))
        first = first.join(slots, "cell").withColumn("slot", F.pmod(F.xxhash64("id", F.lit(1)), F.col("k")).cast("int"))
        edges = edges.union(table(first.groupBy("cell", "slot").applyInPandas(within, _EDGES), "jaccard-edges"))
        known = label(edges)
        count = known.groupBy("cell", "comp").agg(F.count("*").alias("c"))
        top = count.groupBy("cell").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
        known = known.join(top.select("cell", "top"), "cell")
        out = known.where("comp <> top")
        n_out = out.groupBy("cell").agg(blocks.alias("q"))
        cols = ["cell", "id", "n", "shared", "comp"]
        ask = out.join(n_out, "cell").select(*cols, F.lit(True).alias("query"), F.pmod(F.xxhash64("id", F.lit(2)), F.col("q")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"))
        have = known.join(n_out, "cell").select(*cols, F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("i"), F.col("slot").alias("j"))

        def between(df: pd.DataFrame) -> pd.DataFrame:
            q, t = _docs(df[df["query"]]), _docs(df[~df["query"]])
            comp = dict(zip(df.id.tolist(), df.comp.tolist(), strict=True))
            return pd.DataFrame(search(q, t, percent, comp) if q and t else [], columns=["a", "b"])

        edges = edges.union(table(ask.union(have).groupBy("cell", "i", "j").applyInPandas(between, _EDGES), "jaccard-edges"))
    return edges.union(copies)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: `id_col`, n_shingles (long), component_id (long).

    A document's set holds its distinct k-word shingles over A-Z lower-cased words,
    or the whole sequence if it has fewer words. Two documents link when 100 *
    intersection >= `percent` * union. component_id is the smallest id reachable
    by links, itself included.

    A null or empty text has no shingles, links with nothing and is its own
    component. Repeated rows are returned each, with the component that any row
    of their id is in. A null id takes part in nothing and has a null component. An
    empty table gives an empty result; other columns are ignored. Ids are integers.
    """
    spark = docs.sparkSession
    sig = table(signatures(docs, id_col, text_col, k, percent), "jaccard-signatures")
    release(spark)
    found = components(linked(sig, percent))
    key = fresh(docs.select(id_col), "_ls_key")
    out = sig.select(F.col("id"), F.col("n").cast("long").alias("n_shingles"))
    out = out.join(found.withColumnRenamed("id", key), F.col("id") == F.col(key), "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
