"""Class-based scores, toxicity, line dedup and the pipeline."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from lodestone.llm import brown, linededup, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
fold = lambda i, n: zlib.crc32(("" if i is None else str(i)).encode()) % n


def prose(rng, n, lang):
    nouns = [f"{lang}n{i}" for i in range(60)]
    verbs = [f"{lang}v{i}" for i in range(40)]
    return " ".join(rng.choice(nouns if i % 2 else verbs) for i in range(n))


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(1)
    n, k = 30, 5
    counts = rng.poisson(0.7, (n, n)) + 9 * (np.add.outer(np.arange(n) % 3, np.arange(n)) % 3 == 0)
    cls = np.r_[rng.integers(1, k, n - 1), 0]

    def profiles(c):
        right, left = np.zeros((n, k)), np.zeros((n, k))
        for u in range(n):
            np.add.at(right[u], c, counts[u])
            np.add.at(left[u], c, counts[:, u])
        joint = np.zeros((k, k))
        np.add.at(joint, c, right)
        return joint, left, right

    f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
    value = lambda c: f(j := profiles(c)[0]) - f(j.sum(0)) - f(j.sum(1))
    seen = [value(cls)]
    for _ in range(5):
        cls = brown.exchange(*profiles(cls), cls, n - 1)
        seen.append(value(cls))
    assert seen[-1] > seen[0] + 100 and cls[n - 1] == 0 and 0 not in cls[:-1]


def test_class_scores(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(0, 80), rng.choice(["x", "y"])) + (" Rare%d" % i if i % 7 == 0 else "")) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "never seen words only"), (None, "xn1 xv1"), (5, "xn1 again"), (2000, "xn1 xv2 " * 20_000)]
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in rows], "doc_id long, text string, n int, block string")
    out = brown.score_documents(df, classes=8, frequent=50, tails=16, rare=2, part_chars=4000).collect()
    c = collections.Counter()
    for i, t in rows:
        if fold(i, 5) != 1:
            c.update([*WORDS(lower(t)), "\n"])
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), fold(i, 5) == 1, len(w := [*WORDS(lower(t)), "\n"]), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 3)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in out) == want
    assert all(r.score < 0 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)
    assert brown.score_documents(df.limit(0)).count() == 0


def test_class_model_against_brute_force(spark):
    """Classes as trained; counts, transitions, emissions and scores anew from the texts; and every probability adds up to 1."""
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(0, 60), rng.choice("xyz")) + (f" Once{i}" if i % 5 == 0 else "")) for i in range(400)] + [(900, None), (901, "unseen words")]
    df = spark.createDataFrame(rows, "_id long, t string").selectExpr("_id", "coalesce(t, '') t", "pmod(crc32(cast(_id as string)), 5) = 1 held")
    parts, mapped, model = brown.train(df, classes=8, frequent=40, tails=8, rare=3, part_chars=3000)
    cls, count = {}, {}
    for r in parts.select("part", "h").join(mapped, "part").collect():
        for h, c, n in zip(r.h, np.frombuffer(r.c, "<u2").tolist(), np.frombuffer(r.count_, "<i8").tolist(), strict=True):
            assert cls.setdefault(h, c) == c and count.setdefault(h, n) == n
    tokens = {i: [brown._hash(w) for w in WORDS(lower(t))] for i, t in rows}
    c, joint = collections.Counter(), np.zeros((8, 8))
    for i, w in tokens.items():
        if fold(i, 5) != 1:
            c.update(w)
            path = [0, *(cls[h] for h in w), 0]
            np.add.at(joint, (path[:-1], path[1:]), 1)
    ends = sum(fold(i, 5) != 1 for i, _ in rows)
    assert all(c[h] == n for h, n in count.items()) and 0 not in cls.values()
    assert (model.after == joint.sum(axis=0)).all() and model.total == joint.sum() and model.n_docs == ends
    once = np.bincount([cls[h] for h, n in c.items() if n == 1], minlength=8)
    want = brown.estimate(joint, once, model.unseen > 0, model.total, model.distinct, ends)
    assert np.array_equal(want.step, model.step) and np.allclose(want.unseen, model.unseen)
    assert np.allclose((10.0**model.step).sum(axis=1), 1)
    for k in range(8):  # known words of a class, and all unseen ones
        known = sum(10 ** float(model.emit(np.array([n]), np.array([k]))[0]) for h, n in c.items() if cls[h] == k) + (10 ** float(model.emit(np.array([ends]), np.array([0]))[0]) if k == 0 else 0)
        assert model.after[k] == 0 or abs(known + model.unseen[k] - 1) < 1e-9
    got = {r.doc_id: r for r in brown.score_documents(df.selectExpr("_id doc_id", "t text"), classes=8, frequent=40, tails=8, rare=3, part_chars=3000).collect()}
    for i, w in tokens.items():
        path, n = [0, *(cls[h] for h in w), 0], [*(c[h] for h in w), ends]
        score = sum(model.step[a, b] for a, b in zip(path, path[1:], strict=False)) + model.emit(np.array(n), np.array(path[1:])).sum()
        assert abs(got[i].score - score) < 1e-6


def test_moves_of_other_words_make_texts_likelier(spark):
    """Words outside the most frequent ones find the class of their kind, whatever their tails say."""
    rng = random.Random(3)
    noun, verb = ([f"{x}{rng.randrange(10**6)}" for _ in range(300)] for x in "ab")
    rows = [(i, " ".join(f"the {rng.choice(noun)} {rng.choice(verb)} it" for _ in range(20))) for i in range(300)]
    df = spark.createDataFrame(rows, "_id long, t string").selectExpr("_id", "t", "false held")
    parts, mapped, _ = brown.train(df, classes=6, frequent=60, tails=16, rare=3)
    cls = {h: c for r in parts.select("part", "h").join(mapped, "part").collect() for h, c in zip(r.h, np.frombuffer(r.c, "<u2").tolist(), strict=True)}
    kinds = [collections.Counter(cls[brown._hash(w)] for w in words if brown._hash(w) in cls) for words in (noun, verb)]
    shared = sum(min(kinds[0][c], kinds[1][c]) for c in range(6))
    assert shared <= 0.02 * sum(map(len, (noun, verb)))


def test_parts_are_row_groups_of_their_own(spark):
    """However many parts a task makes, those after it read one at a time: memory follows a part's size, not the table's."""
    rng = random.Random(4)
    df = spark.createDataFrame([(i, prose(rng, 50, "x")) for i in range(200)], "_id long, t string").selectExpr("_id", "t", "false held").coalesce(1)
    parts, mapped, _ = brown.train(df, classes=4, frequent=20, tails=8, rare=3, part_chars=3000)
    for made in (parts, spark.read.parquet(mapped.inputFiles()[0])):
        sizes = [meta.row_group(i).num_rows for f in made.inputFiles() for meta in [pq.read_metadata(f.removeprefix("file://"))] for i in range(meta.num_row_groups)]
        assert set(sizes) == {1}
    assert parts.count() > 15


def test_held_out_scores_beat_the_base(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = brown.score_documents(d).where("held_out").groupBy().sum("score", "base_score").first()
    assert r[0] > 0.85 * r[1]


def test_toxicity(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    extra = spark.createDataFrame([(90_001, None, 1), (90_002, "", 0), (90_003, "you worthless idiot, pathetic moron and disgusting scum", 0), (None, "plain words", 1)], "doc_id long, text string, score int")
    docs = d.select("doc_id", "text").unionByName(extra.drop("score")).crossJoin(spark.createDataFrame([(7,)], "score int"))
    more = labels.union(spark.createDataFrame([(1, 1, None), (90_002, 1, 0)], labels.schema))
    out = {r.doc_id: r for r in toxicity.toxicity(docs, more).collect()}
    assert len(out) == d.count() + 4
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (r.doc_id is not None and fold(r.doc_id, 3) == 1) for r in out.values())
    assert out[90_003].score > 0.3 > out[90_001].score and out[90_001].predicted == 0 and out[90_002].score == out[90_001].score
    y = {r.doc_id: r.toxic for r in labels.collect()}
    clean = [r for i, r in out.items() if y.get(i) == 0]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    ordinary = sorted(r.score for r in clean)[int(0.98 * len(clean))]
    english = [out[i] for i, t in y.items() if t == 1 and re.search(r"idiot|moron|scum|pathetic|trash|worthless", out[i].text or "")]
    assert sum(r.score > ordinary for r in english) >= 0.8 * len(english)  # 34 toxic texts are too few for sure scores
    assert toxicity.toxicity(docs.limit(0), more).count() == 0
    assert toxicity.toxicity(docs.limit(3), more.limit(0)).where("predicted = 1").count() == 0


def test_kneser_ney_is_a_distribution():
    m = toxicity.KneserNey({"abba": (5, 1), "abc": (2, 7), "cab": (0, 3), "b": (1, 0)}, order=3)
    letters = {c for w in ("abba", "abc", "cab", "b") for c in w} | {"\x03"}
    for c in (0, 1):
        for h in ("\x02", "\x02a", "ab", "b", "", "zz"):
            total = sum(m.prob(h + x, c) for x in letters)
            assert abs(total + (m.letters - len(letters)) * m.prob(h + "\x01", c) - 1) < 1e-9
    r = m.compiled()
    assert r.word("cab") > 0 > r.word("abba")
    for w in ("cab", "abba", "zz", "bbbb", "cabba", ""):  # the compiled form gives what the recursion does
        grams = [g[max(0, i - 2) : i + 1] for g in [f"\x02{w}\x03"] for i in range(1, len(g))]
        assert abs(r.word(w) - sum(math.log(m.prob(g, 1) / m.prob(g, 0)) for g in grams)) < 1e-9
    assert m.pooled["b"] == 3  # after a and b and as a word's start, though both classes hold some of them




def test_line_dedup(spark):
    rng = random.Random(4)
    sentence = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k)).capitalize() + "."
    passages = [[sentence(rng.randint(5, 10)) for _ in range(9)] for _ in range(12)]
    rows, hold = [], {}
    for i in range(200):
        own = [sentence(rng.randint(4, 12)) for _ in range(rng.randint(2, 9))]
        p = rng.choice([None, *range(12)])
        at = rng.randint(0, len(own))
        body = own if p is None else own[:at] + passages[p] + own[at:]
        rows.append((i, rng.choice(["\n", " "]).join(body)))
        hold[i] = (own, p)
    rows += [(500, None), (501, ""), (502, "Short repeated line."), (503, "Short repeated line."), (504, rows[0][1]), (505, "One.\nTwo.\n" * 400), (506, "Tail. " * 5000), (None, "no id. at all.")]
    rows += [rows[7]]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, e string, removed_words int")
    out = linededup.dedup_lines(df.repartition(5)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in rows)
    got = {r.doc_id: r for r in out}
    first, gone, words = {}, 0, 0
    for i in range(200):
        own, p = hold[i]
        for s in own:
            assert s in got[i].text
        if p is not None:
            if p in first:
                words += len(" ".join(passages[p]).split())
                gone += got[i].removed_words
            else:
                assert got[i].removed_words == 0
            first.setdefault(p, i)
    assert gone >= 0.9 * words
    for i in (500, 501, 502, 503, 506, None):  # 506 is one line over and over: a single chunk
        assert got[i].text == dict(rows)[i] and got[i].removed_words == 0
    assert 0 < len(got[505].text) < 200 and dict(rows)[505].startswith(got[505].text[:9])  # repeats within a document go as well
    assert got[504].text.strip() == "" or got[504].removed_words > 0
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def brute_dedup(rows, min_words=30):
    """Document by document in order of ids, with a dictionary of first chunks and of what stands beside them."""
    docs = sorted({(i, t) for i, t in rows if t and t.strip()})
    parsed = {}
    for d in docs:
        x = linededup.Lines([d[1].encode()])
        parsed[d] = x, linededup.Chunks(x.hash, x.fed, np.array([len(x.hash)]))
    seen = collections.Counter(h for _, c in parsed.values() for h in c.hash[c.several].tolist())
    first, cuts = {}, collections.defaultdict(list)
    for d in docs:
        x, c = parsed[d]
        ks = [k for k in range(len(c.start)) if c.several[k] and seen[c.hash[k]] > 1]
        want = np.array([(k, 1, 0) for k in ks], linededup._WANT)
        s = linededup.Sides(x, np.zeros(len(ks), int), want)
        for key, side, at, low, high in zip(s.key.tolist(), s.side.tolist(), s.at.tolist(), s.low.tolist(), s.high.tolist(), strict=True):
            mine = x.plain(low, high)[:: side or 1]
            held = first.setdefault((side, key), (d, at, mine))
            if held[:2] != (d, at):
                same = next((n for n, (p, q) in enumerate(zip(mine, held[2], strict=False)) if p != q), min(len(mine), len(held[2])))
                if side or same == len(mine) == len(held[2]):
                    cuts[d].append((at - same, at) if side < 0 else (at, at + same))
    out = {}
    for d in docs:
        x, gone = parsed[d][0], {n for a, b in cuts[d] for n in range(a, b)}
        starts = [0, *x.start[1:].tolist(), len(x.data) - 1]
        text, run = b"", []
        for n in range(len(x.start) + 1):
            if n in gone:
                run.append(n)
                continue
            lost = b"".join(x.data[starts[m] : starts[m + 1]] for m in run)
            text += (b"" if len(lost.split()) >= min_words else lost) + (x.data[starts[n] : starts[n + 1]] if n < len(x.start) else b"")
            run = []
        out[d] = text.decode()
    return [(i, out.get((i, t), t)) for i, t in rows]


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(15)
    word = lambda: rng.choice(["and", "all", "them", "with", "paper", "o'clock", "élan", "x"]) if rng.random() < 0.3 else f"w{rng.randrange(3000)}"
    lines = [" ".join(word() for _ in range(rng.randint(1, 30))) + rng.choice([". ", "\n", "! ", " "]) for _ in range(150)]
    blocks = ["".join(rng.choices(lines, k=rng.randint(2, 12))) for _ in range(25)]
    rows = [(i, "".join(rng.choice(blocks) if rng.random() < 0.3 else rng.choice(lines) for _ in range(rng.randint(1, 12)))) for i in range(250)]
    rows += [(1000, None), (1001, ""), (1002, " \n "), (3, rows[3][1]), (4, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = [(r.doc_id, r.text) for r in linededup.dedup_lines(df, bucket_bytes=4_000).collect()]
    want = brute_dedup(rows)
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(a != b for a, b in zip(want, rows, strict=True)) > 50


def planted(rng, passage, at, before, after):
    """A text of own words with a passage set in after `at` sentences."""
    own = lambda k: " ".join(f"o{rng.randrange(10**9)}" for _ in range(k)) + ". "
    return "".join(own(rng.randint(3, 9)) for _ in range(before)) + passage + "".join(own(rng.randint(3, 9)) for _ in range(after))


def test_short_passages_are_all_found(spark):
    """Passages of 2 to 6 lines and over 50 words, two holders each: the later one loses all of it and nothing else."""
    rng, rows, want = random.Random(11), [], {}
    for k in range(2, 7):
        for _ in range(40):
            size = -(-52 // k)
            passage = "".join(" ".join(f"p{rng.randrange(10**9)}" for _ in range(size)) + ". " for _ in range(k))
            for later in (0, 1):
                before, after = rng.randint(0, 4), rng.randint(1, 4)
                rows.append((len(rows), planted(rng, passage, 0, before, after)))
                want[len(rows) - 1] = rows[-1][1].replace(passage, "") if later else rows[-1][1]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(df.repartition(5)).collect()}
    assert got == want


def test_unrelated_holders_hide_no_repeat(spark):
    """A first holder of the frequent lines inside a passage, or one with other line ends, keeps no later repeat from being found."""
    rng, rows, want = random.Random(12), [], {}
    some = lambda k: " ".join(f"p{rng.randrange(10**9)}" for _ in range(k)) + ".\n"
    usual = "all rights are reserved.\n", "see the terms of use.\n"
    rows.append((0, planted(rng, "".join(usual), 0, 3, 3)))
    want[0] = rows[0][1]
    for _ in range(60):
        passage = some(25) + "".join(usual) + some(25)
        for later in (0, 1):
            i, t = len(rows), planted(rng, passage, 0, 2, 2)
            rows.append((i, t))
            want[i] = t.replace(passage, "") if later else t
    for _ in range(20):
        passage = "".join(some(12) for _ in range(5))
        for ends in ("\r\n", "\n", "\n"):
            i, p = len(rows), passage.replace("\n", ends)
            t = planted(rng, p, 0, 2, 2)
            rows.append((i, t))
            want[i] = t if ends == "\r\n" else t.replace(p, "")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.dedup_lines(df).collect()}
    differ = [i for i in want if got[i].text != want[i]]
    assert len(differ) <= 0.05 * len(want)  # a frequent chunk at a passage's end may keep the lines beside it
    assert all(got[i].removed_words >= 30 and got[i].text.endswith(want[i][-20:]) for i in differ)


def test_long_lines_are_found(spark):
    """Repeats of over 50 words without a line end of their own, or that start and end inside other sentences."""
    rng, rows, want = random.Random(13), [], {}
    some = lambda c, k, gap=" ": gap.join(f"{c}{rng.randrange(10**9)}" for _ in range(k))
    kinds = [lambda: some("p", 51), lambda: some("p", 51, "; "), lambda: some("p", 60), lambda: some("p", 2000), lambda: some("p", 25) + ". " + some("p", 26), lambda: some("p", 51, "\t")]
    for k in range(120):
        run = kinds[k % len(kinds)]()
        for later in (0, 1):
            rows.append((len(rows), f"{some('o', rng.randint(1, 40))} {run} {some('o', rng.randint(1, 40))}"))
            want[rows[-1][0]] = (later, set(run.replace(".", "").replace(";", "").split()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in linededup.dedup_lines(df.repartition(5)).collect():
        later, run = want[r.doc_id]
        left = {w.strip(".;") for w in r.text.split()}
        before = {w.strip(".;") for w in dict(rows)[r.doc_id].split()}
        assert before - run <= left  # other words stay
        assert len(run & left) <= 20 if later else run <= left


def test_cutting_needs_no_hashes():
    """Spans come as numbers, met ones as one; what cuts lines out does not hash them."""
    rng = random.Random(8)
    for _ in range(200):
        spans = [(a, a + rng.randint(1, 6)) for a in rng.choices(range(60), k=rng.randint(1, 12))]
        covered = {i for a, b in spans for i in (2 * a, *range(2 * a, 2 * b), 2 * b)}
        got = linededup.merged(np.array([(a << 32) + b for a, b in spans]))
        assert {i for a, b in got for i in range(2 * a, 2 * b + 1)} == covered and all(b < a for (_, b), (a, _) in zip(got, got[1:], strict=False))
    x = linededup.Lines([b"one two three.\nfour five six.\nseven"])
    assert linededup.without(x, 0, linededup.merged(np.array([(0 << 32) + 1, (1 << 32) + 2])), 1) == ("seven", 6)
    assert "hash" not in vars(x) and len(x.hash) == len(x.start)


def test_lines_join_to_the_text():
    texts = ["", "a", "a\n", "a.\n\nb! c?d? e", " . x\n", "\n\n", "mark \x01 held and. so on", "word " * 60, "x\ty\n" * 40]
    for t in texts:
        assert "".join(linededup.lines(t)) == (t if t.strip() else "") and all(linededup.lines(t))
    many = linededup.Lines([t.encode() for t in texts])  # many documents at once have the lines of each
    for i, t in enumerate(texts):
        alone = linededup.Lines([t.encode()])
        assert many.plain(*(many.first[i : i + 2])) == alone.plain(0, len(alone.start)) and (many.hash[many.span(i)] == alone.hash).all() and (many.fed[many.span(i)] == alone.fed).all()


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = corpus_pipeline.table(stage(spark, before, sf), name)
        assert kept.columns == docs.columns
        assert kept.join(before, "doc_id", "left_anti").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert pieces.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
    assert pieces.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 4096").count() == 0
    assert corpus_pipeline.run(spark, sf).groupBy().sum("length").first()[0] == pieces.groupBy().sum("length").first()[0]


def test_mix_meets_what_is_taken(spark):
    """Long documents come in each source as often as the mixture takes their words, the last of a shard apart."""
    rng, rows = random.Random(14), []
    for source, n in (("a", 40), ("b", 150), ("c", 150), (None, 40)):
        rows += [(len(rows) + i, " ".join("w" for _ in range(rng.randint(1500, 4000))), source) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = lambda t: len(t.split())
    want, got = collections.Counter(), collections.Counter()
    for r in corpus_pipeline.mixing.mix_sources(df).collect():
        want[r.source] += r.taken
    copies = collections.Counter()
    for r in corpus_pipeline.mix(spark, df.repartition(3), "").collect():
        got[r.source] += size(r.text)
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 2
    assert all(abs(got[k] - want[k]) <= 4000 + 300 for k in want)  # 300: blocks by a different shard order


def test_mix_keeps_null_and_repeated_ids(spark):
    long = lambda c, n: " ".join([c] * n)
    rows = [(None, long("x", 3000), "a"), (None, long("y", 2000), "a"), (7, long("u", 2500), "b"), (7, long("v", 10), "b"), (8, long("z", 900), "b"), (8, long("z", 900), "b"), (9, None, "a"), (10, " ", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    due = collections.Counter()
    for r in corpus_pipeline.mixing.mix_sources(df).collect():
        due[r.doc_id, r.size, r.source] += r.taken
    got = collections.Counter((r.doc_id, len(r.text.split()), r.source) for r in corpus_pipeline.mix(spark, df, "").collect())
    assert {k[0] for k in got} >= {None}
    for (i, n, s), words in due.items():
        if n:
            assert abs(got[i, n, s] - words / n) < 2  # by less than one, and by a block of another order
    assert not any(k[0] in (9, 10) for k in got)
