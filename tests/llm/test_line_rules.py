"""Line dedup runs in DataFrame functions alone, by the rules that `linemodel` states in Python."""

import random
import re
import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import linededup, linemodel


def test_line_dedup_runs_no_python(spark, monkeypatch):
    plans, table = [], linededup.table
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(linededup, "table", lambda df, *a: (plans.append(plan(df)), table(df, *a))[1])
    passage = " ".join(f"w{i}" for i in range(80)) + ". "
    df = spark.createDataFrame([(1, "Own words. " + passage), (2, passage + "Others.")], "doc_id long, text string")
    df = table(df, "line-rules")
    out = linededup.dedup_lines(df, bucket_bytes=10**6)
    assert {r.doc_id: r.removed_words for r in out.collect()} == {1: 0, 2: 80}
    assert len(plans) == 2 and not any(re.search("Python|Pandas|Arrow", p) for p in [*plans, plan(out)])


def test_line_dedup_leaves_no_shuffle_files(spark, monkeypatch):
    """Files of finished steps go without help from garbage collection, since they count as disk while later steps run."""
    monkeypatch.setattr(linededup, "release", lambda *_: None, raising=False)
    dirs = [d.getPath() for d in spark._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f.name for d in dirs for f in Path(d).glob("*/shuffle_*.data")}
    passage = " ".join(f"w{i}" for i in range(80)) + ". "
    df = spark.createDataFrame([(1, "Own words. " + passage), (2, passage + "Others.")], "doc_id long, text string")
    before, key = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    linededup.dedup_lines(df)
    end = time.time() + 20
    while len(left := files() - before) > 1 and time.time() < end:  # that of the action that sums up bytes may stay; removal is not waited for
        time.sleep(0.2)
    assert len(left) <= 1
    assert spark.conf.get(key, None) == was


def test_both_forms_have_the_same_lines(spark):
    """Lines, their hashes and chunks of odd texts: gaps of all kinds, the marks themselves, long lines, letters of several bytes."""
    rng = random.Random(3)
    words = ["and", "all", "them", "with", "x", "d", "é.", "Ünd", "漢字。", "a\x01b", "\x02a", "\x02", "q?", "1234567890" * 5, "mm", "naïve"]
    gaps = [" ", " ", " ", "  ", "\n", " \n", "\t", "\r\n", "\n\n", "\x0c", "\x0b", ". ", ".\n"]
    some = lambda: rng.choice(gaps[:3] if rng.random() < 0.7 else gaps)
    texts = ["", " ", "\n", "a", "a ", " a", "d \n d", "\n\n x. y\n"] + ["".join(some() + rng.choice(words + [""]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    parsed = linededup._parsed(F.col("t"), lambda u, h, c: F.struct(u.alias("u"), h.alias("h"), c.alias("c")))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", parsed.alias("p"), linededup.whole_lines(F.col("t")).alias("w")).collect():
        x = linemodel.Lines([r.t.encode()])
        c = linemodel.Chunks(x.hash, x.fed, np.array([len(x.hash)]))
        assert [u.encode() for u in r.p.u] == x.plain(0, len(x.start))
        assert r.p.h == x.hash.view(np.int64).tolist()
        assert [tuple(y) for y in r.p.c] == [(s, e, h) for s, e, h, several in zip(c.start.tolist(), c.end.tolist(), c.hash.view(np.int64).tolist(), c.several, strict=True) if several]
        whole = "".join(linemodel.lines(r.t))
        assert "".join(r.w) == whole.lstrip(linemodel.GAPS) and len(r.w) == len(x.start)


def test_line_dedup_cuts_only_where_words_may_go(spark, monkeypatch):
    """Documents whose repeats have too few words to go are not cut into lines again; runs of spans that meet count together."""
    made, table, forget = {}, linededup.table, linededup.forget
    monkeypatch.setattr(linededup, "table", lambda df, name, *a: made.setdefault(name, table(df, name, *a)))
    monkeypatch.setattr(linededup, "forget", lambda *_: None)
    own = lambda i: f"Own{i} words{i}. Other{i} words{i}.\n"
    phrase = "Some phrase. And more. Of it.\n"
    halves = ["".join(f"{c}{i} half. " for i in range(10)) for c in "ab"]  # 20 words each
    rows = [(i, own(i) + phrase + own(i + 100)) for i in range(20)]
    rows += [(50, own(50) + halves[0] + own(51)), (51, own(52) + halves[1] + own(53)), (52, own(54) + "".join(halves) + own(55))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.removed_words for r in linededup.dedup_lines(df).collect()}
    assert {i for i, n in got.items() if n} == {52} and got[52] >= 30
    assert made["lines-cuts"].count() == 1
    forget(*made.values())


def test_words_of_spans_are_never_underrated(spark):
    """The number of words that decides whether a run is cut at all is no less than what is counted there."""
    rng = random.Random(9)
    texts = ["", "a", "\n", "漢字"] + ["".join(rng.choice(["a", "é", "bc", " ", "\n", "\t", "\r", "\x0b", "\x0c", "\xa0"]) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", linededup._most_words(F.col("t")).alias("n")).collect():
        assert len(re.findall(r"[^\x20\x09-\x0D]+", r.t)) <= r.n <= len(r.t) + 1
