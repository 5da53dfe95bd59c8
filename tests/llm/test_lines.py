"""Line deduplication against all pairs of lines."""

import re
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import lines, store


def _set(line):
    words = re.split(r"[ \t\x0b\f\r]+", line.lower().strip(lines.BLANKS))
    if words == [""]:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def _direct(rows):
    """{(id, number)} of removed lines of rows with distinct ids."""
    found = sorted((key, i, _set(x)) for key, text in rows if key is not None for i, x in enumerate((text or "").split("\n")))
    gone = set()
    for k, (key, i, own) in enumerate(found):
        if own and any(5 * len(own & s) >= 4 * len(own | s) for _, _, s in found[:k] if s):
            gone.add((key, i))
    return gone


def _ours(docs):
    return {(r.doc_id, i) for r in lines.line_report(docs).collect() for i in r.removed}


def _texts(seed, n):
    """Lines of a few words, with copies, one-word edits, shared passages and much-used phrases."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choice(vocabulary, 14))
    base = [" ".join(rng.choice(vocabulary, int(rng.integers(1, 40)))) for _ in range(12)]
    out = []
    for key in range(n):
        own = []
        for _ in range(int(rng.integers(0, 5))):
            words = str(rng.choice(base)).split()
            for _ in range(int(rng.integers(0, 3))):
                words[int(rng.integers(len(words)))] = str(rng.choice(vocabulary))
            if rng.random() < 0.4:
                words = passage.split() + words
            own.append(str(rng.choice([" ", "  ", "\t"])).join(words))
        out.append((key, "\n".join(own)))
    return out


@pytest.mark.parametrize("hot", [1, 8])
def test_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT", hot)
    rows = _texts(hot, 80)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = _direct(rows)
    assert len(want) > 20 and _ours(docs) == want


def test_repeated_rows_null_ids_and_clashing_names(spark):
    long = " ".join(f"a{i}" for i in range(30))
    rows = [(3, long, 0), (3, long, 1), (3, "other words of this row\n" + long, 2), (None, long, 3), (5, "x\n" + long, 4), (5, None, 5), (1, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, gone int")
    out = lines.remove_lines(docs)
    assert out.columns == docs.columns
    left = {r.gone: (r.doc_id, r.text) for r in out.collect()}
    # Equal rows of one id stay both; of the two texts of id 3 the one with the smaller hash is first.
    assert left[3] == (None, long) and left[4] == (5, "x") and left[5] == (5, None) and left[6] == (1, "")
    assert left[0] == left[1]
    assert sorted([left[0][1], left[2][1]]) in (["", "other words of this row\n" + long], sorted([long, "other words of this row"]))
    assert len(left) == 7


def test_very_long_text(spark):
    rng = np.random.default_rng(3)
    text = "\n".join(" ".join(f"v{x}" for x in rng.integers(0, 10**6, 200)) for _ in range(3000))
    docs = spark.createDataFrame([(1, text), (2, text.replace("\n", " x\n", 1))], "doc_id bigint, text string")
    report = {r.doc_id: r for r in lines.line_report(docs).collect()}
    assert report[1].n_removed == 0 and report[2].n_removed == 3000


def test_odd_blanks(spark):
    words = " ".join(f"b{i}" for i in range(12))
    odd = f"\t {words.upper()}".replace(" B5", "  \t\x0bb5").replace(" B9", "   B9") + " \r"
    docs = spark.createDataFrame([(1, f"{words}\n\n \t\n"), (2, f"\r\n{odd}\n  ")], "doc_id bigint, text string")
    rows = {r.doc_id: (r.n_lines, r.removed) for r in lines.line_report(docs).collect()}
    assert rows == {1: (4, []), 2: (3, [1])}


def _plans(spark, monkeypatch, threshold):
    """Plan of each table that is written, by its tag."""
    plans, save = {}, lines.save

    def noted(df, tag):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return save(df, tag)

    monkeypatch.setattr(lines, "save", noted)
    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    spark.conf.set(name, threshold)
    try:
        lines.removed_lines(spark.createDataFrame(_texts(2, 30), "doc_id bigint, text string")).count()
    finally:
        spark.conf.set(name, old)
    return plans


def test_postings_move_once(spark, monkeypatch):
    """As on large tables, where no join is a broadcast."""
    plans = _plans(spark, monkeypatch, "-1")
    assert [len(re.findall(r"Exchange hashpartitioning\(key", plans[tag])) for tag in ("postings", "ordered")] == [1, 1]


def test_large_joins_do_not_follow_the_size(spark, monkeypatch):
    plans = _plans(spark, monkeypatch, "10m")
    assert re.search(r"SortMergeJoin \[s1", plans["postings"]) and re.search(r"SortMergeJoin \[doc_id", plans["sets"])


def test_drop_takes_the_files_of_shuffles(spark):
    """A shuffle is kept as long as its plan, which the driver may not collect for long."""
    tables = [store.save(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "dropped") for _ in range(2)]
    folder = spark.sparkContext.getConf().get("spark.local.dir")
    before = {p for p in Path(folder).rglob("shuffle_*.data")}
    assert before
    store.drop(*tables)
    for _ in range(50):
        if not all(p.exists() for p in before):
            break
        time.sleep(0.2)
    assert not all(p.exists() for p in before) and not any(Path(t.saved_at.removeprefix("file:")).exists() for t in tables)
