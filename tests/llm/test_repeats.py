"""Repeated passages against a direct count of 200-byte strings."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from panelforge.llm import repeats, runindex

SF = "/root/testdata/sf0.001"


def _direct(rows):
    data = [(key, (text or "").encode()) for key, text in rows]
    seen = Counter(hashlib.md5(b[i : i + 200]).digest() for _, b in data for i in range(len(b) - 199))
    out = []
    for key, b in data:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - 199):
            if seen[hashlib.md5(b[i : i + 200]).digest()] > 1:
                gone[i : i + 200] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((key, len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _ours(docs):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeated_bytes(docs).collect()), key=str)


def test_longest_matches_equal_definition():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 10, 60, 200):
        text = rng.choice([97, 98, 255], n).astype(np.uint8)
        raw = text.tobytes()
        want = [max((next((k for k in range(n - max(i, j)) if raw[i + k] != raw[j + k]), n - max(i, j)) for j in range(n) if j != i), default=0) for i in range(n)]
        index = runindex.RunIndex(text)
        assert index.longest_matches().tolist() == want
        assert len(index.symbol) <= n


def test_run_index_is_small_on_repetitive_text():
    text = np.frombuffer(b"the same passage again and again; " * 400, np.uint8)
    assert len(runindex.RunIndex(text).symbol) < 100


def test_against_direct_count(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert _ours(docs) == _direct([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_texts(spark, odd_docs, no_docs):
    assert _ours(odd_docs) == _direct([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert _ours(no_docs) == []


@pytest.mark.parametrize("hot", [1, 12_000])
def test_periods_edges_and_hot_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = np.random.default_rng(9)
    random = lambda n: "".join(rng.choice(list("abcdefghij é"), n))
    common, long = random(260), random(1500)
    texts = ["x" * 199, "x" * 200, "x" * 201, "x" * 900, "ab" * 150, "abc" * 67, random(150) + common + random(150), common, common[:199], common[1:200] + "é", random(300) + common[:230], long, long[:700] + "!" + long[700:], random(500), random(180) + random(30)]
    texts += [random(20) + common[20:240] + random(20) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert _ours(docs) == _direct(list(enumerate(texts)))


def test_same_id_twice(spark):
    rows = [(1, "a" * 250), (1, "a" * 250), (1, "b" * 150), (2, "c" * 300)]
    assert _ours(spark.createDataFrame(rows, "doc_id bigint, text string")) == _direct(rows)


def test_removal_keeps_rows_and_columns(spark, odd_docs):
    out = {r.doc_id: r for r in repeats.remove_repeats(odd_docs).collect()}
    assert len(out) == odd_docs.count() and set(repeats.remove_repeats(odd_docs).columns) == set(odd_docs.columns)
    assert out[11].text == "" and out[13].text == odd_docs.where("doc_id = 13").first().text


def test_clashing_names_pass_unchanged(spark):
    passage = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(260))
    rows = [(1, "a " + passage, "u1", "t1", "k1", "o1"), (2, "b " + passage + " end", "u2", "t2", "k2", "o2"), (None, None, "u3", "t3", "k3", "o3"), (None, None, "u3", "t3", "k3", "o3")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, uid string, __text string, kept string, own string")
    got = sorted((tuple(r) for r in repeats.remove_repeats(docs).collect()), key=str)
    assert {r[0]: r[2:] for r in got if r[0]} == {r[0]: r[2:] for r in rows if r[0]} and sum(r[0] is None for r in got) == 2
    assert all(passage not in (r[1] or "") for r in got)
