"""The pipeline's stages against brute force on the smallest table and on odd texts."""

import re

import pytest

import corpus_pipeline
from panelforge.llm.store import save

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(save(stage(spark, out[-1], SF), name))
    return out


def _tokens(line):
    words = [w for w in re.split(r"[ \t\x0b\f\r]+", line.lower()) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "repeat_dedup", "packing"]
    for df in stages[1:-1]:
        assert sorted(df.columns) == sorted(stages[0].columns)


def test_toxicity_keeps_rows_whole(stages):
    before = {r.doc_id: r.text for r in stages[0].collect()}
    after = {r.doc_id: r.text for r in stages[1].collect()}
    assert 0.7 * len(before) < len(after) <= len(before) and all(before[k] == v for k, v in after.items())


def test_line_dedup(stages):
    rows = sorted((r.doc_id, r.text) for r in stages[1].collect())
    earlier, want = [], {}
    for key, text in rows:
        kept = []
        for line in text.split("\n"):
            own = _tokens(line)
            if not (own and any(100 * len(own & o) >= 80 * len(own | o) for o in earlier)):
                kept.append(line)
            if own:
                earlier.append(own)
        want[key] = "\n".join(kept)
    assert {r.doc_id: r.text for r in stages[2].collect()} == want


def test_near_dedup(stages):
    rows = {r.doc_id: r.text for r in stages[2].collect()}
    sets = {}
    for key, text in rows.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[key] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {k: k for k in rows}
    for a in sorted(rows):
        for b in sorted(rows):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    assert {r.doc_id for r in stages[3].collect()} == {k for k, v in root.items() if k == v}


def test_repeats_gone(stages):
    rows = {r.doc_id: r.text for r in stages[3].collect()}
    after = {r.doc_id: r.text for r in stages[4].collect()}
    assert after.keys() == rows.keys()
    seen = {}
    for key, text in rows.items():
        data = text.encode()
        for i in range(len(data) - 199):
            seen.setdefault(data[i : i + 200], []).append(key)
    touched = {k for keys in seen.values() if len(keys) > 1 for k in keys}
    for key, text in rows.items():
        assert (after[key] == text) == (key not in touched)
        assert stages[4].where(f"doc_id = {key}").first().n_chars == len(after[key]) if key in touched else True


def test_packing_holds_every_token_once(stages):
    pieces = stages[5].collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == {r.doc_id for r in stages[4].collect()}
    for own in by_doc.values():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == own[0].doc_tokens
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048


def test_odd_texts(spark, odd_docs, tmp_path):
    spark.createDataFrame([(i, 1, int(i == 16)) for i in range(18)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, str(tmp_path)), name)
    assert docs.count() > 0
    empty = odd_docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = save(stage(spark, empty, str(tmp_path)), name)
    assert empty.count() == 0
