"""Toxicity, packing, near-duplicates and line dedup: held-out accuracy, exactness, odd texts."""

import re

import numpy as np
import pytest

from panelforge.llm import lines, minhash, packing, toxicity
from panelforge.llm.queries import WORD_BPE
from panelforge.llm.store import vocabulary

SF = "/root/testdata/sf0.01"
WORDS = vocabulary(WORD_BPE)


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    plain, gapped, clean = model.decide(["moron", "mo-roxn", "the"])
    assert plain > gapped > clean


def test_machine_holds_no_copy_of_its_features():
    """The machine is fitted on the driver, whose memory is bounded: its products are added up over parts of the rows."""
    import tracemalloc

    rng = np.random.default_rng(0)
    x1 = np.ones((30000, 129), np.float32)
    x1[:, :-1] = rng.normal(size=(30000, 128))
    y = np.where(x1[:, 0] + rng.normal(size=30000) > 0, 1.0, -1.0)
    tracemalloc.start()
    u, bias = toxicity._svm(x1, y, np.full(30000, 1 / 30))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x1.nbytes and u[0] > 5 * np.abs(u[1:]).max()


def test_toxicity_holds_with_another_sample_bound(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    known = docs.join(labels.select("doc_id", "toxic"), "doc_id")  # held-out rows and others
    got = []
    for bound in (4000, 35):  # no class is cut; 35 of each class
        monkeypatch.setattr(toxicity, "MAX_LABELLED", bound)
        model = toxicity.train(docs, labels)
        got.append({r.doc_id: r.predicted for r in toxicity.score(known, model).collect()})
    assert np.mean([got[0][k] == got[1][k] for k in got[0]]) > 0.95


def test_logistic_weights_equal_repeated_rows():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 2)), (rng.random(60) < 0.3).astype(float)
    weight = np.where(y == 1, 1.0, 7.0)
    again = np.repeat(np.arange(60), weight.astype(int))
    assert np.allclose(toxicity._logistic(x, y, weight), toxicity._logistic(x[again], y[again], np.ones(len(again))), atol=1e-5)


def subsequence_vector(piece):
    """Weighted subsequences by definition: four characters in at most SPAN, the first among the first PIECE."""
    from itertools import combinations

    out = {}
    for at in range(min(len(piece), toxicity.PIECE)):
        for rest in combinations(range(at + 1, min(len(piece), at + toxicity.SPAN)), 3):
            found = piece[at] + "".join(piece[i] for i in rest)
            out[found] = out.get(found, 0) + toxicity.DECAY ** (rest[-1] - at + 1)
    return out


def kernel(a, b):
    x, y = subsequence_vector(a), subsequence_vector(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


SENTENCES = ["you are an idiot", "an idiot he was of the", "and and and and and and and and", "what a moron", "the sea is blue and wide here", "erre # erre abcd"]


def test_kernel_features_and_decisions_equal_the_definition():
    space = toxicity.Landmarks(SENTENCES[:4])
    want = np.array([[kernel(a, b) for b in SENTENCES[:4]] for a in SENTENCES])
    assert np.allclose(space.kernel(SENTENCES), want, atol=1e-5)
    # Whitened features give the kernel among the landmarks back.
    x = space.features(SENTENCES[:4])
    assert np.allclose(x @ x.T, want[:4], atol=1e-3)
    u = np.array([0.5, -1.0, 2.0, 0.25])
    model = toxicity.Model(weights=space.weights(u), bias=-0.5)
    alone = [s[: toxicity.PIECE].strip() for s in SENTENCES if "#" not in s]  # one piece each, as a sentence ends without a blank
    want = np.array([[kernel(a, b) for b in SENTENCES[:4]] for a in alone]) @ space.whiten @ u - 0.5
    assert np.allclose(model.decide(alone), want, atol=1e-4)


def test_highest_decisions_equal_all_decisions():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abno "), 9)) for _ in range(60)]
    texts = [" ".join(rng.choice(words, n)) + "." for n in (0, 1, 5, 40, 400)] + ["and and " * 300, ""]
    model = toxicity.Model(weights=toxicity.Landmarks(words[:9]).weights(rng.normal(size=9)), bias=-0.2)
    want = {}
    for c, own, begin, end, _ in toxicity.blocks(texts):
        every = toxicity._window_sums(model._dots(c), begin, end) / toxicity.norms(c, begin, end) - 0.2
        for owner, d in zip(own, every):
            want.setdefault(owner, []).append(d)
    got = model.features(texts)
    for i in range(len(texts)):
        best = sorted(want.get(i, []), reverse=True)[:3]
        assert np.allclose(got[i, :3], best + [-0.2] * (3 - len(best)), atol=1e-5) and np.isclose(got[i, 3], np.log1p(len(want.get(i, []))))


def test_sentences_and_marks():
    def read(text):
        c, _ = toxicity.codes([text])
        return "".join((toxicity.ALPHABET + "|")[i] for i in c).replace("|" * (toxicity.SPAN - 1), "|")

    assert read("An  1diot! id-1o#t.  mor0n\nh.e \u00c9t\u00e9 \u4e2d") == "an idiot|idiot|moron|he ete #|"
    assert read("") == "|" and read(" . ! ") == "|||"


def test_slices_hold_the_whole_text(monkeypatch):
    text = "abc idiot " * 50 + "x" * 300 + " end"
    whole = toxicity.Model(weights=toxicity.Landmarks(["an idiot"]).weights(np.ones(1)))
    want = whole.features([text])[0]
    monkeypatch.setattr(toxicity, "SLICE", 64)
    assert "".join(toxicity.slices(text)) == text and max(map(len, toxicity.slices(text))) <= 64
    assert np.allclose(whole.features([text])[0, :1], want[:1], atol=0.1)


def test_inserted_letters_are_tolerated(spark):
    """Of held-out texts found toxic most stay so with a letter put into every longer word; few clean ones turn."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out(docs["doc_id"])).select("text", "toxic").collect()
    found = [r.text for r in rows if r.toxic and model.score([r.text or ""])[0] >= 0.5]
    clean = [r.text or "" for r in rows if r.toxic == 0]
    assert found and np.mean(model.score(toxicity.with_insertions(found)) >= 0.5) >= 0.6
    assert np.mean(model.score(toxicity.with_insertions(clean)) >= 0.5) < 0.05


def test_toxicity_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0)], "doc_id bigint, toxic int")
    assert toxicity.score(odd_docs, toxicity.train(odd_docs, labels)).count() == 18
    assert toxicity.score(no_docs, toxicity.train(no_docs, labels.limit(0))).count() == 0


def test_tokens_equal_the_library(odd_docs):
    coder = packing.tokens(WORDS)
    texts = [r.text or "" for r in odd_docs.collect()]
    want = [np.array(coder.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert coder.encode(texts) == want and coder.encode(texts) == want


def test_plan_holds_every_piece():
    rng = np.random.default_rng(2)
    sizes = np.unique(rng.integers(1, 257, 60))
    demand = rng.integers(1, 400, len(sizes))
    made = packing.plan(sizes, demand, 256)
    assert (sum(n * p for p, n in made) == demand).all() and all(p @ sizes <= 256 for p, _ in made)
    assert sum(n for _, n in made) <= 1.05 * np.ceil(sizes @ demand / 256)


def test_packing_odd(spark, odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs.union(odd_docs), WORDS).collect()
    assert sum(r.length for r in rows if r.doc_id == 0) == 2  # a null text, twice: its end token
    assert packing.pack_documents(no_docs, WORDS).count() == 0


@pytest.mark.parametrize("width,percent,block", [(3, 85, 512), (5, 80, 512), (3, 85, 4)])
def test_near_duplicates_against_brute_force(spark, odd_docs, monkeypatch, width, percent, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(width)
    words = [f"w{i}" for i in range(300)]
    base = rng.choice(words, 80).tolist()
    texts = []
    for i in range(60):  # a chain of edits, so that components are larger than one step
        copy = list(base)
        for at in rng.choice(80, i % 7, replace=False):
            copy[at] = str(rng.choice(words))
        texts.append(" ".join(copy))
    texts += [" ".join(rng.choice(words, 60)) for _ in range(20)] + [r.text for r in odd_docs.collect()]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        own = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1))} if own else set())
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, width, percent).collect()}
    assert [got[i].component_id for i in range(len(texts))] == root
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert minhash.near_duplicates(docs.limit(0), width, percent).count() == 0


def test_near_duplicates_of_a_posting_over_two_blocks(spark):
    """1,100 texts that share most of their shingles, of which no two are similar enough, and one true pair."""
    common = [f"c{i}" for i in range(87)]  # 85 shingles of three words
    texts = [" ".join([*common, *(f"t{i}x{k}" for k in range(8))]) for i in range(1100)]
    texts.append(texts[700] + " end")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert got == {**{i: i for i in range(1100)}, 1100: 700}


def test_line_report_odd(spark, odd_docs, no_docs):
    rows = {r.doc_id: r for r in lines.line_report(odd_docs).collect()}
    assert rows[8].removed == [0] and rows[7].removed == [] and rows[17].removed == [1, 4] and rows[0].n_lines == 1
    assert lines.line_report(no_docs).count() == 0


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    for rows in ([(5, a), (5, b), (7, a + " z"), (9, b + " z")], [(5, b), (5, a), (7, a + " z"), (9, b + " z")]):
        docs = spark.createDataFrame([*rows, (None, a), (3, None), (3, a), (3, a)], "doc_id bigint, text string")
        got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
        assert got == sorted([(5, 3, False), (5, 5, True), (7, 3, False), (9, 5, False), (None, None, True), (3, 3, True), (3, 3, True), (3, 3, True)], key=str)
        kept = sorted(((r.doc_id, r.text) for r in minhash.keep_first(docs).collect()), key=str)
        assert kept == sorted([(3, None), (3, a), (5, b), (None, a)], key=str)
