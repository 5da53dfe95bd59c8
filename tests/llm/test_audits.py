"""Secret scan, centroid clustering and filter audit against brute force, on odd rows too."""

import hashlib
import re
from itertools import permutations

import numpy as np

from panelforge.llm import centroids, interactions, secrets
from panelforge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _tokens():
    body = "abcDEF0123456789ghijKLMNOPqrst"
    good = body + secrets.crc_base62(body.encode()).decode()
    data = bytes(range(60, 138))
    whole = int.from_bytes(bytes.fromhex("0488ade4") + data[4:] + b"", "big")
    payload = whole.to_bytes(78, "big")
    value = int.from_bytes(payload + hashlib.sha256(hashlib.sha256(payload).digest()).digest()[:4], "big")
    xprv = ""
    while value:
        value, digit = divmod(value, 58)
        xprv = chr(secrets.BASE58[digit]) + xprv
    digits = bytes(secrets.BECH32[(7 * i) % 32] for i in range(52))
    rest = secrets.bech32_residue(b"nsec", digits + b"qqqqqq") ^ 1
    nsec = "nsec1" + (digits + bytes(secrets.BECH32[rest >> 5 * (5 - i) & 31] for i in range(6))).decode()
    return "ghp_" + good, "npm_" + good, xprv, nsec


def _brute(text):
    """Base kinds by one pattern each over the whole text."""
    text, out = text or "", []
    for i, (kind, pattern, least, group) in enumerate([
        ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
        ("access", r"AKIA[A-Z0-9]+", 16, 0),
        ("hex", r"[0-9a-f]+", 32, 0),
    ]):
        out += [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [x[2] for x in sorted(out)]


HIDDEN = [
    'Password = "abcdefgh" passwd:short secret=\'x.y=z/12345', "ſecret=abcdefghij toKen=abcdefghij TOKEN: token=abcdefgh", "api_key:=12345678 APIKEY = 12345678 api__key=12345678",
    "é🙂 AKIA" + "Q" * 12 + " AKIA" + "Q" * 11 + " akia" + "Q" * 20 + "AKIAAKIAAKIAAKIA", "f" * 31 + " " + "0" * 32 + "g" + "ab" * 50 + "AB", "0" * 64 + "secret=" + "a" * 40, "token=tokentoken=secret:passwordpassword=12345678",
    "password" * 40 + "=" + "x" * 9, "漢" * 500 + "token='" + "9" * 33, "",
]


def test_secret_scan_against_brute_force(spark, odd_docs):
    texts = HIDDEN + [r.text for r in odd_docs.collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.secrets] for r in secrets.scan(docs).collect()}
    assert got == {i: _brute(t) for i, t in enumerate(texts)}
    assert sum(len(v) for v in got.values()) > 15


def test_secret_query_against_brute_force(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        found = _brute(r.text)
        counts = [sum(f.startswith(k) for f in found) for k in secrets.BASE_KINDS]
        want[r.doc_id] = (*counts, hashlib.sha256(",".join(found).encode()).hexdigest(), ",".join(found))
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in QUERIES["op11_secrets"](spark, SF).collect()}
    assert got == want


def test_secret_checksums_decide():
    for token, kind in zip(_tokens(), ("github", "npm", "xprv", "nsec")):
        text = f"see {token}, and"
        assert secrets.find(text) == [(4, 4 + len(token), kind)], kind
        at = len(token) // 2
        other = token[:at] + ("q" if token[at] != "q" else "p") + token[at + 1 :]
        assert secrets.find(f"see {other}, and") == []
        assert secrets.find(f"see {token}x") == []


def test_published_bech32_examples_hold():
    # An example key of the age format's specification and one of the Nostr specification NIP-19.
    age = "AGE-SECRET-KEY-1GFPYYSJZGFPYYSJZGFPYYSJZGFPYYSJZGFPYYSJZGFPYYSJZGFPQ4EGAEX"
    nsec = "nsec1vl029mgpspedva04g90vltkh6fvh240zqtv9k0t9af8935ke9laqsnlfe5"
    assert secrets.find(age) == [(0, len(age), "age")] and secrets.find(nsec) == [(0, len(nsec), "nsec")]


def test_redaction_and_odd_tables(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(None, "token=abcdefgh12 x", "a"), (1, None, "b"), (1, None, "b")], "doc_id bigint, text string, secrets string")
    assert sorted((r.text or "", r.secrets) for r in secrets.redact(docs).collect()) == [("", "b"), ("", "b"), ("[assign] x", "a")]
    assert secrets.scan(docs).count() == 3 and secrets.scan(no_docs).count() == 0
    assert secrets.scan(spark.createDataFrame([(1, "y " * 2_500_000 + "secret=12345678")], "doc_id bigint, text string")).first().secrets[0].start == 5_000_000


def _lloyd(rows, k, rounds):
    """rows of (id, components): labels, distances and centroids by full search."""
    x = [r[1] for r in rows]
    named = [(hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None]
    c = [list(v) for _, v in sorted(named)[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), n) for n, m in enumerate(c))

    for _ in range(rounds):
        label = [place(v)[1] for v in x]
        for n in range(len(c)):
            own = [v for v, at in zip(x, label) if at == n]
            if own:
                c[n] = [sum(p) // len(own) for p in zip(*own)]
    return [place(v) for v in x], c


def test_nearest_equals_full_search():
    rng = np.random.default_rng(5)
    for spread, size in ((3, 16), (400, 64), (1 << 25, 8)):
        c = rng.integers(-spread, spread + 1, (13, size))
        c[7] = c[2]  # a tie goes to the smaller number
        x = np.concatenate([rng.integers(-spread, spread + 1, (500, size)), c])
        full = ((x[:, None] - c[None]).astype(object) ** 2).sum(axis=2)
        label, distance, measured = centroids.nearest(x, c)
        assert (label == [min(range(13), key=row.__getitem__) for row in full]).all() and (distance == full.min(axis=1)).all()
    x = rng.normal(0, 5, (4000, 64)).astype(np.int64) + rng.integers(-300, 300, (4000, 1))
    assert centroids.nearest(x, x[:50].copy())[2] < 4000 * 50 / 3  # most centroids are rejected by their sums


def test_clustering_against_brute_force(spark):
    rng = np.random.default_rng(9)
    raw = [(int(i) % 280, [float(v) for v in rng.normal(i % 5, 0.3, 4)]) for i in range(300)] + [(None, [1e5, -1e5, 0.0, 0.5])]
    bad = [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0]), (903, [1.0, float("nan"), 2.0, 3.0]), (904, [1.0, float("inf"), 2.0, 3.0]), (905, [1.0] * 5)]
    table = spark.createDataFrame([(i, v, "x") for i, v in raw + bad], "vec_id bigint, embedding array<double>, cluster string").repartition(5)
    want, c = _lloyd([(i, [int(np.floor(1024 * a)) for a in v]) for i, v in raw], 8, 10)
    rows = centroids.cluster(table, components=4).collect()
    assert sorted((r.vec_id or -1, r.cluster, r.distance) for r in rows) == sorted((i or -1, n, d) for (i, _), (d, n) in zip(raw, want))
    assert {r.inertia for r in rows} == {sum(d for d, _ in want)}
    assert all(r.cluster_inertia == sum(d for d, n in want if n == r.cluster) for r in rows)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest() for r in rows)
    assert centroids.cluster(table.where("vec_id >= 900"), components=4).count() == 0
    few = centroids.cluster(table.where("vec_id in (3, 4, 5)"), components=4).collect()
    assert len(few) == len([i for i, _ in raw if i in (3, 4, 5)]) and {r.distance for r in few if r.vec_id == 3} <= {0, *[r.distance for r in few]}


def test_ranks_and_intervals():
    orders = ["".join(p) for p in permutations("ABCDE")]
    assert [interactions.order_of(r) for r in range(120)] == orders
    at = {}
    for mask, step, first, past in interactions.intervals():
        for rank in range(first, past):
            assert (mask, rank) not in at
            at[mask, rank] = step
    assert all(at[mask, r] == min(orders[r].index("ABCDE"[i]) + 1 for i in range(5) if mask >> i & 1) for mask in range(1, 32) for r in range(120))


def test_filter_audit_against_brute_force(spark, odd_docs, no_docs):
    rng = np.random.default_rng(4)
    rows = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    for i in range(20, 90):
        text = " ".join(rng.choice([f"w{k}" for k in range(rng.integers(5, 90))], rng.integers(30, 90)))
        rows.append((i, text.upper() if i % 3 == 0 else text + " #" * (i % 2), f"s{i % 3}"))
    rows += [(100 + i, rows[20 + i % 9][1], f"s{i % 4}") for i in range(30)]
    rows += [rows[25], rows[25], (None, rows[30][1], "s1"), (None, "alone", None), (7, rows[40][1], "")]
    marks = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 130, 2)] + [(None, 1, 1), (3, None, None), (4, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id bigint, text string, source string, mask int, part string").repartition(4)
    good, toxic = {i for i, q, _ in marks if i is not None and q == 1}, {i for i, _, t in marks if i is not None and t == 1}
    known = []
    for i, t, p in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        known.append((p or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    want, value = {}, {}
    for part in {k[0] for k in known}:
        for order in permutations("ABCDE"):
            left = [k for k in known if k[0] == part]
            all_ = left
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in k[1]]
                left = [k for k in left if f not in k[1]]
                value[part, f] = value.get((part, f), 0) + len(gone)
                want[part, "".join(order), step] = [len(left), len(gone), sum(f in k[1] for k in all_) - len(gone), sum(k[1] == {f} for k in all_), sum(k[2] for k in gone), sum(k[3] for k in gone)]
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in interactions.audit(docs, labels).collect()}
    assert got == {k: [*v, value[k[0], k[1][k[2] - 1]]] for k, v in want.items()}
    assert interactions.audit(no_docs, labels.limit(0)).count() == 0
