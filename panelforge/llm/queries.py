"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import bpe, centroids, interactions, lines, minhash, packing, quality, repeats, secrets, toxicity, urls, warc, winnow
from panelforge.llm.store import table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), BYTE_BPE)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.apply_policy(quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")), "base", "base_passed"), "v1")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_passed")).alias("base_failed"), "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edit_probe(table(spark, sf_dir, "documents"))


def op10_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_bytes(table(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [secrets.count_of(kind).alias(f"n_{kind}") for kind in secrets.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(secrets.base_only()).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_bpe": op4_bpe,
    "op5_url_filter": op5_url_filter,
    "op6_minhash": op6_minhash,
    "op7_quality_rules": op7_quality_rules,
    "op8_line_dedup": op8_line_dedup,
    "op9_winnowing": op9_winnowing,
    "op10_run_index": op10_run_index,
    "op11_secrets": op11_secrets,
    "op12_centroids": op12_centroids,
    "op13_filter_audit": op13_filter_audit,
}


def _lloyd_sql(clusters: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """Every round spelled out: distances of all vectors to all centroids, then floors of the means."""
    parts = [f"""
k AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64),
v AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS i, unnest(x) AS x FROM k),
s AS (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS c FROM k WHERE vec_id IS NOT NULL),
c0 AS MATERIALIZED (SELECT c, i, x FROM s JOIN v USING (r) WHERE c < {clusters})"""]
    for n in range(rounds + 1):
        parts.append(f"""
a{n} AS MATERIALIZED (
  SELECT r, min((d, c)) AS best
  FROM (SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{n} c USING (i) GROUP BY ALL) GROUP BY r)""")
        if n < rounds:
            parts.append(f"""
c{n + 1} AS MATERIALIZED (
  SELECT c.c, c.i, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (
    SELECT best[2] AS c, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
    FROM a{n} JOIN v USING (r) GROUP BY ALL) m USING (c, i))""")
    return f"""
WITH {",".join(parts)},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS sha FROM c{rounds} GROUP BY c)
SELECT k.vec_id, best[2]::INTEGER AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia,
       (sum(best[1]) OVER ())::BIGINT AS inertia, h.sha AS centroid_sha256
FROM a{rounds} JOIN k USING (r) JOIN h ON h.c = best[2]
"""


ORACLES: dict[str, str] = {
    "op6_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3 THEN [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] for i in range(1, len(words) - 1)]
                                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.x = d.doc_id
""",
    "op7_quality_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         [l for l in string_split(coalesce(text, ''), chr(10)) if regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines
  FROM documents),
w AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM d WHERE len(words) >= 3),
t AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM w),
r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM t WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words,
         coalesce(list_sum([length(x) for x in words]), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
  FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars > 25 * n_words OR 10 * n_symbols > 3 * n_words
            OR (n_lines > 0 AND 100 * n_dup_lines > 50 * n_lines) OR word_chars < 2 * n_words) AS kept
FROM m
""",
    "op8_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(lines)))::INTEGER AS line_no, unnest(lines) AS line, len(lines) AS n_lines
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
w AS (SELECT *, [x for x in regexp_split_to_array(lower(line), '[ \t\x0B\f\r]+') if x <> ''] AS words FROM l),
t AS (
  SELECT doc_id, line_no, list_sort(list_distinct(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE [array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)] END)) AS tokens
  FROM w WHERE len(words) > 0),
o AS (SELECT tokens, min((doc_id, line_no)) AS own, len(min(tokens)) AS n FROM t GROUP BY tokens),
e AS (SELECT own, n, unnest(tokens) AS token FROM o),
c AS (SELECT a.own AS x, b.own AS y, a.n AS n, b.n AS m, count(*) AS k FROM e a JOIN e b ON a.token = b.token AND b.own < a.own GROUP BY ALL),
g AS (SELECT DISTINCT x FROM c WHERE 100 * k >= 80 * (n + m - k)),
r AS (
  SELECT t.doc_id, t.line_no FROM t JOIN o ON t.tokens = o.tokens
  WHERE (t.doc_id, t.line_no) <> o.own OR o.own IN (SELECT x FROM g))
SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::BIGINT AS n_lines, count(r.line_no)::BIGINT AS n_removed,
       coalesce(list(r.line_no ORDER BY r.line_no) FILTER (r.line_no IS NOT NULL), []) AS removed
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, d.text
""",
    "op10_run_index": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, unnest(range(n - 199)) AS i, h FROM d WHERE n >= 200),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY md5(substr(h, 2 * i + 1, 400))) AS k FROM w),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM c WHERE k > 1),
s AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g),
r AS (SELECT doc_id, island, min(i) AS a, max(i) + 200 AS b FROM s GROUP BY ALL),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM r),
k AS (
  SELECT d.doc_id, count(p.a)::BIGINT AS n_spans, coalesce(sum(p.b - p.a), 0)::BIGINT AS n_removed,
         coalesce(string_agg(substr(d.h, 2 * p.since + 1, 2 * (p.a - p.since)), '' ORDER BY p.a), '') || substr(any_value(d.h), 2 * coalesce(max(p.b), 0) + 1) AS kept
  FROM d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, d.n AS n_bytes, k.n_removed, k.n_spans, sha256(unhex(k.kept)) AS kept_sha256 FROM d JOIN k USING (doc_id)
""",
    "op12_centroids": _lloyd_sql(),
    "op13_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e
  FROM documents),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
g AS (
  SELECT part, filter_order, n, good, toxic, fails,
         coalesce(list_min([instr(filter_order, y) for y in string_split(fails, '') if y <> '']), 6) AS gone
  FROM c, o),
s AS (
  SELECT part, filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS letter,
         sum(CASE WHEN gone > step THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN gone < step AND contains(fails, substr(filter_order, step, 1)) THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails = substr(filter_order, step, 1) THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN gone = step THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN gone = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM g, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM s
""",
}
