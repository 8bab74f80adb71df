"""Registered queries of the operators, with production parameters, over whole
tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, jaccard, licenses, lm, merkle, negatives, packing, pii, repeats, token_counts, topk, toxicity
from .common import read


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = topk.quantise(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vecs, vecs.where(F.col("vec_id") % 50 == 0), k=5)


def span_digest(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = pii.find_spans(docs, pii.train(docs))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long) as n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(span_digest("base"), 256).alias("base_sha256"),
                        span_digest("spans").alias("spans"),
                        (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_decode(read(spark, sf_dir, "documents"))
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"), k=4, pct=85)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.labelled(rows.withColumn("label", label)), F.col("vec_id") % 50 == 0)


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


QUERIES = {"op1_topk": op1_topk, "op2_pii": op2_pii, "op3_lm": op3_lm, "op4_token_counts": op4_token_counts,
           "op5_bpe": op5_bpe, "op6_jaccard": op6_jaccard, "op7_packing": op7_packing, "op8_toxicity": op8_toxicity,
           "op9_fingerprints": op9_fingerprints, "op10_licenses": op10_licenses,
           "op11_negatives": op11_negatives, "op12_repeats": op12_repeats, "op13_merkle": op13_merkle}

ORACLE = {
    "op1_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op6_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 4
           THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))
           WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh
  FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS root FROM s
  UNION SELECT p.y, r.root FROM reach r JOIN pairs p ON r.doc_id = p.x
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.sh
""",
    "op11_negatives": """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.rid, a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.rid <> c.rid AND len(a.e) = len(c.e)
  WHERE a.vec_id % 50 = 0
), p AS (
  SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS place
  FROM s WHERE same
), r AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.rid, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.rid = p.rid AND NOT s.same
   AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
  WHERE p.place <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM r WHERE rank <= 3
""",
    "op12_repeats": r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), w AS MATERIALIZED (
  SELECT rid, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)
), r AS (
  SELECT rid, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)
), c AS (
  SELECT rid, list_distinct(flatten(list(range(i, i + 35)))) AS gone FROM r GROUP BY rid
), k AS (
  SELECT rid, list(ws[i] ORDER BY i) AS kept
  FROM (SELECT d.rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) x
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT rid, unnest(gone) AS j FROM c) g WHERE g.rid = x.rid AND g.j = x.i)
  GROUP BY rid
)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(len(k.kept), 0) AS n_removed,
       sha256(coalesce(array_to_string(k.kept, ' '), '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
""",
    "op13_merkle": """
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, text,
         CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
         || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
         || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
         || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head,
         -- the remainder of crc32, bit by bit over the id's digits
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
               lambda c: CAST(ord(c) AS BIGINT))),
             lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
               lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 3 AS r
  FROM documents
), g AS (
  SELECT rid, doc_id, coalesce('=' || lang, '-') AS tree,
         sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         CASE WHEN r = 0 AND text IS NOT NULL THEN sha256(head || strlen(text) || ':' ||
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) END AS bad
  FROM f
), l AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos,
         count(*) OVER (PARTITION BY tree) AS n FROM g
), lv AS (
  SELECT tree, 0 AS level, pos, leaf AS node, n FROM l
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8
  FROM lv WHERE n > 1 GROUP BY tree, level, pos // 8, n
), sub AS MATERIALIZED (
  SELECT tree, node AS subroot, level AS h, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n
  FROM lv WHERE n = 1
), cl AS (
  SELECT 0 AS level, place AS pos, subroot AS node, n FROM sub
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8
  FROM cl WHERE n > 1 GROUP BY level, pos // 8, n
), runs AS MATERIALIZED (
  SELECT tree, level, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM lv WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT '' AS tree, level, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM cl WHERE n > 1 GROUP BY ALL
), walk AS (
  SELECT l.rid, l.tree, l.tree AS own, 0 AS level, l.pos, coalesce(l.bad, l.leaf) AS node, '' AS sibs, sub.h
  FROM l JOIN sub USING (tree)
  UNION ALL
  SELECT w.rid, w.tree, CASE WHEN w.own <> '' AND w.level >= w.h THEN '' ELSE w.own END,
         CASE WHEN w.own <> '' AND w.level >= w.h THEN 0 ELSE w.level + 1 END,
         CASE WHEN w.own <> '' AND w.level >= w.h THEN s.place ELSE w.pos // 8 END,
         CASE WHEN w.own <> '' AND w.level >= w.h THEN w.node ELSE sha256(array_to_string(
           r.nodes[1:w.pos % 8] || [w.node] || r.nodes[w.pos % 8 + 2:], '')) END,
         CASE WHEN w.own <> '' AND w.level >= w.h THEN w.sibs ELSE w.sibs || array_to_string(
           r.nodes[1:w.pos % 8] || r.nodes[w.pos % 8 + 2:], '') END, w.h
  FROM walk w JOIN sub s ON s.tree = w.tree
  LEFT JOIN runs r ON r.tree = w.own AND r.level = w.level AND r.run = w.pos // 8
  WHERE (w.own <> '' AND w.level >= w.h) OR r.nodes IS NOT NULL
), top AS (SELECT max(node) AS root FROM cl WHERE n = 1
), done AS (
  SELECT rid, arg_max(node, level) AS folded_root, arg_max(sibs, level) AS sibs FROM walk WHERE own = '' GROUP BY rid
)
SELECT l.doc_id, l.leaf, sub.subroot, top.root, sha256(done.sibs) AS proof_sha256, done.folded_root,
       done.folded_root = top.root AS verified
FROM l JOIN sub USING (tree) JOIN done USING (rid) CROSS JOIN top
""",
}
