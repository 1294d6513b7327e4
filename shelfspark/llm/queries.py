"""The registered queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, hmm, langid, minhash, mixing, ordermin, pii, quality, secrets, tokens, toxicity, trie


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), minhash.NearDup(words=3, percent=85))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir), mixing.Mix(weights=(5, 2, 1), most=3))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.compared(documents(spark, sf_dir))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scores(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digests(tokens.write(documents(spark, sf_dir), tokens.TokenFiles(public_tokenizers.path("byte_bpe_50k.json"))))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir), divergence.Audit(least=10, top=10))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet"), group=5, most=9)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_language": op3_language,
    "op6_toxicity": op6_toxicity,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_source_mix": op5_source_mix,
    "op7_secrets": op7_secrets,
    "op8_order_minhash": op8_order_minhash,
    "op9_language_model": op9_language_model,
    "op10_token_files": op10_token_files,
    "op11_pii": op11_pii,
    "op12_source_divergence": op12_source_divergence,
    "op13_prefix_trie": op13_prefix_trie,
}

#: Brute force: every pair that shares a shingle is counted in full; components by transitive closure.
OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i:i+2] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * c >= 85 * (a.n + b.n - c)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM d
  UNION
  SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.y) AS component_id, d.doc_id = min(r.y) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.x = d.doc_id
GROUP BY d.doc_id
"""

#: Every prefix of every rebuilt conversation as a row; subtrees by membership of each node's smallest member.  CRC-32 by its table.
OP13_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
), own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, count(*) AS n,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(any_value(t)[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 9 AS h
  FROM own, crc GROUP BY conv_id
), k AS (
  SELECT c.conv_id, c.n, c.h, c.conv_id - c.conv_id % 5 AS base, least(c.h, coalesce(b.n, 0)) AS taken
  FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5
), turns AS (
  SELECT k.conv_id, pos, role, text FROM k JOIN own ON own.conv_id = k.base AND pos <= h
  UNION ALL
  SELECT k.conv_id, pos - h + taken, role, text FROM k JOIN own ON own.conv_id = k.conv_id AND pos > h
), m AS (
  SELECT conv_id, pos AS d, string_agg(sha256(sha256(text) || role), '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix, strlen(text)::BIGINT AS bytes FROM turns
  UNION ALL
  SELECT conv_id, 0, '', 0 FROM k
), node AS (
  SELECT d, prefix, min(conv_id) AS id, count(*) AS n, max(bytes) AS bytes FROM m GROUP BY d, prefix
), way AS (
  SELECT m.conv_id, m.d, node.id FROM m JOIN node USING (d, prefix)
), last AS (
  SELECT conv_id, max(d) AS d FROM way GROUP BY conv_id
), ended AS (
  SELECT way.d, way.id, sha256(string_agg(way.conv_id::VARCHAR, ',' ORDER BY way.conv_id)) AS ends FROM way JOIN last USING (conv_id, d) GROUP BY way.d, way.id
), up AS (
  SELECT node.d, node.id, node.n, node.bytes, way.id AS parent FROM node LEFT JOIN way ON way.conv_id = node.id AND way.d = node.d - 1
), kids AS (
  SELECT d - 1 AS d, parent AS id, count(*) AS kids FROM up WHERE d > 0 GROUP BY d, parent
), full_node AS (
  SELECT up.*, coalesce(kids, 0) AS kids FROM up LEFT JOIN kids USING (d, id)
), below AS (
  SELECT way.d, way.id, count(*) FILTER (u.kids = 0) AS leaves, sum((u.n - 1) * u.bytes) AS saved
  FROM full_node u JOIN way ON way.conv_id = u.id AND way.d <= u.d GROUP BY way.d, way.id
)
SELECT f.id::BIGINT AS conv_id, f.d::BIGINT AS depth, f.parent::BIGINT AS parent_conv_id, f.n::BIGINT AS n_convs, f.kids::BIGINT AS n_children,
  b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM full_node f JOIN below b USING (d, id) LEFT JOIN ended e USING (d, id)
"""

#: Every kept term for every group and pair of groups, whether counted or not.
OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), w AS (
  SELECT row_id, lang, source, unnest(words) AS term FROM d
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row_id) >= 10
), lang_p AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM kept
), g AS (
  SELECT DISTINCT lang, source FROM d
), counted AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0)::HUGEINT AS n
  FROM g JOIN kept ON kept.lang = g.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term) c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), p AS (
  SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM counted
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(s.value), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
  GROUP BY ALL
), terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p.p - q) * (p.p - q) // (p.p + q))::BIGINT AS value
  FROM p JOIN lang_p ON lang_p.lang = p.lang AND lang_p.term = p.term WHERE p.n > 0 AND p.p > q
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

ORACLE_SQL = {
    "op12_source_divergence": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
    "op4_minhash_near_dedup": OP4_SQL,
}
