"""Queries over the operators of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from latticeworks.llm import fixity, mixing, neardup, packing, pii, quality, resample, scoring, secrets, sharding, substrings, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op3_context_mixing_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def vocabulary() -> tuple[str, str]:
    """Paths of the tokenizer and of its merge ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), *vocabulary(), keep_ids=False).drop("ids")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.with_law(sharding.shard_by_bytes(_table(spark, sf_dir, "documents")))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    like = neardup.Similarity(words=3, percent=85)
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), like).select("doc_id", "n_shingles", "component_id", "kept")


def op10_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit drill: every record of ``pages``, against a second store of the same pages that a fixed rule has damaged in a few places."""
    pages = _table(spark, sf_dir, "pages")
    return fixity.audit(pages, fixity.damaged(pages))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(_table(spark, sf_dir, "documents")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_exact_top_k, op2_secret_scan, op3_context_mixing_score, op4_quality_rules, op5_substring_dedup, op6_mix_sources, op7_best_fit_packing, op8_sharding, op9_minhash_near_dedup, op10_merkle_audit, op11_personal_data, op12_importance_resampling]
    return {f.__name__: f for f in own}


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT * FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
WHERE rank <= 10
"""

_WORDS = "list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = f"""
WITH w AS (SELECT doc_id, coalesce({_WORDS.format(text="text")}, []) AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, ws FROM w),
k AS (SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS k FROM g),
r AS (SELECT doc_id, i FROM k WHERE k IN (SELECT k FROM k GROUP BY k HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM p ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(t.n, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM w LEFT JOIN t USING (doc_id)
"""

OP9_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS.format(text=_LOWER)}, []) AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, d.doc_id = m AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id) USING (doc_id)
"""

_LEVEL = """
l{n} AS (
  SELECT file, node // 16 AS node, sha256(string_agg(hash || ':' || start || ':' || "end", ',' ORDER BY l{p}.node)) AS hash, min(start) AS start, max("end") AS "end"
  FROM l{p} GROUP BY file, l{p}.node // 16),"""

#: Height 4 holds up to 65,536 records a file; the tree stops at the first level with one node, so the root is the lowest level without a node 1.
OP10_SQL = (
    """
WITH r AS (
  SELECT page_id, url, 'WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '')
      || '>\r\nWARC-Target-URI: ' || coalesce(url, '') || '\r\nContent-Type: text/html\r\nContent-Length: '
      || octet_length(encode(coalesce(html, ''))) || '\r\n\r\n' || coalesce(html, '') || '\r\n\r\n' AS record FROM pages),
h AS (
  SELECT page_id, sha256(record) AS hash, octet_length(encode(record)) AS length,
    CAST('0x' || substr(md5(coalesce(url, '')), 1, 8) AS BIGINT) % 256 < 2 AS corrupt FROM r),
f AS (
  SELECT *, CAST('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '') || '|' || hash), 1, 8) AS BIGINT)
    % greatest(1, (SELECT (count(*) + 4095) // 4096 FROM h)) AS file FROM h),
l0 AS (
  SELECT page_id, file, row_number() OVER w - 1 AS node, CAST(sum(length) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) - length AS start,
    CAST(sum(length) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end", hash, corrupt FROM f WINDOW w AS (PARTITION BY file ORDER BY page_id NULLS FIRST, hash)),"""
    + "".join(_LEVEL.format(n=n, p=n - 1) for n in (1, 2, 3, 4))
    + """
h0 AS (SELECT max(node) AS top FROM l0),
roots AS (
  SELECT file, hash FROM l1 WHERE (SELECT top FROM h0) < 16
  UNION ALL SELECT file, hash FROM l2 WHERE (SELECT top FROM h0) BETWEEN 16 AND 255
  UNION ALL SELECT file, hash FROM l3 WHERE (SELECT top FROM h0) BETWEEN 256 AND 4095
  UNION ALL SELECT file, hash FROM l4 WHERE (SELECT top FROM h0) >= 4096)
SELECT page_id, file, node AS leaf, start, "end", l0.hash AS sha256, roots.hash AS root, corrupt FROM l0 JOIN roots USING (file)
"""
).replace("\\r\\n", "\r\n")


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_top_k": OP1_SQL, "op5_substring_dedup": OP5_SQL, "op9_minhash_near_dedup": OP9_SQL, "op10_merkle_audit": OP10_SQL}
