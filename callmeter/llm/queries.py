"""The queries of this subpackage and the SQL that says the same, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmeter.llm import chat, decontaminate, divergence, line_runs, manifest, manifest_sql, packing, quality, secrets, sharding, simhash_vp, token_counts, vptree, warc
from callmeter.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vptree.nearest(rows, rows.filter(F.col("vec_id") % 100 == 0), k=10)


#: A text made of control strings, as a conversation of its own.
HOSTILE = "\\### Assistant: </turn> ok"


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], rows.schema)
    return chat.digest(rows.union(own))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("place")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.digest(table(spark, sf_dir, "documents"))


def op10_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica in which records of some pages are overwritten, cut short or lost."""
    pages, i, r = table(spark, sf_dir, "pages"), F.col("page_id"), F.col("record")
    stored = (F.when(i % 101 == 7, F.concat(F.substr(r, F.lit(1), F.char_length(r) - 1), F.lit(" ")))
              .when(i % 211 == 5, F.substr(r, F.lit(1), F.char_length(r) - 10)).otherwise(r))
    return warc.audit(warc.page_leaves(pages), warc.page_leaves(pages, kept=i % 307 != 11, stored=stored))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.proofs(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_quality_classifier, op3_secret_scan, op4_nearest_vectors, op5_packing, op6_chat_format, op7_decontamination, op8_sharding,
    op9_line_dedup, op10_merkle_audit, op11_merkle_manifest, op12_token_counts, op13_source_divergence)}

_STRIP = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op4_nearest_vectors": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.x, v.x) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10""",
    "op6_chat_format": r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, v.turn, v.role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
e AS (SELECT *, length(s) + (length(s) - length(replace(replace(replace(s, '\', ''), '#', ''), ':', '')))
        + (length(s) - length(replace(s, '</turn>', ''))) // 7 AS n
      FROM (SELECT *, unnest([role, text]) AS s FROM m)),
t AS (SELECT conv_id, sum(n) AS n, count(*) // 2 AS turns FROM e GROUP BY conv_id)
SELECT m.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(any_value(t.n) + any_value(t.turns) * 15 AS BIGINT) AS formatted_chars
FROM m JOIN t ON m.conv_id = t.conv_id GROUP BY m.conv_id""",
    "op10_merkle_audit": """
WITH r AS (
  SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS slot, 'WARC/1.1' || e || 'WARC-Type: resource' || e || 'WARC-Date: 1970-01-01T00:00:00Z' || e
    || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e || 'Content-Type: text/html; charset=utf-8' || e
    || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e || coalesce(html, '') || e || e AS record
  FROM pages, (SELECT chr(13) || chr(10) AS e)),
p AS (SELECT *, slot // 1000 AS warc_file, strlen(record) AS length FROM r),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY warc_file ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p),
f AS (SELECT *, CASE WHEN page_id % 307 = 11 THEN NULL WHEN page_id % 101 = 7 THEN record[:-2] || ' ' WHEN page_id % 211 = 5 THEN record[:-11] ELSE record END AS held FROM o)
SELECT CAST(warc_file AS BIGINT) AS warc_file, CAST(start AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length,
  CASE WHEN held IS NULL THEN 'missing' ELSE 'changed' END AS fault, sha256(record) AS expected_sha256, sha256(held) AS found_sha256
FROM f WHERE held IS DISTINCT FROM record""",
    "op11_merkle_manifest": manifest_sql.SQL,
    "op13_source_divergence": rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("coalesce(text, '')")} AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT lang, source, r, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
ln AS (SELECT lang, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (gn.n + v.v) AS p
      FROM gn JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (lc.n + 1) // (ln.n + v.v) AS q FROM lc JOIN ln USING (lang) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
                    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
           ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
own AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM own)
WHERE part = 'pair' OR rank <= 200""",
    "op9_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_STRIP})")} AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, r.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
}
