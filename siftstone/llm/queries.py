"""Queries over the operators of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, html, langid, minhash, packing, sharding, toxicity, urlfilter
from .common import crc_split, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=8)


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.token_matrices(table(spark, sf_dir, "documents"), _tokenizer())


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return found.select("doc_id", (crc_split("doc_id") == 0).alias("held_out"), "score", "predicted")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs), ["doc_id"])
    return found.select("doc_id", (crc_split("doc_id") == 0).alias("held_out"), "lang_pred", "score", "accepted")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.plan_sequences(table(spark, sf_dir, "documents"), _tokenizer(), length=4096, end_id=2)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urlfilter.rule_table(spark, urlfilter.DEFAULT_RULES)
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), rules)


def queries() -> dict[str, Query]:
    return {
        "op1_minhash": op1_minhash,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_token_matrices": op3_token_matrices,
        "op4_sharding": op4_sharding,
        "op5_html_extraction": op5_html_extraction,
        "op6_toxicity": op6_toxicity,
        "op7_language_id": op7_language_id,
        "op8_decontamination": op8_decontamination,
        "op9_packing": op9_packing,
        "op10_url_filters": op10_url_filters,
    }


_OP2_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

_OP10_SQL = """
WITH cut AS (
  SELECT page_id,
         CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


#: Equal word sequences are one set; sets that share a shingle are compared by counting those they share.
_OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
nodes AS (SELECT list_sort(s) AS s, min(doc_id) AS node, any_value(len(s)) AS n FROM sets GROUP BY list_sort(s)),
shingles AS (SELECT node, n, unnest(s) AS x FROM nodes),
links AS (
  SELECT a.node AS u, b.node AS v FROM shingles a JOIN shingles b ON a.x = b.x AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(u, c) AS (SELECT node, node FROM nodes WHERE n > 0 UNION SELECT e.v, r.c FROM reach r JOIN both_ways e ON e.u = r.u),
component AS (SELECT u, min(c) AS c FROM reach GROUP BY u)
SELECT d.doc_id, len(d.s) AS n_shingles, CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE c.c END AS component_id,
       CASE WHEN len(d.s) = 0 THEN true ELSE d.doc_id = c.c END AS kept
FROM sets d JOIN nodes m ON list_sort(d.s) = m.s LEFT JOIN component c ON c.u = m.node
"""


_LEVELS = ", ".join(f"d{k} AS (SELECT a.i, min(greatest(b.c, a.upto - b.upto)) AS c, any_value(a.upto) AS upto FROM sums a JOIN d{k - 1} b ON b.i <= a.i GROUP BY a.i)" for k in range(2, 9))

#: The capacity by dynamic programming over all cuts, then the greedy cuts; CRC-32 from its own table, byte by byte.
_OP4_SQL = f"""
WITH RECURSIVE bits(n, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
rows_ AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, sha256(coalesce(text, '')) AS h, strlen(coalesce(text, '')) + 1 AS size FROM documents),
sums AS (SELECT row_number() OVER (ORDER BY h) AS i, h, sum(s) OVER (ORDER BY h) AS upto FROM (SELECT h, sum(size) AS s FROM rows_ GROUP BY h) UNION ALL SELECT 0, '', 0),
d1 AS (SELECT i, upto AS c, upto FROM sums), {_LEVELS},
best AS (SELECT arg_max(c, i) AS c FROM d8),
cuts(k, i, upto) AS (SELECT 0, 0::BIGINT, 0::HUGEINT UNION ALL SELECT k + 1, (SELECT max(s.i) FROM sums s, best WHERE s.upto - cuts.upto <= best.c), (SELECT max(s.upto) FROM sums s, best WHERE s.upto - cuts.upto <= best.c) FROM cuts WHERE k < 8),
shards AS (SELECT s.h, (SELECT count(*) FROM cuts c WHERE c.k > 0 AND c.i < s.i) AS shard FROM sums s WHERE s.i > 0)
SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::BIGINT)), lambda c, b: xor(c // 256, t[1 + xor(c, b) % 256])), 4294967295) AS text_crc32,
       'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard, h AS text_sha256
FROM rows_ JOIN shards USING (h), crc_table
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": _OP1_SQL, "op4_sharding": _OP4_SQL, "op2_exact_dedup": _OP2_SQL, "op10_url_filters": _OP10_SQL}
