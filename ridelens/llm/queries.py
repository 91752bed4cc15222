"""The registered queries of this subpackage and, where SQL can express one, its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.llm.line_dedup import line_dedup_report
from ridelens.llm.lm import context_tree_scores
from ridelens.llm.ann import nearest_neighbours
from ridelens.llm.decontaminate import contaminated
from ridelens.llm.license_scan import scan_licenses
from ridelens.llm.mixing import mix_sources
from ridelens.llm.ngram_join import ngram_jaccard_join
from ridelens.llm.prefix_trie import conversation_trie
from ridelens.llm.quality import classify_quality
from ridelens.llm.spelling import spelling_variants
from ridelens.llm.substring import substring_dedup
from ridelens.llm.token_files import token_round_trip
from ridelens.llm.warc import warc_round_trip
from ridelens.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op2_context_tree_weighting")
def op2_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree_scores(table(spark, sf_dir, "documents"))


@register("op6_weighted_fair_queueing")
def op6_weighted_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("copies")


@register("op9_ngram_jaccard_join")
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


@register("op3_seed_and_extend")
def op3_seed_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


@register("op7_fourier_quality")
def op7_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op10_license_similarity_join")
def op10_license_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("blocks")


@register("op8_projected_kd_tree")
def op8_projected_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f"""


@register("op4_gzip_normaliser", OP4_SQL)
def op4_gzip_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


@register("op5_latent_semantic_retrieval")
def op5_latent_semantic_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op1_minhash_lines")
def op1_minhash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_report(table(spark, sf_dir, "documents"))


# CRC-32 in SQL: the table of 256 entries as one list, applied to a list of bytes.
CRC_TABLE_SQL = """crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM range(256) t(i)))"""


def crc_sql(byte_list: str) -> str:
    return (f"xor(list_reduce([4294967295] || {byte_list}, lambda a, b: xor(tab[CAST(xor(a, b) & 255 AS BIGINT) + 1], a >> 8)), 4294967295)")


OP11_SQL = f"""
WITH {CRC_TABLE_SQL},
rows AS (SELECT conv_id, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS mark, turn,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, mark, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) - 1 AS i FROM rows),
heads AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
    {crc_sql("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))")} % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM rows), crc_table),
parts AS (
  SELECT h.conv_id, 0 AS sec, o.i, o.mark, o.words FROM heads h JOIN own o ON o.conv_id = h.base AND o.i < h.h
  UNION ALL SELECT o.conv_id, 1, o.i, o.mark, o.words FROM own o JOIN heads h ON h.conv_id = o.conv_id AND o.i >= h.h),
numbered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY sec, i) AS depth, mark, words FROM parts),
members AS (
  SELECT conv_id, depth, words, string_agg(mark, '/') OVER (PARTITION BY conv_id ORDER BY depth) || '/' AS path FROM numbered
  UNION ALL SELECT conv_id, 0, 0, '' FROM heads),
lasts AS (SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id),
ends AS (SELECT m.path, sha256(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id)) AS ends_sha256
  FROM members m JOIN lasts l ON l.conv_id = m.conv_id AND l.depth = m.depth GROUP BY m.path),
nodes AS (SELECT path, max(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
    substr(path, 1, greatest(length(path) - 33, 0)) AS parent FROM members GROUP BY path),
children AS (SELECT parent AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
below AS (SELECT substr(n.path, 1, CAST(33 * d AS BIGINT)) AS path, sum((n.n_convs - 1) * n.words) AS saved_tokens,
    sum(CASE WHEN c.path IS NULL THEN 1 ELSE 0 END) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM nodes) n LEFT JOIN children c ON c.path = n.path GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
  CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN below b ON b.path = n.path LEFT JOIN children c ON c.path = n.path LEFT JOIN ends e ON e.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.parent"""


@register("op11_sequence_collapse", OP11_SQL)
def op11_sequence_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = f"""
WITH {CRC_TABLE_SQL},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY 1, 2),
hashed AS (SELECT run, n, {crc_sql("""flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END))""")} AS h
  FROM counted, crc_table),
changed AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT c.word AS a, w.word AS b FROM cuts c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.rest
  UNION SELECT c.word, d.word FROM cuts c JOIN cuts d ON c.i = d.i AND c.rest = d.rest AND c.word <> d.word),
near AS (SELECT a AS word, b AS other, w.n AS other_n, row_number() OVER (PARTITION BY a ORDER BY w.n DESC, encode(b)) AS r,
    count(*) OVER (PARTITION BY a) AS n_near FROM pairs JOIN words w ON w.word = b),
forms AS (SELECT w.word, w.n, coalesce(x.n_near, 0) AS n_near, CASE WHEN x.other_n >= 5 * w.n THEN x.other END AS form,
    CASE WHEN x.other_n >= 5 * w.n THEN x.other_n END AS form_n FROM words w LEFT JOIN near x ON x.word = w.word AND x.r = 1),
chain AS (SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL"""
OP12_SQL = OP12_SQL.replace("WITH crc_table", "WITH RECURSIVE crc_table", 1)


@register("op12_asymmetric_q_chunks", OP12_SQL)
def op12_asymmetric_q_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


@register("op13_parquet_token_lists")
def op13_parquet_token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path
    return token_round_trip(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))
