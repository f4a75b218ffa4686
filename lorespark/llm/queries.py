"""The thin registered queries of the training-data operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, fill_middle, html_text, jaccard_join, lang_id, mixing, packing, pitman_yor, secret_scan, sharding, token_files, top_k, turn_repair
from .common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_bitmask_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.language_of(_table(spark, sf_dir, "documents"))


def op2_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    return out.select("doc_id", "source", size.alias("n_bytes"), F.round("mix_rate", 9).alias("mix_rate"), "mix_copies", "mix_copy", "mix_key")


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(_table(spark, sf_dir, "documents"))


def op4_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.external_shuffle(_table(spark, sf_dir, "documents"), 8, Scratch(spark, "sharding"))
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("bigint")
    return out.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op6_flat_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(_table(spark, sf_dir, "embeddings")).drop("audit_recall")


def op7_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_index(_table(spark, sf_dir, "documents"))


def op8_norm_sorted_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return top_k.top_k(e, e.where("vec_id % 50 = 0"))


def op9_rare_first_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), 3, 9, 10)


def op10_tree_scored_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"), ["page_id", "url"])


def op11_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scores(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(_table(spark, sf_dir, "documents"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_damaged(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_language_bitmask_filters, op2_poisson_mixing, op3_secret_ledger, op4_two_pass_shuffle, op5_certified_packing, op6_flat_graph_dedup, op7_elias_fano_tokens, op8_norm_sorted_top_k, op9_rare_first_jaccard, op10_tree_scored_text, op11_pitman_yor_scores, op12_fill_in_middle, op13_turn_repair)}

_OP6 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
  AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
u AS (SELECT vec_id, label, list_transform(x, lambda e: e / sqrt(list_dot_product(x, x))) AS x FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links,
  least(e.vec_id, coalesce((SELECT min(b) FROM reach WHERE a = e.vec_id), e.vec_id)) AS component_id,
  e.vec_id <= coalesce((SELECT min(b) FROM reach WHERE a = e.vec_id), e.vec_id) AS kept
FROM embeddings e
"""

_OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

_OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM g),
e AS (SELECT doc_id, unnest(s) AS t FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(low.m, n.doc_id)) AS component_id FROM n LEFT JOIN low ON low.a = n.doc_id
"""

ORACLES = {"op2_poisson_mixing": mixing.oracle(), "op6_flat_graph_dedup": _OP6, "op8_norm_sorted_top_k": _OP8, "op9_rare_first_jaccard": _OP9, "op12_fill_in_middle": fill_middle.oracle(), "op13_turn_repair": turn_repair.oracle()}
