"""Registered queries of the llm operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import credentials, documented, generated, languages, leakage, neighbors, tokens
from factweave.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.find_generated(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "symbols")).select("node_key")


def p1_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.find_generated(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "symbols"))


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented.document_pairs(table(spark, sf_dir, "symbols"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented.document_pairs(table(spark, sf_dir, "symbols")).where("origin = 'own'").select("symbol_key")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = languages.identify(table(spark, sf_dir, "documents"), exclude=table(spark, sf_dir, "eval_items"))
    return found.where("n_langs > 1 or label is null or label <> lang_code").select("doc_id", "lang_code")


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify_segments(table(spark, sf_dir, "documents"), exclude=table(spark, sf_dir, "eval_items"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.similar_pairs(neighbors.most_similar(table(spark, sf_dir, "symbol_vectors")))


def p5_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "symbol_vectors")
    near = neighbors.with_symbols(neighbors.most_similar(vectors), vectors)
    return near.select("vec_id", F.col("near").alias("near_id"), "symbol_id", F.round("score", 4).alias("score"), "rank")


def _both_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_key or symbol_key, the text and the path of its file, of both tables that hold code."""
    nodes = table(spark, sf_dir, "nodes").select(F.lit("nodes").alias("place"), F.col("node_key").alias("row_key"), F.col("code").alias("text"), F.col("node_id").alias("path"))
    symbols = table(spark, sf_dir, "symbols").select(F.lit("symbols").alias("place"), F.col("symbol_key").alias("row_key"), F.col("symbol_content").alias("text"), F.substring_index("symbol_id", ":", 1).alias("path"))
    return nodes.unionByName(symbols)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _both_texts(spark, sf_dir).withColumn("k", F.concat_ws(":", "place", "row_key"))
    found = credentials.find_credentials(rows, "k", "text", "path")
    return found.select(F.substring_index("k", ":", 1).alias("place"), F.substring_index("k", ":", -1).cast("long").alias("row_key"), "start_at")


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _both_texts(spark, sf_dir).withColumn("k", F.concat_ws(":", "place", "row_key"))
    done = credentials.redact(rows, "k", "text", "path")
    return done.select(F.substring_index("k", ":", 1).alias("place"), F.substring_index("k", ":", -1).cast("long").alias("row_key"), "redacted", "n_found")


QUERIES = {"p1_found": p1_found, "p1_files": p1_files, "p2_found": p2_found, "p2_pairs": p2_pairs, "p4_found": p4_found, "p4_redacted": p4_redacted, "p5_found": p5_found, "p5_neighbors": p5_neighbors, "p6_ids": p6_ids, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found, "p8_segments": p8_segments}

_COSINES = """
WITH u AS (SELECT vec_id, min(embedding) AS e, min(symbol_id) AS symbol_id FROM symbol_vectors WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
d AS (SELECT vec_id, symbol_id, CAST(e AS DOUBLE[64]) AS e FROM u),
s AS (SELECT a.vec_id, b.vec_id AS near_id, array_cosine_similarity(a.e, b.e) AS score FROM d a JOIN d b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, near_id) AS rank FROM s)
"""
SQL: dict[str, str] = {
    "p5_found": _COSINES + "SELECT DISTINCT least(vec_id, near_id) AS vec_a, greatest(vec_id, near_id) AS vec_b FROM r WHERE rank <= 5",
    "p5_neighbors": _COSINES + "SELECT r.vec_id, near_id, n.symbol_id, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM r LEFT JOIN (SELECT vec_id, min(symbol_id) AS symbol_id FROM symbol_vectors GROUP BY 1) n ON n.vec_id = near_id WHERE rank <= 5",
}
