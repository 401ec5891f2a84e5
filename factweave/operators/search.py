"""Search over symbols: by substring, by name, fuzzy, and by vector; and the joins that derive links from names and code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions import text as X
from factweave.schema import SEARCH_LIMIT, VECTOR_MAX


def symbols_like(facts: DataFrame, text: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """symbol: defined symbols that contain a text regardless of case, by id, at most ``limit``."""
    rows = facts.where("p = 'defines'").select(F.col("o").alias("symbol")).where(F.lower("o").contains(text.lower()))
    return rows.distinct().orderBy("symbol").limit(limit)


def names_like(facts: DataFrame, text: str, limit: int = 10) -> DataFrame:
    rows = facts.where("p = 'defines'").select(F.col("o").alias("symbol")).where(F.lower(X.last_colon_name("o")).contains(text.lower()))
    return rows.distinct().orderBy("symbol").limit(limit)


def fuzzy(corpus: DataFrame, column: str, query: str, limit: int = 10, least: float = 0.3) -> DataFrame:
    """column, score: the closest texts of a corpus, of a score above ``least``."""
    rows = corpus.select(column).distinct().withColumn("score", X.fuzzy_score(query, column)).where(F.col("score") > least)
    return rows.orderBy(F.col("score").desc(), column).limit(limit)


def nearest(vectors: DataFrame, key: str, embedding: str, query: list[float], k: int = 10, least: float | None = None, keep: DataFrame | None = None) -> DataFrame:
    """key, score: the k vectors most similar to one query by cosine; with ``keep`` only among its ids.

    The query is a literal and the ranking a top-k (each task keeps k rows). Null embeddings and those of another length are
    left out; ties go to the smaller id; k is at most 50.
    """
    rows = vectors.where(F.col(embedding).isNotNull()).select(key, embedding)
    if keep is not None:
        rows = rows.join(keep.select(key).distinct(), key, "left_semi")
    score = X.cosine(F.col(embedding), F.array(*(F.lit(float(x)) for x in query)))
    rows = rows.select(key, score.alias("score")).where("score is not null and not isnan(score)")
    if least is not None:
        rows = rows.where(F.col("score") >= least)
    return rows.orderBy(F.col("score").desc(), key).limit(min(k, VECTOR_MAX))


def wired_interfaces(facts: DataFrame, weight: float = 0.8) -> DataFrame:
    """source, target, relation, weight: interfaces and the structs named after them (XImpl, DefaultX), by an equi-join on the derived name."""
    kinds = facts.where("p in ('type', 'has_kind', 'kind')").select("s", F.trim("o").alias("kind"))
    i = kinds.where("kind = 'interface'").select(F.col("s").alias("source"), X.short_name("s").alias("name")).distinct()
    s = kinds.where("kind = 'struct'").select(F.col("s").alias("target"), X.short_name("s").alias("n")).distinct()
    keys = F.array_distinct(F.array(F.regexp_replace("n", "Impl$", ""), F.regexp_replace("n", "^Default", "")))
    named = s.select("target", "n", F.explode(keys).alias("name")).where("name <> n")
    return i.join(named, "name").select("source", "target", F.lit("v:wires_to").alias("relation"), F.lit(weight).alias("weight")).distinct()


def method_calls(texts: DataFrame, facts: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """source, target: files whose text calls .name( and the methods of that name."""
    names = texts.select(F.col(file).alias("source"), F.explode(F.array_distinct(F.regexp_extract_all(content, F.lit(r"\.([A-Za-z0-9_]+)\("), 1))).alias("name"))
    methods = facts.where("p in ('type', 'has_kind', 'kind') and trim(o) = 'method'").select(F.col("s").alias("target"), X.short_name("s").alias("name")).distinct()
    return names.join(methods, "name").select("source", "target").distinct()


def mentions(texts: DataFrame, names: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """source, name: texts that mention one of the names as a word: both sides are cut into words, so it is an equi-join."""
    words = texts.select(F.col(file).alias("source"), F.explode(F.array_distinct(F.regexp_extract_all(content, F.lit(r"([A-Za-z_]\w+)"), 1))).alias("name"))
    return words.join(names.select("name").distinct(), "name", "left_semi").select("source", "name")


def routes(texts: DataFrame, facts: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """route, handler: .GET("path", handler) calls in texts, joined with the symbols of that name."""
    rx = r"\.(?:GET|POST|PUT|DELETE|PATCH|HandleFunc|Handle)\(\s*[\"']([^\"']+)[\"']\s*,\s*(?:\w+\.)*(\w+)"
    found = texts.select(F.explode(F.arrays_zip(F.regexp_extract_all(content, F.lit(rx), 1).alias("route"), F.regexp_extract_all(content, F.lit(rx), 2).alias("name"))).alias("r")).select("r.route", "r.name")
    symbols = facts.where("p = 'defines'").select(F.col("o").alias("handler"), X.short_name("o").alias("name")).distinct()
    return found.join(symbols, "name").select("route", "handler").distinct()


def called_routes(facts: DataFrame) -> DataFrame:
    """source, target, route: references to a route, without the query string, joined with the route's handlers."""
    refs = facts.where("p = 'references'").select(F.col("s").alias("source"), X.clean_route("o").alias("route"))
    handled = facts.where("p = 'handled_by'").select(F.col("s").alias("route"), F.col("o").alias("target"))
    return refs.join(handled, "route").select("source", "target", "route").distinct()


def spread_tags(facts: DataFrame) -> DataFrame:
    """s, p, o: has_tag facts of the symbols of tagged files."""
    tags = facts.where("p = 'has_tag'").select(F.col("s").alias("file"), "o")
    symbols = facts.where("p = 'defines'").select(F.col("s").alias("file"), F.col("o").alias("s"))
    return symbols.join(tags, "file").select("s", F.lit("has_tag").alias("p"), "o").distinct()
