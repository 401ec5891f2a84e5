"""Queries of sinks, lookups, merges, named rules and scalar functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import text as X
from factweave.operators import communities, filegraph, search
from factweave.plans import agent, datalog, nl
from factweave.plans.registry import Registry
from factweave.queries.facts import _FILE, big_file, dir_sql, file_sql, short_sql
from factweave.session import table
from factweave.sources import store
from factweave.sources.fixtures import FACTS_CTE, PLANTED_CTE, facts, planted_facts
from factweave.sources.store import FactStore

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, rows=facts, cte: str = FACTS_CTE):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(rows(spark, sf_dir), spark, sf_dir)
        if sql:
            SQL[name] = sql if sql.lstrip().startswith("WITH") else f"{cte} {sql}"
        return fn

    return add


def planted(name: str, sql: str):
    return query(name, sql, planted_facts, PLANTED_CTE)


# --- Sinks and partitions ---------------------------------------------------------------------------------------------

query("facts_about", f"SELECT s, p, o FROM facts WHERE s = {_FILE}")(lambda f, *_: FactStore(f).about(big_file(f)).select("s", "p", "o"))
query("append_facts", "SELECT topic, s, p, o FROM facts UNION SELECT topic, o, 'called_by', s FROM facts WHERE p = 'calls' UNION SELECT topic, s, p, o FROM facts WHERE p = 'imports'")(lambda f, *_: FactStore(f).append(f.where("p = 'calls'").select("topic", F.col("o").alias("s"), F.lit("called_by").alias("p"), F.col("s").alias("o")).unionByName(f.where("p = 'imports'").select("topic", "s", "p", "o"))).facts.select("topic", "s", "p", "o"))
query("retained_refs", "SELECT ref_id, s, p, o FROM (SELECT ref_id, ref_subject AS s, ref_predicate AS p, ref_object AS o, ingested_at FROM refs WHERE ref_subject IS NOT NULL AND ref_predicate IS NOT NULL AND ref_object IS NOT NULL) ORDER BY ingested_at DESC NULLS LAST, s, p, o, ref_id LIMIT 5000")(
    lambda f, spark, d: FactStore(table(spark, d, "refs").where("ref_subject is not null and ref_predicate is not null and ref_object is not null").select("ref_id", F.col("ref_subject").alias("s"), F.col("ref_predicate").alias("p"), F.col("ref_object").alias("o"), "ingested_at")).retain("ingested_at", 5000, tie="ref_id").select("ref_id", "s", "p", "o")
)
query("merged_topics", "SELECT DISTINCT s, p, o FROM facts WHERE topic IN (SELECT topic FROM projects ORDER BY topic LIMIT 2)")(lambda f, spark, d: FactStore(f).merged(*(r[0] for r in table(spark, d, "projects").select("topic").orderBy("topic").limit(2).collect())))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label: one row a vector of embeddings."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label")).dropDuplicates(["vec_id"])


query("upserted_vectors", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN CAST(label AS INT) + 100 ELSE CAST(label AS INT) END AS label FROM embeddings")(lambda f, spark, d: store.merge_table(_vectors(spark, d), _vectors(spark, d).where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100), ["vec_id"]))
query("deleted_vectors", "SELECT vec_id, CAST(label AS INT) AS label FROM embeddings WHERE vec_id % 5 <> 0")(lambda f, spark, d: store.delete_keys(_vectors(spark, d), _vectors(spark, d).where("vec_id % 5 = 0"), ["vec_id"]))

# --- Lookups and merges -------------------------------------------------------------------------------------------------

_SOURCE = f"'[.]({'|'.join(e.lstrip('.') for e in X.SOURCE_EXTENSIONS)})$'"
_HEAD = lambda c: f"CASE WHEN contains({c}, ':') AND regexp_matches(split_part({c}, ':', 1), {_SOURCE}) THEN split_part({c}, ':', 1) END"
planted("symbol_files", f""", t AS (SELECT DISTINCT o AS target FROM facts WHERE p = 'calls' UNION SELECT 'pkg.Render'), def AS (SELECT o AS id, min(s) AS f FROM facts WHERE p = 'defines' GROUP BY 1),
named AS (SELECT n.id, n.short, coalesce({_HEAD('n.id')}, def.f) AS file FROM (SELECT DISTINCT s AS id, o AS short FROM facts WHERE p = 'has_name') n LEFT JOIN def ON def.id = n.id),
best AS (SELECT short, file FROM (SELECT *, row_number() OVER (PARTITION BY short ORDER BY (CASE WHEN contains(id, short) THEN 1 ELSE 0 END) + (CASE WHEN length(id) < 50 THEN 1 ELSE 0 END) DESC, id) AS n FROM named WHERE file IS NOT NULL) WHERE n = 1)
SELECT target, coalesce({_HEAD('target')}, def.f, best.file) AS file FROM t LEFT JOIN def ON def.id = target LEFT JOIN best ON best.short = split_part(target, '.', -1)""")(lambda f, spark, d: filegraph.symbol_files(f, f.where("p = 'calls'").select(F.col("o").alias("target")).unionByName(spark.createDataFrame([("pkg.Render",)], "target string"))))
query("project_files_of_imports", """SELECT DISTINCT o AS path, CASE WHEN starts_with(o, 'internal') THEN CASE WHEN starts_with(o, 'internal/') THEN substr(o, 10) ELSE o END WHEN len(string_split(o, '/')) >= 3 AND contains(o, 'internal') THEN array_to_string(string_split(o, '/')[2:], '/') ELSE '' END AS file FROM facts WHERE p = 'imports'""")(lambda f, *_: f.where("p = 'imports'").select(F.col("o").alias("path")).distinct().select("path", filegraph.project_file_of("path", "internal").alias("file")))
query("internal_nodes", f"SELECT id, {file_sql('id')} IN (SELECT node_id FROM nodes WHERE length(code) > 0) OR starts_with(id, 'atlas-core/pkg') AS is_internal FROM (SELECT DISTINCT o AS id FROM facts WHERE p IN ('calls', 'imports', 'defines'))")(
    lambda f, spark, d: filegraph.internal_nodes(f.where("p in ('calls', 'imports', 'defines')").select(F.col("o").alias("id")).distinct(), table(spark, d, "nodes").select(F.col("node_id").alias("doc_id"), F.col("code").alias("content")), ("atlas-core/pkg",))
)
query("enriched_nodes", """SELECT id, coalesce(k.kind, '') AS kind, g.package, coalesce(t.tags, '') AS tags, c.code FROM (SELECT DISTINCT s AS id FROM facts WHERE p = 'defines') LEFT JOIN (SELECT s, min(trim(o)) AS kind FROM facts WHERE p = 'has_kind' GROUP BY 1) k ON k.s = id
LEFT JOIN (SELECT s, min(trim(o)) AS package FROM facts WHERE p = 'in_package' GROUP BY 1) g ON g.s = id LEFT JOIN (SELECT s, string_agg(o, ',' ORDER BY o) AS tags FROM (SELECT DISTINCT s, o FROM facts WHERE p = 'has_tag') GROUP BY 1) t ON t.s = id LEFT JOIN (SELECT node_id, min(code) AS code FROM nodes GROUP BY 1) c ON c.node_id = id""")(
    lambda f, spark, d: filegraph.enriched_nodes(f.where("p = 'defines'").select(F.col("s").alias("id")).distinct(), f, table(spark, d, "nodes").select(F.col("node_id").alias("id"), F.col("code").alias("content"))).withColumn("tags", F.array_join("tags", ","))
)


def _two_graphs(f: DataFrame, *_) -> DataFrame:
    """The links of the call graph and of the graph of calls and imports, each link once."""
    a, b = (filegraph.graph_of_rows(f.where(c), "s", "p", "o", f)[1] for c in ("p = 'calls'", "p in ('calls', 'imports')"))
    return filegraph.merge_graphs(a, b, ["source", "target", "relation"])


query("merged_links", "SELECT DISTINCT s AS source, o AS target, p AS relation FROM facts WHERE p IN ('calls', 'imports') AND octet_length(encode(o)) <= 200 AND NOT contains(o, chr(10))")(_two_graphs)
_VEC = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL), q AS (SELECT e AS x FROM v WHERE vec_id = 1)"
_COS = "list_inner_product(e, x) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(x, x)))"
query("hybrid_clusters", f"{_VEC} SELECT vec_id, CAST((n - 1) % 4 AS INT) AS cluster FROM (SELECT vec_id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS n FROM v, q) WHERE n <= 30")(
    lambda f, spark, d: communities.round_robin(search.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", list(table(spark, d, "embeddings").where("vec_id = 1").head()["embedding"]), 30), [F.col("score").desc(), F.col("vec_id")], 4).select("vec_id", "cluster")
)

# --- Named rules, builders, questions, plans -------------------------------------------------------------------------------

for _name, _sql, _values in (
    ("find_defines", f"SELECT DISTINCT o AS symbol FROM facts WHERE p = 'defines' AND s = {_FILE}", True), ("smell_imports", "SELECT DISTINCT s AS file, o AS package FROM facts WHERE p = 'imports'", False), ("smell_defines", "SELECT DISTINCT s AS file, o AS symbol FROM facts WHERE p = 'defines'", False),
):
    query(f"registry_{_name}", _sql)(lambda f, *_, name=_name, values=_values: Registry().execute(name, f, {"file": big_file(f)} if values else None))
query("built_defines", f"SELECT DISTINCT o AS symbol FROM facts WHERE p = 'defines' AND s = {_FILE}")(lambda f, *_: datalog_rows(f, datalog.defines_of(big_file(f))))
query("built_internal_calls", f"SELECT DISTINCT s AS \"from\", o AS \"to\" FROM facts WHERE p = 'calls' AND s IN (SELECT o FROM facts WHERE p = 'defines' AND s = {_FILE}) AND o IN (SELECT o FROM facts WHERE p = 'defines' AND s = {_FILE})")(lambda f, *_: datalog_rows(f, datalog.internal_calls(big_file(f))))
query("built_in_package", "SELECT DISTINCT s FROM facts WHERE p = 'in_package' AND o = (SELECT o FROM facts WHERE p = 'in_package' GROUP BY o ORDER BY count(*) DESC, o LIMIT 1)")(lambda f, *_: datalog_rows(f, datalog.in_package(f.where("p = 'in_package'").groupBy("o").count().orderBy(F.desc("count"), "o").head()[0])))
query("built_outgoing", f"SELECT DISTINCT p, o FROM facts WHERE s = {_FILE}")(lambda f, *_: datalog_rows(f, datalog.outgoing(big_file(f))))
query("built_with_tag", "SELECT DISTINCT s FROM facts WHERE p = 'has_tag' AND o = 'backend'")(lambda f, *_: datalog_rows(f, datalog.with_tag("backend")))
planted("built_handlers", "SELECT DISTINCT o AS handler FROM facts WHERE p = 'handled_by' AND s = '/api/items'")(lambda f, *_: datalog_rows(f, datalog.handlers_of("/api/items")))
planted("built_of_type", "SELECT DISTINCT s FROM facts WHERE p = 'type' AND o = 'file'")(lambda f, *_: datalog_rows(f, datalog.of_type("file")))
query("question_callers", "SELECT DISTINCT s AS caller FROM facts WHERE p = 'calls' AND o = 'fmt.Errorf'")(lambda f, *_: datalog_rows(f, nl.to_query(nl.classify("Who calls fmt.Errorf?"), [])[0]))
query("orient", None)(lambda f, *_: agent.orient(f, f.where("p = 'calls'").select(F.col("o").alias("symbol_id"))))


def datalog_rows(f: DataFrame, q) -> DataFrame:
    from factweave.plans.compiler import compile_query

    return compile_query(str(q), f).distinct()


# --- Scalar functions -----------------------------------------------------------------------------------------------------

_IDS = "(SELECT DISTINCT o AS id FROM facts WHERE p IN ('defines', 'calls', 'imports'))"
query("link_keys", f"SELECT s || '->' || o AS link, s || '-' || p || '-' || o AS triple, '\"' || s || '\"' AS quoted FROM facts WHERE p IN ('calls', 'imports')")(lambda f, *_: f.where("p in ('calls', 'imports')").select(X.link_key("s", "o").alias("link"), X.triple_link_key("s", "p", "o").alias("triple"), X.quote_path("s").alias("quoted")))
query("source_paths", f"SELECT id FROM {_IDS} WHERE regexp_matches(id, {_SOURCE})")(lambda f, *_: f.where("p in ('defines', 'calls', 'imports')").select(F.col("o").alias("id")).distinct().where(X.is_source_path("id")))


def _stdlib(language: str, x: str) -> str:
    calls, packages = X.STDLIB[language]
    hit = f"{x} IN ({', '.join(repr(c) for c in calls.split())})"
    return f"({hit} OR contains({x}, '.') AND split_part({x}, '.', 1) IN ({', '.join(repr(p) for p in packages.split())}))" if packages else hit


query("library_calls", "SELECT DISTINCT o AS callee, " + ", ".join(f"{_stdlib(x, 'o')} AS {x}" for x in X.STDLIB) + " FROM facts WHERE p = 'calls'")(lambda f, *_: f.where("p = 'calls'").select(F.col("o").alias("callee")).distinct().select("callee", *(X.is_stdlib_call("callee", F.lit(x)).alias(x) for x in X.STDLIB)))
query("embed_texts", "SELECT symbol_key, array_to_string(list_filter([symbol_name, doc_comment, substr(symbol_content, 1, 500)], lambda x: x <> ''), chr(10) || '---' || chr(10)) AS text FROM symbols WHERE symbol_content IS NULL OR octet_length(encode(symbol_content)) = length(symbol_content)")(lambda f, spark, d: table(spark, d, "symbols").where("symbol_content is null or octet_length(symbol_content) = length(symbol_content)").select("symbol_key", X.embed_text("symbol_name", "doc_comment", "symbol_content").alias("text")))
query("potential_symbols", r"SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b([A-Za-z][A-Za-z0-9_./]{3,})\b', 1)) AS word FROM documents WHERE regexp_matches(text, '^[ -~\s]*$'))")(lambda f, spark, d: table(spark, d, "documents").where(F.col("text").rlike(r"\A[ -~\s]*\z")).select("doc_id", F.explode(X.potential_symbols("text")).alias("word")).distinct())
query("global_topics", "SELECT DISTINCT topic, (topic & 8388608) = 0 AS is_global FROM facts")(lambda f, *_: f.select("topic").distinct().select("topic", X.is_global("topic").alias("is_global")))
query("fact_texts", f"SELECT DISTINCT {dir_sql('s')} AS dir, {short_sql('o')} AS name FROM facts WHERE p = 'has_test'")(lambda f, *_: f.where("p = 'has_test'").select(X.dir_name("s").alias("dir"), X.short_name("o").alias("name")).distinct())
