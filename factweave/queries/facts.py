"""Queries of scans, the query language, file graphs and hydration, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import text as X
from factweave.operators import filegraph, hydrate, search
from factweave.operators import graph as G
from factweave.plans import compiler
from factweave.session import table
from factweave.sources import store
from factweave.sources.fixtures import FACTS_CTE, PLANTED_CTE, facts, planted_facts
from factweave.sources.store import FactStore

W = FACTS_CTE
_HUB = "(SELECT o FROM facts WHERE p = 'calls' GROUP BY o ORDER BY count(*) DESC, o LIMIT 1)"
_FILE = "(SELECT s FROM facts WHERE p = 'defines' GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)"


def hub(f: DataFrame) -> str:
    """The most called symbol."""
    return f.where("p = 'calls'").groupBy("o").count().orderBy(F.desc("count"), "o").head()[0]


def caller(f: DataFrame) -> str:
    """The subject that calls most."""
    return f.where("p = 'calls'").groupBy("s").count().orderBy(F.desc("count"), "s").head()[0]


def big_file(f: DataFrame) -> str:
    """The file that defines most."""
    return f.where("p = 'defines'").groupBy("s").count().orderBy(F.desc("count"), "s").head()[0]


_CALLER = "(SELECT s FROM facts WHERE p = 'calls' GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)"
_IMPORTER = "(SELECT s FROM facts WHERE p = 'imports' GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(facts(spark, sf_dir), spark, sf_dir)
        if sql:
            SQL[name] = sql if sql.lstrip().startswith("WITH") else f"{W} {sql}"
        return fn

    return add


def planted(name: str, sql: str):
    """A query on facts and those planted for what refs may lack."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(planted_facts(spark, sf_dir), spark, sf_dir)
        SQL[name] = f"{PLANTED_CTE} {sql}"
        return fn

    return add


def short_sql(x: str) -> str:
    part = f"CASE WHEN strpos({x}, ':') > 0 THEN substr({x}, strpos({x}, ':') + 1) ELSE {x} END"
    return f"CASE WHEN regexp_matches({part}, '[.][^.]+$') THEN regexp_extract({part}, '([^.]+)$', 1) ELSE {part} END"


def file_sql(x: str) -> str:
    return f"split_part({x}, ':', 1)"


def dir_sql(x: str) -> str:
    return f"regexp_extract({x}, '^(.*)/[^/]*$', 1)"


# --- Scans --------------------------------------------------------------------------------------------------------------

query("scan_subject_predicate", f"SELECT s, p, o FROM facts WHERE s = {_FILE} AND p = 'defines'")(lambda f, *_: FactStore(f).scan(s=big_file(f), p="defines").select("s", "p", "o"))
query("scan_topic", "SELECT topic, s, p, o FROM facts WHERE topic = (SELECT min(topic) FROM projects)")(lambda f, spark, d: FactStore(f).scan(topic=table(spark, d, "projects").agg(F.min("topic")).head()[0]).select("topic", "s", "p", "o"))
query("scan_subjects_of_object", f"SELECT DISTINCT s FROM facts WHERE p = 'calls' AND o = {_HUB}")(lambda f, *_: FactStore(f).subjects_of("calls", hub(f)))
query("scan_by_kind", "SELECT s, p, o FROM facts WHERE p = 'calls' AND s IN (SELECT s FROM facts WHERE p IN ('type', 'has_kind', 'kind') AND trim(o) = 'method')")(lambda f, *_: FactStore(f).of_kind("method", "calls").select("s", "p", "o"))
query("scan_listing", f"SELECT row_number() OVER (ORDER BY s, p, o) AS line_no, CASE WHEN row_number() OVER (ORDER BY s, p, o) > 50 THEN '(truncated)' ELSE s || ' --[' || p || ']--> ' || o END AS line FROM (SELECT DISTINCT s, p, o FROM facts WHERE p = 'imports' ORDER BY s, p, o LIMIT 51)")(lambda f, *_: FactStore(f).listing(p="imports").select(F.col("line_no").cast("long").alias("line_no"), "line"))
query("edges_outgoing", f"SELECT DISTINCT p || ' -> ' || o AS edge FROM facts WHERE s = {_CALLER}")(lambda f, *_: FactStore(f).outgoing(caller(f)))
query("edges_incoming", f"SELECT DISTINCT s || ' -> ' || p AS edge FROM facts WHERE o = {_HUB}")(lambda f, *_: FactStore(f).incoming(hub(f)))
query("predicates", "SELECT DISTINCT p FROM facts")(lambda f, *_: FactStore(f).predicates())
query("fact_count", "SELECT count(*) AS n_facts FROM facts")(lambda f, *_: FactStore(f).count())
query("files", "SELECT DISTINCT s AS file FROM facts WHERE p IN ('type', 'has_kind', 'kind') AND trim(o) = 'file'")(lambda f, *_: FactStore(f).files())
query("files_with_prefix", f"SELECT DISTINCT s AS file FROM facts WHERE p IN ('type', 'has_kind', 'kind') AND trim(o) = 'file' AND (starts_with(s, 'atlas-core/pkg') OR starts_with(regexp_extract({dir_sql('s')}, '([^/]*)$', 1), 'atlas-core/pkg'))")(lambda f, *_: FactStore(f).files("atlas-core/pkg"))
planted("entry_points", "SELECT DISTINCT o AS symbol FROM facts WHERE p = 'defines' AND o LIKE '%:main' ORDER BY 1 LIMIT 51")(lambda f, *_: FactStore(f).entry_points())
query("packages", f"SELECT DISTINCT CASE WHEN {dir_sql('s')} = '' THEN 'root' ELSE replace({dir_sql('s')}, '/', '.') END AS package FROM facts WHERE p IN ('type', 'has_kind', 'kind') AND trim(o) = 'file'")(lambda f, *_: FactStore(f).packages())
query("project_stats", f"SELECT (SELECT count(*) FROM facts) AS total_facts, (SELECT count(DISTINCT p) FROM facts) AS n_predicates, n AS n_packages, (SELECT count(*) FROM facts) // greatest(n, 1) AS facts_per_package FROM (SELECT count(DISTINCT CASE WHEN {dir_sql('s')} = '' THEN 'root' ELSE replace({dir_sql('s')}, '/', '.') END) AS n FROM facts WHERE p IN ('type', 'has_kind', 'kind') AND trim(o) = 'file')")(lambda f, *_: FactStore(f).stats())
query("missing_names", f"SELECT DISTINCT topic, o AS s, 'has_name' AS p, {short_sql('o')} AS o FROM facts WHERE p = 'defines' AND NOT EXISTS (SELECT 1 FROM facts g WHERE g.p = 'has_name' AND g.topic = facts.topic AND g.s = facts.o)")(lambda f, *_: FactStore(f).missing_names())
query("delete_file", f"SELECT topic, s, p, o FROM facts WHERE {file_sql('s')} <> {_FILE}")(lambda f, spark, d: FactStore(f).delete_subject(G.nodes_frame(spark, big_file(f)).withColumnRenamed("node", "file")).facts)
query("source_slices", "SELECT node_key, array_to_string(string_split(code, chr(10))[2:4], chr(10)) AS part FROM nodes WHERE code IS NOT NULL")(lambda f, spark, d: table(spark, d, "nodes").where("code is not null").select("node_key", store.source_slice("code", 2, 4).alias("part")))
query("read_content", "SELECT DISTINCT n.s AS id, coalesce(a.content, b.content) AS content FROM (SELECT DISTINCT s FROM facts WHERE p = 'defines') n LEFT JOIN (SELECT node_id AS k, max(code) AS content FROM nodes GROUP BY 1) a ON a.k = n.s LEFT JOIN (SELECT node_id AS k, max(code) AS content FROM nodes GROUP BY 1) b ON b.k = 'atlas-core/' || n.s")(lambda f, spark, d: store.read_content(table(spark, d, "nodes").groupBy(F.col("node_id").alias("doc_id")).agg(F.max("code").alias("content")), f.where("p = 'defines'").select(F.col("s").alias("id")).distinct(), "atlas-core"))

# --- Query language -----------------------------------------------------------------------------------------------------

_LANG = {
    "datalog_pattern": ('triples(?f, "defines", ?sym)', "SELECT DISTINCT s AS f, o AS sym FROM facts WHERE p = 'defines'"),
    "datalog_join": ('triples(?a, "calls", ?b), triples(?b, "calls", ?c), ?a != ?c', "SELECT DISTINCT x.s AS a, x.o AS b, y.o AS c FROM facts x JOIN facts y ON x.o = y.s WHERE x.p = 'calls' AND y.p = 'calls' AND x.s <> y.o"),
    "datalog_three_atoms": ('triples(?f, "defines", ?a), triples(?a, "calls", ?b), triples(?g, "defines", ?b), ?f != ?g', "SELECT DISTINCT d.s AS f, c.s AS a, c.o AS b, e.s AS g FROM facts d JOIN facts c ON d.o = c.s JOIN facts e ON e.o = c.o WHERE d.p = 'defines' AND c.p = 'calls' AND e.p = 'defines' AND d.s <> e.s"),
    "datalog_regex": ('triples(?f, "defines", ?sym), regex(?sym, "Graph|Token$")', "SELECT DISTINCT s AS f, o AS sym FROM facts WHERE p = 'defines' AND regexp_matches(o, 'Graph|Token$')"),
    "datalog_contains": ('defines(?f, ?sym), contains(?sym, "Node"), starts_with(?f, "atlas")', "SELECT DISTINCT s AS f, o AS sym FROM facts WHERE p = 'defines' AND contains(o, 'Node') AND starts_with(s, 'atlas')"),
    "datalog_negation": ('defines(?f, ?sym), not triples(?x, "calls", ?sym)', "SELECT DISTINCT s AS f, o AS sym FROM facts WHERE p = 'defines' AND o NOT IN (SELECT o FROM facts WHERE p = 'calls')"),
    "datalog_comparison": ('triples(?s, "has_line_count", ?n), ?n > 20, ?n =< 60', "SELECT DISTINCT s, o AS n FROM facts WHERE p = 'has_line_count' AND CASE WHEN regexp_full_match(o, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(o AS DOUBLE) > 20 AND CAST(o AS DOUBLE) <= 60 ELSE o > '20' AND o <= '60' END"),
    "datalog_anonymous": ('triples(?f, "calls", _), triples(_, "calls", ?f)', "SELECT DISTINCT s AS f FROM facts WHERE p = 'calls' AND s IN (SELECT o FROM facts WHERE p = 'calls')"),
    "datalog_all_variables": ('triples(?s, ?p, ?o), ?p = "has_tag"', "SELECT DISTINCT s, p, o FROM facts WHERE p = 'has_tag'"),
    "datalog_group_count": ('triples(?f, "defines", ?sym) GROUP BY ?f COUNT(*) AS n ORDER BY n DESC, ?f LIMIT 20', "SELECT s AS f, count(*) AS n FROM (SELECT DISTINCT s, o FROM facts WHERE p = 'defines') GROUP BY 1 ORDER BY n DESC, f LIMIT 20"),
    "datalog_group_numeric": ('triples(?s, "has_line_count", ?n), triples(?s, "has_language", ?l) GROUP BY ?l SUM(?n) AS total, MIN(?n) AS least, MAX(?n) AS most', "SELECT l, coalesce(sum(x), 0) AS total, min(x) AS least, max(x) AS most FROM (SELECT DISTINCT a.s, a.o AS n, b.o AS l, CASE WHEN regexp_full_match(a.o, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(a.o AS DOUBLE) END AS x FROM facts a JOIN facts b ON a.s = b.s WHERE a.p = 'has_line_count' AND b.p = 'has_language') GROUP BY l"),
    "datalog_global_aggregate": ('triples(?a, "calls", ?b) COUNT(*) AS n', "SELECT count(*) AS n FROM (SELECT DISTINCT s, o FROM facts WHERE p = 'calls')"),
    "datalog_order_offset": ('triples(?s, "has_churn", ?n) ORDER BY ?n DESC, ?s OFFSET 5 LIMIT 10', "SELECT s, n FROM (SELECT DISTINCT s, o AS n, CASE WHEN regexp_full_match(o, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(o AS DOUBLE) END AS x FROM facts WHERE p = 'has_churn') ORDER BY x IS NULL DESC, x DESC, n DESC, s LIMIT 10 OFFSET 5"),
    "query_missing_constant": ('triples(?s, "no_such_predicate", ?o)', "SELECT s, o FROM facts WHERE p = 'no_such_predicate'"),
}
for _name, (_text, _sql) in _LANG.items():
    query(_name, _sql)(lambda f, spark, d, text=_text: compiler.compile_query(text, f))

planted("datalog_repeated_variable", "SELECT DISTINCT s AS a FROM facts WHERE p = 'calls' AND s = o")(lambda f, *_: compiler.compile_query('triples(?a, "calls", ?a)', f))
query("datalog_cross", "SELECT DISTINCT a.s AS f, b.o AS l FROM facts a, facts b WHERE a.p = 'has_tag' AND a.o = 'cmd' AND b.p = 'has_language' AND starts_with(b.s, 'atlas-core/pkg')")(lambda f, *_: compiler.compile_query('triples(?f, "has_tag", "cmd"), triples(?x, "has_language", ?l), starts_with(?x, "atlas-core/pkg")', f).select("f", "l").distinct())

# --- Joins that derive links ----------------------------------------------------------------------------------------------

planted("wired_interfaces", f"""SELECT DISTINCT i.s AS source, t.s AS target, 'v:wires_to' AS relation, 0.8::DOUBLE AS weight
FROM (SELECT DISTINCT s, {short_sql('s')} AS n FROM facts WHERE p IN ('type', 'has_kind', 'kind') AND trim(o) = 'interface') i
JOIN (SELECT DISTINCT s, {short_sql('s')} AS n FROM facts WHERE p IN ('type', 'has_kind', 'kind') AND trim(o) = 'struct') t ON (t.n = i.n || 'Impl' OR t.n = 'Default' || i.n)""")(lambda f, *_: search.wired_interfaces(f))
planted("method_calls", f"""SELECT DISTINCT t.source, m.s AS target FROM (SELECT node_id AS source, unnest(list_distinct(regexp_extract_all(code, '[.]([A-Za-z0-9_]+)[(]', 1))) AS name FROM nodes WHERE code IS NOT NULL) t
JOIN (SELECT DISTINCT s, {short_sql('s')} AS name FROM facts WHERE p IN ('type', 'has_kind', 'kind') AND trim(o) = 'method') m USING (name)""")(lambda f, spark, d: search.method_calls(table(spark, d, "nodes").where("code is not null"), f, "node_id", "code"))
query("model_mentions", f"""SELECT DISTINCT t.source, t.name FROM (SELECT node_id AS source, unnest(list_distinct(regexp_extract_all(code, '([A-Za-z_][A-Za-z0-9_]+)', 1))) AS name FROM nodes WHERE code IS NOT NULL) t
JOIN (SELECT DISTINCT {short_sql('s')} AS name FROM facts WHERE p IN ('type', 'has_kind', 'kind') AND trim(o) IN ('struct', 'class')) m USING (name)""")(lambda f, spark, d: search.mentions(table(spark, d, "nodes").where("code is not null"), f.where("p in ('type', 'has_kind', 'kind') and trim(o) in ('struct', 'class')").select(X.short_name("s").alias("name")), "node_id", "code").distinct())
query("spread_tags", "SELECT DISTINCT d.o AS s, 'has_tag' AS p, t.o FROM facts d JOIN facts t ON t.s = d.s WHERE d.p = 'defines' AND t.p = 'has_tag'")(lambda f, *_: search.spread_tags(f))
planted("called_routes", "SELECT DISTINCT r.s AS source, h.o AS target, r.route FROM (SELECT s, split_part(o, '?', 1) AS route FROM facts WHERE p = 'references') r JOIN facts h ON h.p = 'handled_by' AND h.s = r.route")(lambda f, *_: search.called_routes(f))
query("symbol_search", "SELECT DISTINCT o AS symbol FROM facts WHERE p = 'defines' AND contains(lower(o), 'graph') ORDER BY 1 LIMIT 50")(lambda f, *_: search.symbols_like(f, "Graph"))
query("name_search", "SELECT DISTINCT o AS symbol FROM facts WHERE p = 'defines' AND contains(lower(split_part(o, ':', -1)), 'merge') ORDER BY 1 LIMIT 10")(lambda f, *_: search.names_like(f, "merge"))
_NEAR = "1 - levenshtein({0}, 'mergegraph') / greatest(length({0}), 10)"
query("fuzzy_search", f"""{W}, c AS (SELECT DISTINCT o AS symbol, lower(o) AS l FROM facts WHERE p = 'defines'), t AS (SELECT symbol, l, list_filter(string_split_regex(l, '[^a-z0-9]+'), lambda x: x <> '') AS parts, regexp_matches(l, '[a-z0-9]$') AS ends FROM c),
k AS (SELECT symbol, l, list_filter(parts, lambda x, i: length(x) > 2 OR octet_length(encode(l)) < 10 OR (ends AND i = len(parts))) AS toks FROM t),
r AS (SELECT symbol, CASE WHEN l = 'mergegraph' THEN 1.0 WHEN contains(l, 'mergegraph') THEN 0.95 ELSE greatest({_NEAR.format('l')}, coalesce(list_max(list_transform(toks, lambda x: CASE WHEN x = 'mergegraph' THEN 1.0 WHEN contains(x, 'mergegraph') THEN 0.95 ELSE {_NEAR.format('x')} END)), 0)) END AS score FROM k)
SELECT symbol, round(score, 6)::DOUBLE AS score FROM r WHERE score > 0.3 ORDER BY round(score, 6) DESC, symbol LIMIT 10""")(lambda f, *_: search.fuzzy(f.where("p = 'defines'").select(F.col("o").alias("symbol")), "symbol", "mergegraph").withColumn("score", F.round("score", 6)))
_VEC = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL), q AS (SELECT e AS x FROM v WHERE vec_id = 0)"
_COS = "list_inner_product(e, x) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(x, x)))"


def _zero(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").where("vec_id = 0").head()["embedding"])


query("vector_top_k", f"{_VEC} SELECT vec_id, round({_COS}, 5) AS score FROM v, q ORDER BY {_COS} DESC, vec_id LIMIT 10")(lambda f, spark, d: search.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _zero(spark, d), 10).withColumn("score", F.round("score", 5)))
query("vector_threshold", f"{_VEC} SELECT vec_id, round({_COS}, 5) AS score FROM v, q WHERE {_COS} >= 0.2 ORDER BY {_COS} DESC, vec_id LIMIT 20")(lambda f, spark, d: search.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _zero(spark, d), 20, least=0.2).withColumn("score", F.round("score", 5)))
query("vector_with_filter", f"{_VEC} SELECT v.vec_id, round({_COS}, 5) AS score FROM v JOIN embeddings m ON m.vec_id = v.vec_id, q WHERE m.label = 1 ORDER BY {_COS} DESC, v.vec_id LIMIT 10")(lambda f, spark, d: search.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _zero(spark, d), 10, keep=table(spark, d, "embeddings").where("label = 1").select("vec_id")).withColumn("score", F.round("score", 5)))

# --- Files ----------------------------------------------------------------------------------------------------------------

_EDGES = "SELECT DISTINCT s AS src, o AS dst FROM facts WHERE p = 'calls'"
query("file_edges", f"SELECT {file_sql('src')} AS source, {file_sql('dst')} AS target, count(*) AS weight FROM ({_EDGES}) WHERE {file_sql('src')} <> {file_sql('dst')} GROUP BY 1, 2")(lambda f, *_: filegraph.file_edges(G.raw_calls(f).distinct()))
query("file_graph", f"SELECT DISTINCT {file_sql('s')} AS source, {file_sql('o')} AS target, p AS relation FROM facts WHERE {file_sql('s')} = {file_sql(_CALLER)} AND p IN ('defines', 'imports', 'calls') AND {file_sql('s')} <> {file_sql('o')}")(lambda f, *_: filegraph.file_graph(f, caller(f).split(":")[0]))
planted("file_graph_lazy", f"SELECT DISTINCT {file_sql('s')} AS source, {file_sql('o')} AS target, p AS relation FROM facts WHERE {file_sql('s')} = 'planted/lazy.go' AND p IN ('defines', 'imports') AND {file_sql('s')} <> {file_sql('o')}")(lambda f, *_: filegraph.file_graph(f, "planted/lazy.go", lazy=True))
query("file_details", f"SELECT DISTINCT o AS node, s AS parent FROM facts WHERE p = 'defines' AND s = {_FILE}")(lambda f, *_: filegraph.file_details(f, big_file(f))[0])
query("file_internal_calls", "SELECT DISTINCT s AS source, o AS target, 'calls' AS relation FROM facts WHERE p = 'calls' AND " + " AND ".join(f"{c} IN (SELECT o FROM facts WHERE p = 'defines' AND s = {_FILE})" for c in "so"))(lambda f, *_: filegraph.file_details(f, big_file(f))[1])
_FE = f"fe AS (SELECT {file_sql('src')} AS source, {file_sql('dst')} AS target, count(*) AS weight FROM ({_EDGES}) WHERE {file_sql('src')} <> {file_sql('dst')} GROUP BY 1, 2)"
_TOPFILE = "(SELECT source FROM fe GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 1)"


def _top_caller(f: DataFrame) -> str:
    return filegraph.file_edges(G.raw_calls(f).distinct()).groupBy("source").count().orderBy(F.desc("count"), "source").head()[0]


query("file_calls", f"{W}, {_FE}, one AS (SELECT *, 1 AS depth FROM fe WHERE source = {_TOPFILE}) SELECT * FROM one UNION ALL SELECT fe.*, 2 FROM fe WHERE source IN (SELECT target FROM one) AND source <> {_TOPFILE}")(lambda f, *_: filegraph.file_calls(G.raw_calls(f).distinct(), f, _top_caller(f)))
query("file_backbone", f"{W}, {_FE} SELECT {_TOPFILE} AS file, 'center' AS side, 0 AS weight UNION ALL SELECT source, 'upstream', weight FROM fe WHERE target = {_TOPFILE} UNION ALL SELECT target, 'downstream', weight FROM fe WHERE source = {_TOPFILE}")(lambda f, *_: filegraph.file_backbone(G.raw_calls(f).distinct(), _top_caller(f)))
query("backbone", f"SELECT DISTINCT src AS source, dst AS target, 1::BIGINT AS weight FROM ({_EDGES}) WHERE {file_sql('src')} <> {file_sql('dst')}")(lambda f, *_: filegraph.backbone(G.raw_calls(f)))
query("backbone_files", f"SELECT DISTINCT {file_sql('src')} AS source, {file_sql('dst')} AS target, 1::BIGINT AS weight FROM ({_EDGES}) WHERE {file_sql('src')} <> {file_sql('dst')}")(lambda f, *_: filegraph.backbone(G.raw_calls(f), aggregate=True))
_FILES = "files AS (SELECT DISTINCT s AS file FROM facts WHERE p IN ('type', 'has_kind', 'kind') AND trim(o) = 'file')"
query("project_map", f"""{W}, {_FILES}, imp AS (SELECT DISTINCT s AS source, o AS prefix FROM facts WHERE p = 'imports'), pk AS (SELECT DISTINCT prefix FROM imp WHERE prefix NOT IN (SELECT file FROM files)),
ends AS (SELECT DISTINCT s AS file, split_part(replace(trim(o), '.', '/'), '/', -1) AS last FROM facts WHERE p = 'in_package' AND s IN (SELECT file FROM files)),
hits AS (SELECT prefix, file FROM pk JOIN files ON file = prefix OR starts_with(file, prefix || '/') UNION SELECT prefix, file FROM pk JOIN ends ON last = split_part(prefix, '/', -1)),
best AS (SELECT prefix, file FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY file) AS n FROM hits) WHERE n <= 10)
SELECT source, prefix AS target FROM imp WHERE prefix IN (SELECT file FROM files) AND source <> prefix UNION SELECT source, file FROM imp JOIN best USING (prefix) WHERE source <> file""")(lambda f, *_: filegraph.project_map(f))
query("subgraph", f"SELECT DISTINCT s AS source, o AS target, p AS relation FROM facts WHERE s IN (SELECT o FROM facts WHERE p = 'defines' AND s = {_FILE}) OR o IN (SELECT o FROM facts WHERE p = 'defines' AND s = {_FILE})")(lambda f, *_: filegraph.subgraph(f, filegraph.file_details(f, big_file(f))[0]))


def _graph(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    return filegraph.graph_of_rows(f.where("p in ('calls', 'imports')"), "s", "p", "o", f, drop_tests=True)


_LINKS = "links AS (SELECT DISTINCT s AS source, o AS target, p AS relation FROM facts WHERE p IN ('calls', 'imports') AND octet_length(encode(o)) <= 200 AND NOT contains(o, chr(10)) AND NOT contains(s, '_test.go') AND NOT contains(o, '_test.go'))"
_NODES = f"""ids AS (SELECT source AS id FROM links UNION SELECT target FROM links), attr AS (SELECT s, min(CASE WHEN p = 'has_kind' THEN trim(o) END) AS k, min(CASE WHEN p = 'has_language' THEN trim(o) END) AS l FROM facts WHERE p IN ('has_kind', 'has_language') GROUP BY s),
nodes_ AS (SELECT id, split_part(id, '/', -1) AS name, coalesce(k, '') AS kind, coalesce(l, CASE WHEN contains(id, '.go') THEN 'go' WHEN contains(id, '.ts') THEN 'typescript' WHEN contains(id, '.js') THEN 'javascript' WHEN contains(id, '.py') THEN 'python' ELSE '' END) AS language, {file_sql('id')} AS "group" FROM ids LEFT JOIN attr ON s = id)"""
query("graph_links", f"{W}, {_LINKS} SELECT * FROM links")(lambda f, *_: _graph(f)[1])
query("graph_nodes", f"{W}, {_LINKS}, {_NODES} SELECT * FROM nodes_")(lambda f, *_: _graph(f)[0])
query("graph_page_nodes", f"{W}, {_LINKS}, {_NODES} SELECT * FROM nodes_ ORDER BY id LIMIT 100 OFFSET 100")(lambda f, *_: filegraph.page(*_graph(f), 100, 100)[0])
query("graph_page_links", f"{W}, {_LINKS}, {_NODES}, part AS (SELECT id FROM nodes_ ORDER BY id LIMIT 100 OFFSET 100) SELECT * FROM links WHERE source IN (SELECT id FROM part) AND target IN (SELECT id FROM part)")(lambda f, *_: filegraph.page(*_graph(f), 100, 100)[1])

# --- Hydration --------------------------------------------------------------------------------------------------------------

_LINE = lambda c: f"CASE WHEN regexp_full_match({c}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(trunc(CAST({c} AS DOUBLE)) AS INT) END"
_ATTR = "attr AS (SELECT s, " + ", ".join(f"min(CASE WHEN p = '{p}' THEN trim(o) END) AS {p}" for p in ("has_kind", "has_language", "start_line", "end_line")) + " FROM facts GROUP BY s)"
query("hydrate_symbols", f"{W}, {_ATTR} SELECT id, has_kind AS kind, has_language AS language, {_LINE('start_line')} AS start_line, {_LINE('end_line')} AS end_line FROM (SELECT DISTINCT o AS id FROM facts WHERE p = 'defines') LEFT JOIN attr ON s = id")(lambda f, *_: hydrate.shallow(f, f.where("p = 'defines'").select(F.col("o").alias("id")).distinct()))
_START, _END = _LINE("start_line"), _LINE("end_line")
_PART = f"CASE WHEN {_START} > 0 THEN CASE WHEN greatest({_START}, 1) > (CASE WHEN coalesce({_END}, 0) <= 0 THEN len(string_split(whole, chr(10))) ELSE least({_END}, len(string_split(whole, chr(10)))) END) THEN '' ELSE array_to_string(list_slice(string_split(whole, chr(10)), greatest({_START}, 1), CASE WHEN coalesce({_END}, 0) <= 0 THEN len(string_split(whole, chr(10))) ELSE least({_END}, len(string_split(whole, chr(10)))) END), chr(10)) END ELSE whole END"
query("hydrate_content", f"""{W}, {_ATTR}, own AS (SELECT symbol_id AS k, min(symbol_content) AS own FROM symbols GROUP BY 1), whole AS (SELECT node_id AS f, min(code) AS whole FROM nodes WHERE code IS NOT NULL GROUP BY 1)
SELECT id, has_kind AS kind, has_language AS language, {_START} AS start_line, {_END} AS end_line, coalesce(own, {_PART}) AS content FROM (SELECT DISTINCT o AS id FROM facts WHERE p = 'defines') LEFT JOIN attr ON s = id LEFT JOIN own ON k = id LEFT JOIN whole ON f = {file_sql('id')}""")(lambda f, spark, d: hydrate.full(f, f.where("p = 'defines'").select(F.col("o").alias("id")).distinct(), table(spark, d, "symbols").select(F.col("symbol_id").alias("id"), F.col("symbol_content").alias("content")), table(spark, d, "nodes").where("code is not null").select(F.col("node_id").alias("id"), F.col("code").alias("content"))).select("id", "kind", "language", "start_line", "end_line", "content"))
_KNOWN = "(SELECT o FROM facts WHERE p = 'calls' AND o IN (SELECT o FROM facts WHERE p = 'defines') GROUP BY o ORDER BY count(*) DESC, o LIMIT 1)"


def _known(f: DataFrame) -> str:
    """The most called symbol that is defined."""
    return f.where("p = 'calls'").join(f.where("p = 'defines'").select("o").distinct(), "o", "left_semi").groupBy("o").count().orderBy(F.desc("count"), "o").head()[0]


query("hydrate_one_symbol", f"{W} SELECT * FROM ({SQL['hydrate_content'].replace('WITH RECURSIVE', 'WITH', 1)}) WHERE id = {_KNOWN}")(lambda f, spark, d: hydrate.symbol(f, _known(f), "atlas-core", table(spark, d, "symbols").select(F.col("symbol_id").alias("id"), F.col("symbol_content").alias("content")), table(spark, d, "nodes").where("code is not null").select(F.col("node_id").alias("id"), F.col("code").alias("content"))).select("id", "kind", "language", "start_line", "end_line", "content"))
query("node_children", """SELECT id, k.kind, coalesce(n, 0) AS children_count, m.metadata FROM (SELECT DISTINCT s AS id FROM facts WHERE p = 'defines') LEFT JOIN (SELECT s, count(DISTINCT o) AS n FROM facts WHERE p = 'defines' GROUP BY 1) c ON c.s = id
LEFT JOIN (SELECT s, trim(min(o)) AS kind FROM facts WHERE p = 'has_kind' GROUP BY 1) k ON k.s = id LEFT JOIN (SELECT s, string_agg(p || '=' || o, ';' ORDER BY p) AS metadata FROM (SELECT s, p, min(o) AS o FROM facts WHERE p NOT IN ('calls', 'imports', 'defines', 'references') GROUP BY 1, 2) GROUP BY 1) m ON m.s = id""")(lambda f, *_: hydrate.node_metadata(f, f.where("p = 'defines'").select(F.col("s").alias("id")).distinct()).select("id", "kind", "children_count", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("metadata")))
_MINE = f"(SELECT o FROM facts WHERE p = 'defines' AND s = {_FILE})"
query("context_block", f"""SELECT id, relation, node FROM (SELECT *, row_number() OVER (PARTITION BY id, relation ORDER BY node) AS n FROM (
SELECT DISTINCT s AS id, p AS relation, o AS node FROM facts WHERE p IN ('calls', 'defines') AND s IN {_MINE}
UNION SELECT DISTINCT o, 'called_by', s FROM facts WHERE p = 'calls' AND o IN {_MINE})) WHERE n <= 5
UNION ALL SELECT symbol_id, 'content', CASE WHEN length(c) > 2000 THEN substr(c, 1, 2000) || chr(10) || '... (truncated)' ELSE c END FROM (SELECT symbol_id, min(symbol_content) AS c FROM symbols WHERE symbol_id IN {_MINE} AND symbol_content IS NOT NULL GROUP BY 1)""")(lambda f, spark, d: hydrate.context_block(f, filegraph.file_details(f, big_file(f))[0].select(F.col("node").alias("id")), contents=table(spark, d, "symbols").select(F.col("symbol_id").alias("id"), F.col("symbol_content").alias("content"))))
query("manifest_files", "SELECT s AS file, count(DISTINCT o) AS n_symbols FROM facts WHERE p = 'defines' GROUP BY 1")(lambda f, *_: hydrate.manifest(f)[0])
query("manifest_names", f"SELECT {short_sql('o')} AS name, max(o) AS id FROM facts WHERE p = 'defines' GROUP BY 1")(lambda f, *_: hydrate.manifest(f)[1])
query("result_summary", """, r AS (SELECT s, p, o FROM facts WHERE p <> 'has_doc'), total AS (SELECT count(*) AS n FROM r), t AS (SELECT 'o=' || o || ', p=' || p || ', s=' || s AS value FROM r)
SELECT 'predicate' AS kind, value, n FROM (SELECT p AS value, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, value LIMIT 10) UNION ALL SELECT 'subject', value, n FROM (SELECT s AS value, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, value LIMIT 10)
UNION ALL SELECT 'total', NULL, n FROM total UNION ALL SELECT 'sample', value, 1 FROM (SELECT value FROM t ORDER BY value LIMIT (SELECT CASE WHEN n < 50 THEN 49 ELSE 20 END FROM total))""")(lambda f, *_: hydrate.summary(f.where("p <> 'has_doc'").select("s", "p", "o"), "s", "p"))
SQL["result_summary"] = W + SQL["result_summary"][len(W) + 1 :]

# --- Scalar functions over all ids -----------------------------------------------------------------------------------------------

_IDS = "(SELECT DISTINCT o AS id FROM facts WHERE p IN ('defines', 'calls', 'imports'))"
query("id_parts", f"SELECT id, split_part(id, '/', -1) AS base, {dir_sql('id')} AS dir, {file_sql('id')} AS file, {short_sql('id')} AS short FROM {_IDS}")(lambda f, *_: f.where("p in ('defines', 'calls', 'imports')").select(F.col("o").alias("id")).distinct().select("id", X.base_name("id").alias("base"), X.dir_name("id").alias("dir"), X.symbol_file("id").alias("file"), X.short_name("id").alias("short")))
query("guessed_kinds", f"SELECT id, CASE WHEN regexp_matches(n, '^(New|Create|Get|Load)') OR strpos(n, '(') > 1 THEN 'func' WHEN regexp_matches(n, '^[A-Z]') THEN 'struct' ELSE 'symbol' END AS kind FROM (SELECT id, {short_sql('id')} AS n FROM {_IDS})")(lambda f, *_: f.where("p in ('defines', 'calls', 'imports')").select(F.col("o").alias("id")).distinct().select("id", X.guess_kind(X.short_name("id")).alias("kind")))
query("languages_of_ids", f"SELECT id, CASE WHEN contains(id, '.go') THEN 'go' WHEN contains(id, '.ts') THEN 'typescript' WHEN contains(id, '.js') THEN 'javascript' WHEN contains(id, '.py') THEN 'python' ELSE '' END AS language, regexp_matches(id, '[.](go|ts|js|jsx|tsx|py|java|cpp|c|rs|swift|kt|scala|rb|php|cs|vue|svelte|html|css)$') AS is_source FROM {_IDS}")(lambda f, *_: f.where("p in ('defines', 'calls', 'imports')").select(F.col("o").alias("id")).distinct().select("id", X.language_of("id").alias("language"), X.is_source_path("id").alias("is_source")))
query("interface_like", f"SELECT id FROM {_IDS} WHERE regexp_matches(lower(id), '{'|'.join(X.INTERFACE_WORDS)}')")(lambda f, *_: f.where("p in ('defines', 'calls', 'imports')").select(F.col("o").alias("id")).distinct().where(X.is_interface_like("id")))
query("attention_worthy", f"SELECT id FROM (SELECT id, {short_sql('id')} AS n FROM {_IDS}) WHERE regexp_matches(lower(n), '{'|'.join(X.ATTENTION_ANYWHERE)}|^on_|callback$') OR regexp_matches(n, '^({'|'.join(X.ATTENTION_PREFIX)})|({'|'.join(X.ATTENTION_SUFFIX)})$')")(lambda f, *_: f.where("p in ('defines', 'calls', 'imports')").select(F.col("o").alias("id")).distinct().where(X.is_attention_worthy(X.short_name("id"))))
query("file_tags", """SELECT node_id AS file, unnest(list_filter([CASE WHEN regexp_matches(l, '[.](go|py)$') THEN 'backend' END, CASE WHEN regexp_matches(l, '[.](ts|tsx|js|jsx)$') THEN 'frontend' END, CASE WHEN contains(l, 'cmd/') THEN 'cmd' END, CASE WHEN contains(l, 'pkg/') THEN 'pkg' END, CASE WHEN contains(l, 'internal/') THEN 'internal' END,
CASE WHEN contains(l, 'service') THEN 'service' END, CASE WHEN contains(l, 'component') THEN 'component' END, CASE WHEN contains(l, 'hook') THEN 'hook' END, CASE WHEN contains(l, 'util') THEN 'util' END, CASE WHEN contains(l, 'context') THEN 'context' END, CASE WHEN contains(l, 'test') THEN 'test' END, CASE WHEN regexp_matches(l, '[.](tsx|jsx)$') THEN 'ui' END, CASE WHEN l LIKE '%.py' THEN 'python' END], lambda x: x IS NOT NULL)) AS tag
FROM (SELECT DISTINCT node_id, lower(node_id) AS l FROM nodes WHERE node_id IS NOT NULL)""")(lambda f, spark, d: table(spark, d, "nodes").where("node_id is not null").select(F.col("node_id").alias("file")).distinct().select("file", F.explode(X.tags_of("file")).alias("tag")))
query("numbers_of_values", "SELECT DISTINCT o AS value, CASE WHEN regexp_full_match(o, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(o AS DOUBLE) END AS number FROM facts WHERE p IN ('has_line_count', 'has_churn', 'start_line')")(lambda f, *_: f.where("p in ('has_line_count', 'has_churn', 'start_line')").select(F.col("o").alias("value")).distinct().select("value", X.number_of("value").alias("number")))
query("file_hashes", "SELECT node_id AS path, sha256(max(code)) AS hash FROM nodes WHERE code IS NOT NULL AND node_id IS NOT NULL GROUP BY 1")(lambda f, spark, d: table(spark, d, "nodes").where("code is not null and node_id is not null").groupBy(F.col("node_id").alias("path")).agg(F.max("code").alias("code")).select("path", F.sha2("code", 256).alias("hash")))
