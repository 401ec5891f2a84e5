"""Inputs that no table of the driver has: facts that the rule library reads, derived from the symbols of refs.

The same specification is written as Spark SQL and as the oracle's SQL. Every value follows from the first six digits of the MD5 of
the symbol's id, so both engines derive the same facts at every scale.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factweave.operators.graph import resolve_calls
from factweave.session import scratch_path, table
from factweave.sources.store import facts_of_refs, store_by_predicate

PATTERNS = "sql_concatenation raw_sql_query html_injection dom_manipulation hardcoded_password hardcoded_api_key hardcoded_token hardcoded_secret eval_execution unsafe_deserialization command_injection md5_hash sha1_hash weak_random god_class long_method deep_nesting magic_number nested_loop repeated_computation inefficient_data_structure".split()


def _pick(names: list[str], start: int = 0) -> str:
    return "CASE h % 29 " + " ".join(f"WHEN {start + i} THEN '{n}'" for i, n in enumerate(names)) + " END"


def _n(prefix: str, mod: int) -> str:
    return f"'{prefix}' || CAST(h % {mod} AS STRING)"


# (subject, predicate, object, condition); subjects and objects are SQL over s (the symbol) and h (its hash).
SPECS = [
    ("s", "has_pattern", _pick(PATTERNS), f"h % 29 < {len(PATTERNS)}"), ("s", "has_sanitization", "'true'", "h % 7 = 0"), ("s", "handles_method", "CASE h % 3 WHEN 0 THEN 'POST' WHEN 1 THEN 'PUT' ELSE 'GET' END", "h % 2 = 0"), ("s", "has_csrf_protection", "'true'", "h % 5 = 0"), ("s", "has_authorization", "'true'", "h % 3 = 0"),
    ("s", "has_role", "'api_handler'", "h % 7 = 1"), ("s", "handles_endpoint", _n("/api/e", 40), "h % 7 = 1"), ("s", "has_complexity", "CASE h % 11 WHEN 0 THEN 'O(n^2)' WHEN 1 THEN 'O(n^3)' WHEN 2 THEN 'O(2^n)' ELSE 'O(n)' END", "h % 4 = 0"), ("s", "is_expensive", "'true'", "h % 13 = 0"),
    ("s", "has_duplicate", _n("dup", 90), "h % 9 = 0"), ("'dup' || CAST(h % 90 AS STRING)", "similarity_score", "CAST((50 + h % 90 % 50) / 100.0 AS STRING)", "h % 9 = 0"), ("s", "has_doc_comment", "'true'", "h % 3 = 1"), ("s", "has_api_documentation", "'true'", "h % 6 = 1"), ("s", "has_integration_test", "'true'", "h % 4 = 1"),
    ("s", "follows_naming_convention", "'true'", "h % 5 <> 2"), ("s", "can_return_error", "'true'", "h % 5 = 3"), ("s", "handles_error", _n("err", 30), "h % 8 = 0"), ("'err' || CAST(h % 30 AS STRING)", "has_pattern", "'bare_return'", "h % 8 = 0 AND h % 30 < 10"),
    ("s", "allocates_memory", _n("mem", 5), "h % 3 = 0"), ("s", "deallocates_memory", _n("mem", 5), "h % 6 = 0"), ("s", "opens_resource", _n("res", 4), "h % 5 = 0"), ("s", "closes_resource", _n("res", 4), "h % 10 = 0"), ("s", "creates_goroutine", "'g'", "h % 11 = 0"), ("s", "waits_for_goroutine", "'g'", "h % 22 = 0"),
    ("s", "accesses_shared_state", _n("st", 6), "h % 6 = 1"), ("s", "uses_lock", _n("st", 6), "h % 12 = 1"), ("s", "acquires_lock", _n("lock", 3), "h % 4 = 2"), ("s", "acquires_lock", "'lock9'", "h % 8 = 2"), ("s", "releases_lock", _n("lock", 3), "h % 8 = 6"), ("s", "acquires_locks_in_order", "'true'", "h % 16 = 2"),
    ("s", "executes_query", _n("query", 60), "h % 10 = 4"), ("'query' || CAST(h % 60 AS STRING)", "has_pattern", "CASE h % 60 % 4 WHEN 0 THEN 'n_plus_one' WHEN 1 THEN 'missing_index' WHEN 2 THEN 'full_table_scan' ELSE 'fine' END", "h % 10 = 4"), ("s", "makes_request", _n("req", 50), "h % 9 = 5"), ("'req' || CAST(h % 50 AS STRING)", "has_pattern", "'sequential_requests'", "h % 9 = 5 AND h % 50 < 20"), ("'req' || CAST(h % 50 AS STRING)", "uses_cache", "'true'", "h % 9 = 5 AND h % 50 > 30"),
    ("s", "reads_file", _n("file", 7), "h % 7 = 3"), ("s", "uses_buffering", _n("file", 7), "h % 14 = 3"), ("s", "creates_temp_file", "'t'", "h % 15 = 3"), ("s", "cleans_up_temp_file", "'t'", "h % 30 = 3"), ("s", "has_branch", _n("branch", 80), "h % 6 = 5"), ("'branch' || CAST(h % 80 AS STRING)", "is_reachable", "CASE WHEN h % 80 < 60 THEN 'true' ELSE 'false' END", "h % 6 = 5"),
    ("s", "has_type", _n("type", 4), "h % 5 = 2"), ("s", "assigns_value", _n("val", 12), "h % 10 = 2"), ("'val' || CAST(h % 12 AS STRING)", "has_type", "'type' || CAST(h % 12 % 5 AS STRING)", "h % 10 = 2"), ("s", "requires_type", _n("type", 3), "h % 12 = 6"), ("s", "passes_argument", _n("val", 12), "h % 20 = 7"),
    ("s", "accesses_field", _n("field", 9), "h % 5 = 4"), ("'field' || CAST(h % 9 AS STRING)", "can_be_null", "CASE WHEN h % 9 < 5 THEN 'true' ELSE 'false' END", "h % 5 = 4"), ("s", "checks_null", _n("field", 9), "h % 15 = 4"), ("s", "returns_null", "'true'", "h % 14 = 5"), ("s", "checks_return_null", "'true'", "h % 3 = 2"),
    ("s", "has_precondition", _n("pre", 5), "h % 8 = 3"), ("s", "validates_precondition", _n("pre", 5), "h % 24 = 3"), ("s", "has_postcondition", _n("post", 5), "h % 8 = 4"), ("s", "ensures_postcondition", _n("post", 5), "h % 16 = 4"), ("s", "implements_interface", _n("iface", 6), "h % 9 = 1"), ("'iface' || CAST(h % 6 AS STRING)", "requires_method", _n("m", 12), "h % 9 = 1"), ("s", "implements_method", _n("m", 12), "h % 9 = 1 OR h % 4 = 1"),
    ("s", "uses_schema", _n("schema", 5), "h % 10 = 4"), ("'schema' || CAST(h % 5 AS STRING)", "has_field", _n("field", 9), "h % 20 = 4"), ("s", "has_state", _n("state", 8), "h % 11 = 3"), ("'state' || CAST(h % 8 AS STRING)", "transitions_to", _n("state", 10), "h % 11 = 3"), ("'state' || CAST(h % 8 AS STRING)", "is_valid_state", "'true'", "h % 11 = 3 AND h % 8 < 6"), ("'state' || CAST(h % 8 AS STRING)", "requires_guard", _n("guard", 4), "h % 22 = 3"), ("'state' || CAST(h % 8 AS STRING)", "has_guard", _n("guard", 4), "h % 33 = 3"), ("'guard' || CAST(h % 4 AS STRING)", "is_satisfied", "'true'", "h % 4 < 2"),
    ("s", "has_specification", _n("spec", 6), "h % 12 = 5"), ("'spec' || CAST(h % 6 AS STRING)", "has_property", _n("prop", 10), "h % 24 = 5"), ("s", "satisfies_property", _n("prop", 10), "h % 12 = 5"), ("s", "has_invariant", _n("inv", 4), "h % 13 = 6"), ("s", "maintains_invariant", _n("inv", 4), "h % 26 = 6"),
    ("s", "has_quality_metric", _n("metric", 70), "h % 17 = 0"), ("'metric' || CAST(h % 70 AS STRING)", "has_timestamp", "'2031-01-' || CAST(10 + h % 70 % 19 AS STRING)", "h % 17 = 0"), ("'metric' || CAST(h % 70 AS STRING)", "has_value", "CAST(h % 70 * 3 AS STRING)", "h % 17 = 0"), ("'metric' || CAST(h % 70 AS STRING)", "has_trend", "CASE h % 70 % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'flat' END", "h % 17 = 0"),
    ("s", "is_critical", "'true'", "h % 31 = 0"), ("s", "uses_type", _n("type", 4), "h % 21 = 0"),
    ("s", "has_impact_metric", _n("metric", 70), "h % 17 = 0"), ("s", "has_performance_metric", _n("metric", 70), "h % 17 = 0"), ("'metric' || CAST(h % 70 AS STRING)", "has_history", "'history' || CAST(h % 70 AS STRING)", "h % 17 = 0"), ("'history' || CAST(h % 70 AS STRING)", "trend", "CASE h % 70 % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'flat' END", "h % 17 = 0"),
    # A file that imports and defines too much, a hub, a ring of calls with a way out, and an interface that is fully implemented.
    ("'planted/god.go'", "imports", _n("dep", 80), "h % 2 = 0"), ("'planted/god.go'", "defines", _n("planted/god.go:F", 45), "h % 2 = 1"), ("'planted/hub.go'", "defines", "'planted/hub.go:Hub'", "h % 2 = 0"), ("'planted/hub.go:Hub'", "calls", _n("planted/out.go:c", 15), "h % 2 = 0"), (_n("planted/in.go:d", 15), "calls", "'planted/hub.go:Hub'", "h % 2 = 1"),
    ("'planted/ring.go'", "defines", _n("planted/ring.go:R", 5), "h % 2 = 0"), (_n("planted/ring.go:R", 5), "calls", "'planted/ring.go:R' || CAST((h + 1) % 5 AS STRING)", "h % 2 = 0"), (_n("planted/user.go:U", 30), "calls", _n("planted/ring.go:R", 5), "h % 3 = 0"), ("'planted/user.go'", "defines", _n("planted/user.go:U", 30), "h % 3 = 0"), (_n("planted/ring.go:R", 5), "calls", "'planted/hub.go:Hub'", "h % 5 = 3"), ("'planted/user.go'", "belongs_to_service", "'service-planted'", "h % 2 = 0"), (_n("planted/user.go:U", 30), "has_test", _n("planted/user_test.go:T", 10), "h % 3 = 0"), (_n("planted/out.go:c", 15), "is_critical", "'true'", "h % 15 = 1"),
    ("s", "implements_interface", "'ifacex'", "h % 10 = 7"), ("'ifacex'", "requires_method", _n("mx", 2), "h % 10 = 7"), ("s", "implements_method", "'mx0'", "h % 10 = 7"), ("s", "implements_method", "'mx1'", "h % 20 = 7"),
]
#: Facts about files and imported things, over s (a file or imported id) and h.
FILE_SPECS = [
    ("s", "belongs_to_service", _n("service", 5), "h % 4 <> 0"), ("'project' || CAST(h % 6 AS STRING)", "has_file", "s", "h % 2 = 0"), ("s", "is_unused", "'true'", "h % 9 = 0"), ("s", "is_deprecated", "'true'", "h % 12 = 0"), ("s", "has_cve", _n("CVE-", 15), "h % 20 = 1"), ("'CVE-' || CAST(h % 15 AS STRING)", "severity", "CASE h % 15 % 2 WHEN 0 THEN 'High' ELSE 'Critical' END", "h % 20 = 1"),
]


#: Facts of which refs may have none, so that no query is only ever checked on an empty result: (subject, predicate, object).
PLANTED = [
    ("planted/main.go", "defines", "planted/main.go:main"), ("planted/loop.go:Again", "calls", "planted/loop.go:Again"), ("planted/store.go:Store", "has_kind", "interface"), ("planted/impl.go:StoreImpl", "has_kind", "struct"), ("planted/impl.go:DefaultStore", "has_kind", "struct"), ("planted/other.go:Storekeeper", "has_kind", "struct"),
    ("planted/list.py:List.append", "has_kind", "method"), ("planted/list.py:List.join", "has_kind", "method"), ("planted/conn.go:Conn.Close", "has_kind", "method"), ("/api/items", "handled_by", "planted/http.go:Items"), ("planted/load.ts:load", "references", "/api/items?page=2"), ("planted/load.ts:more", "references", "/api/other"),
    ("planted/lazy.go", "imports", "planted/store.go"), ("planted/lazy.go", "imports", "planted/impl.go"), ("planted/lazy.go", "defines", "planted/lazy.go:L"), ("planted/lazy.go:L", "calls", "planted/main.go:main"), ("planted/models.go", "in_package", "app.models"), ("planted/named.go:Render", "has_name", "Render"), ("planted/other/named.go:Deep.Render", "has_name", "Render"),
]


def _union(specs: list[tuple[str, str, str, str]], source: str) -> str:
    return " UNION ALL ".join(f"SELECT {s} AS s, '{p}' AS p, {o} AS o FROM {source} WHERE {c}" for s, p, o, c in specs)


_FACTS = "SELECT DISTINCT topic, ref_subject AS s, lower(trim(ref_predicate)) AS p, ref_object AS o FROM refs WHERE ref_subject IS NOT NULL AND ref_predicate IS NOT NULL AND ref_object IS NOT NULL"
#: The oracle's common tables: facts (of refs), and the derived ones.
FACTS_CTE = f"WITH RECURSIVE facts AS ({_FACTS})"
RULES_CTE = f"""{FACTS_CTE},
named AS (SELECT DISTINCT o AS s, CAST('0x' || substr(md5(o), 1, 6) AS BIGINT) AS h FROM facts WHERE p = 'defines'),
things AS (SELECT DISTINCT x AS s, CAST('0x' || substr(md5(x), 1, 6) AS BIGINT) AS h FROM (SELECT s AS x FROM facts WHERE p IN ('defines', 'imports') UNION SELECT o FROM facts WHERE p = 'imports')),
rf AS (SELECT s, p, o FROM facts UNION SELECT * FROM ({_union(SPECS, 'named')}) UNION SELECT * FROM ({_union(FILE_SPECS, 'things')}))"""


PLANTED_CTE = f"{FACTS_CTE.replace('facts AS (', 'facts AS (SELECT topic, s, p, o FROM (', 1)[:-1]}) UNION SELECT 0, s, p, o FROM (VALUES {', '.join(map(str, PLANTED))}) v(s, p, o))"
#: Calls with their callees resolved, as the engine keeps them: src, dst.
_SHORT = "CASE WHEN regexp_matches({0}, '[.][^.]+$') THEN regexp_extract({0}, '([^.]+)$', 1) ELSE {0} END".format("CASE WHEN strpos(o, ':') > 0 THEN substr(o, strpos(o, ':') + 1) ELSE o END")
_DIR = "regexp_extract(split_part({0}, ':', 1), '^(.*)/[^/]*$', 1)"
EDGES_CTE = f"""{FACTS_CTE}, raw_ AS (SELECT DISTINCT s AS src, o AS dst FROM facts WHERE p = 'calls'), sym_ AS (SELECT DISTINCT o AS sym, {_SHORT} AS short, {_DIR.format('o')} AS dir FROM facts WHERE p = 'defines'),
open_ AS (SELECT src, dst, {_DIR.format('src')} AS dir, split_part(split_part(dst, '/', -1), '.', -1) AS short, CASE WHEN contains(dst, '.') THEN split_part(dst, '.', 1) END AS pkg FROM raw_ WHERE dst NOT IN (SELECT sym FROM sym_)),
of_pkg_ AS (SELECT w.short, w.pkg, min(sym) AS sym FROM (SELECT DISTINCT short, pkg FROM open_ WHERE pkg IS NOT NULL) w JOIN sym_ ON sym_.short = w.short AND contains(sym, pkg) GROUP BY 1, 2), of_dir_ AS (SELECT short, dir, min(sym) AS sym FROM sym_ GROUP BY 1, 2), of_name_ AS (SELECT short, min(sym) AS sym FROM sym_ GROUP BY 1),
e AS MATERIALIZED (SELECT src, dst FROM raw_ WHERE dst IN (SELECT sym FROM sym_) UNION SELECT src, coalesce(a.sym, b.sym, c.sym, dst) FROM open_ LEFT JOIN of_pkg_ a ON a.short = open_.short AND a.pkg = open_.pkg LEFT JOIN of_dir_ b ON b.short = open_.short AND b.dir = open_.dir LEFT JOIN of_name_ c ON c.short = open_.short)"""


_stored: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made once per application and folder, facts partitioned by predicate, and then only read."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path, rows = scratch_path(spark, name), make()
        if "p" in rows.columns:
            store_by_predicate(rows, path)
        else:
            rows.write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of refs."""
    return _once(spark, sf_dir, "facts", lambda: facts_of_refs(table(spark, sf_dir, "refs"))).select("topic", "s", "p", "o")


def planted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """facts and PLANTED."""
    more = spark.createDataFrame(PLANTED, "s string, p string, o string").selectExpr("0 AS topic", "s", "p", "o")
    return facts(spark, sf_dir).unionByName(more).distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: the resolved call graph, made once as the engine does."""
    return _once(spark, sf_dir, "edges", lambda: resolve_calls(facts(spark, sf_dir)).repartitionByRange("src").sortWithinPartitions("src")).select("src", "dst")


_asked: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]) -> object:
    """A parameter of queries (such as the symbol asked about), found once per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _asked:
        _asked[key] = make()
    return _asked[key]


def rule_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """facts plus the derived ones, as s, p, o."""
    return _once(spark, sf_dir, "rule_facts", lambda: _rule_facts(facts(spark, sf_dir))).select("s", "p", "o")


def _rule_facts(base: DataFrame) -> DataFrame:
    """One pass over each set of ids: the specifications are an exploded array."""
    h = "CAST(conv(substr(md5(s), 1, 6), 16, 10) AS BIGINT) AS h"

    def derive(ids: DataFrame, specs: list[tuple[str, str, str, str]]) -> DataFrame:
        rows = ", ".join(f"CASE WHEN {c} THEN named_struct('s', {s}, 'p', '{p}', 'o', {o}) END" for s, p, o, c in specs)
        return ids.selectExpr("s", h).selectExpr(f"explode(array_compact(array({rows}))) AS r").selectExpr("r.s", "r.p", "r.o")

    named = base.where("p = 'defines'").selectExpr("o AS s").distinct()
    things = base.where("p IN ('defines', 'imports')").selectExpr("s").union(base.where("p = 'imports'").selectExpr("o AS s")).distinct()
    return base.select("s", "p", "o").unionByName(derive(named, SPECS)).unionByName(derive(things, FILE_SPECS)).distinct()
