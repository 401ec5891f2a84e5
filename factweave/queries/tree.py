"""Queries of extraction, incremental ingestion, enrichment and events, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import enrich
from factweave.plans import agent, nl
from factweave.plans.registry import Registry
from factweave.queries.facts import short_sql
from factweave.session import table
from factweave.sources import incremental, tree
from factweave.sources.fixtures import FACTS_CTE, PLANTED_CTE, facts, planted_facts
from factweave.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest text of every file of nodes."""
    n = table(spark, sf_dir, "nodes").where("node_id is not null and code is not null")
    return n.groupBy(F.col("node_id").alias("path")).agg(F.max_by("code", F.struct("ingested_at", "node_key")).alias("content"), F.lit(0).cast("long").alias("mtime"))


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nodes").where("node_id is not null and code is not null")
    return n.where("ingested_at < timestamp_ntz '2032-01-01 00:00:00'").groupBy(F.col("node_id").alias("path")).agg(F.max_by("code", F.struct("ingested_at", "node_key")).alias("content"), F.lit(0).cast("long").alias("mtime"))


def extracted_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.extract(_files(spark, sf_dir)).where("what = 'symbol'").select("path", "id", "kind", "start_line", "end_line", "doc")


def code_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return tree.facts_of_tree(files, tree.extract(files), 1)


def hash_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.changes(incremental.hashes(_first(spark, sf_dir)), incremental.hashes(_files(spark, sf_dir)))


def virtual_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.virtual_facts(planted_facts(spark, sf_dir), _files(spark, sf_dir).select(F.col("path").alias("file"), "content"))


def role_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.roles(planted_facts(spark, sf_dir))


def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.activity(table(spark, sf_dir, "events"))
    return rows.select(F.date_format("start_at", "yyyy-MM-dd HH:mm:ss").alias("start_at"), "event_type", "n", F.round("total", 2).alias("total"))


def plan_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [agent.Step(1, "symbols of tests", 'triples(?f, "defines", ?sym), contains(?f, "_test")'), agent.Step(2, "what they call", 'triples({{step_1_sym}}, "calls", ?callee)')]
    return agent.Plan(facts(spark, sf_dir), steps, most=None).execute(lambda step, error: None)[1].result.select("callee").distinct()


def registry_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Registry().execute("smell_circular_direct", facts(spark, sf_dir))


def question_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factweave.plans.compiler import compile_query

    return compile_query(nl.to_query(nl.classify("Where is mergeGraph defined?"), [])[0], facts(spark, sf_dir))


_ROUTE = r"""[.](?:GET|POST|PUT|DELETE|PATCH|HandleFunc|Handle)[(]\s*["'']([^"'']+)["'']\s*,\s*(?:[A-Za-z0-9_]+[.])*([A-Za-z0-9_]+)"""
_LATEST = "SELECT node_id AS path, max_by(code, {{'a': ingested_at, 'k': node_key}}) AS content FROM nodes WHERE node_id IS NOT NULL AND code IS NOT NULL{0} GROUP BY 1"
QUERIES |= {"extracted_symbols": extracted_symbols, "code_facts": code_facts, "hash_changes": hash_changes, "virtual_facts": virtual_facts, "role_facts": role_facts, "events_by_hour": events_by_hour, "plan_two_steps": plan_two_steps, "registry_template": registry_template, "question_find": question_find}
SQL |= {
    "hash_changes": f"SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.content <> b.content THEN 'changed' ELSE 'unchanged' END AS change FROM ({_LATEST.format(chr(32) + 'AND ingested_at < TIMESTAMP ' + chr(39) + '2032-01-01 00:00:00' + chr(39))}) a FULL JOIN ({_LATEST.format('')}) b ON a.path = b.path",
    "role_facts": f"{PLANTED_CTE} SELECT DISTINCT o AS s, 'has_role' AS p, 'api_handler' AS o FROM facts WHERE p = 'handled_by' UNION SELECT DISTINCT s, 'has_role', 'data_contract' FROM facts WHERE p = 'in_package' AND regexp_matches(o, 'types|models|ast')",
    "virtual_facts": f"""{PLANTED_CTE}, files AS ({_LATEST.format('')}), names AS (SELECT DISTINCT o AS handler, {short_sql('o')} AS name FROM facts WHERE p = 'defines'),
found AS (SELECT unnest(regexp_extract_all(content, '{_ROUTE}', 1)) AS route, unnest(regexp_extract_all(content, '{_ROUTE}', 2)) AS name FROM files WHERE regexp_matches(content, 'gin[.]Default|gin[.]New|[.]Group|Router')),
handled AS (SELECT route AS s, 'handled_by' AS p, max(handler) AS o FROM found JOIN names USING (name) GROUP BY 1), both_ AS (SELECT s, p, o FROM facts UNION SELECT * FROM handled),
links AS (SELECT DISTINCT r.s AS source, h.o AS target, r.route FROM (SELECT s, split_part(o, '?', 1) AS route FROM facts WHERE p = 'references') r JOIN both_ h ON h.p = 'handled_by' AND h.s = r.route),
methods AS (SELECT DISTINCT s, {short_sql('s')} AS name FROM facts WHERE p IN ('type', 'has_kind', 'kind') AND trim(o) = 'method'), models AS (SELECT DISTINCT s AS model, regexp_extract(s, '([A-Za-z0-9_]+)$', 1) AS name FROM facts WHERE p = 'has_role' AND o = 'data_contract'),
made AS (SELECT d.o AS s, 'has_tag' AS p, t.o FROM facts d JOIN facts t ON t.s = d.s WHERE d.p = 'defines' AND t.p = 'has_tag' UNION SELECT * FROM handled UNION SELECT source, 'calls_api', route FROM links UNION SELECT source, 'calls', target FROM links
UNION SELECT f.path, 'exposes_model', m.model FROM (SELECT path, unnest(list_distinct(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_]+)', 1))) AS name FROM files WHERE regexp_matches(path, '[.](ts|tsx|js|jsx)$')) f JOIN models m ON m.name = f.name AND length(m.name) > 3
UNION SELECT t.path, 'calls', m.s FROM (SELECT path, unnest(list_distinct(regexp_extract_all(content, '[.]([A-Za-z0-9_]+)[(]', 1))) AS name FROM files WHERE path LIKE '%.go') t JOIN methods m USING (name)
UNION SELECT s, 'exports', o FROM facts WHERE p = 'defines' AND regexp_matches(o, '[:.][A-Z][A-Za-z0-9_]*$')
UNION SELECT o, 'has_role', 'api_handler' FROM both_ WHERE p = 'handled_by' UNION SELECT s, 'has_role', 'data_contract' FROM both_ WHERE p = 'in_package' AND regexp_matches(o, 'types|models|ast'))
SELECT DISTINCT s, p, o FROM made EXCEPT SELECT s, p, o FROM facts""",
    "events_by_hour": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start_at, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "plan_two_steps": f"{FACTS_CTE} SELECT DISTINCT o AS callee FROM facts WHERE p = 'calls' AND s IN (SELECT o FROM facts WHERE p = 'defines' AND contains(s, '_test'))",
    "registry_template": f"{FACTS_CTE} SELECT DISTINCT x.s AS a, x.o AS b FROM facts x JOIN facts y ON x.o = y.s AND x.s = y.o WHERE x.p = 'calls' AND y.p = 'calls' AND x.s <> x.o",
    "question_find": f"{FACTS_CTE} SELECT DISTINCT s, o AS sym FROM facts WHERE p = 'defines' AND contains(o, 'mergeGraph')",
}
