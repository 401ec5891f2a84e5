"""Queries of the rule library and their SQL, which writes every rule as a join of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions import text as X
from factweave.operators import rules as R
from factweave.queries.facts import short_sql
from factweave.sources.fixtures import FACTS_CTE, RULES_CTE, facts, rule_facts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _row(rule: str, kind: str, severity: str, message: str, body: str, symbol: str = "d.o") -> str:
    return f"SELECT DISTINCT d.s AS file, {_q(rule)} AS rule, {_q(kind)} AS type, {symbol} AS symbol, {severity if severity.startswith('v.') else _q(severity) if severity else 'NULL'} AS severity, {_q(message)} AS message FROM rf d {body}"


def _not(alias: str, on: str) -> str:
    return f"NOT EXISTS (SELECT 1 FROM rf {alias} WHERE {on})"


def _bodies() -> list[tuple[str, str]]:
    out = []
    d = "d.p = 'defines'"
    for rule, p, o, kind, sev, msg in R.table(R.OWN):
        out.append((rule, _row(rule, kind, sev, msg, f"JOIN rf a ON a.s = d.o AND a.p = '{p}' AND a.o = {_q(o)} WHERE {d}")))
    for rule, link, p, o, kind, sev, msg in R.table(R.VIA):
        out.append((rule, _row(rule, kind, sev, msg, f"JOIN rf a ON a.s = d.o AND a.p = '{link}' JOIN rf b ON b.s = a.o AND b.p = '{p}' AND b.o = {_q(o)} WHERE {d}")))
    for rule, p, want, missing, kind, sev, msg in R.table(R.LACKS):
        cond = "" if want == "*" else f" AND a.o = {_q(want)}"
        out.append((rule, _row(rule, kind, sev, msg, f"JOIN rf a ON a.s = d.o AND a.p = '{p}'{cond} WHERE {d} AND " + _not("n", f"n.s = d.o AND n.p = '{missing}'"))))
    for rule, p, pair, kind, sev, msg in R.table(R.UNPAIRED):
        out.append((rule, _row(rule, kind, sev, msg, f"JOIN rf a ON a.s = d.o AND a.p = '{p}' WHERE {d} AND " + _not("n", f"n.s = d.o AND n.p = '{pair}' AND n.o = a.o"))))
    num = lambda a: f"CASE WHEN regexp_full_match({a}.o, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CAST({a}.o AS DOUBLE) END"
    for rule, link, p, low, high, kind, sev, msg in R.table(R.BAND):
        chain = f"JOIN rf v ON v.s = d.o AND v.p = '{p}'" if not link else f"JOIN rf a ON a.s = d.o AND a.p = '{link}' JOIN rf v ON v.s = a.o AND v.p = '{p}'"
        out.append((rule, _row(rule, kind, sev, msg, f"{chain} WHERE {d} AND {num('v')} > {low}" + (f" AND {num('v')} <= {high}" if high else ""))))
    for rule, p, o, kind, sev, msg in R.table(R.IMPORT):
        out.append((rule, _row(rule, kind, sev, msg, f"JOIN rf a ON a.s = d.o AND a.p = '{p}' AND a.o = {_q(o)} WHERE d.p = 'imports'", "d.s")))
    one = lambda a, p, on="d.o": f"JOIN rf {a} ON {a}.s = {on} AND {a}.p = '{p}'"
    special = [
        *(("security_csrf", "csrf", "High", f"{m} handler without CSRF protection", f"{one('a', 'has_role')} AND a.o = 'api_handler' {one('b', 'handles_method')} AND b.o = '{m}' WHERE {d} AND " + _not("n", "n.s = d.o AND n.p = 'has_csrf_protection'")) for m in ("POST", "PUT")),
        ("security_xss", "xss", "High", "DOM manipulation without sanitization", f"{one('a', 'calls')} {one('b', 'has_pattern', 'a.o')} AND b.o = 'dom_manipulation' WHERE {d} AND " + _not("n", "n.s = a.o AND n.p = 'has_sanitization'")),
        ("security_auth_issue", "auth_issue", "High", "Authenticated endpoint without authorization check", f"{one('a', 'has_role')} AND a.o = 'api_handler' {one('b', 'requires_authentication')} AND b.o = 'true' WHERE {d} AND " + _not("n", "n.s = d.o AND n.p = 'has_authorization'")),
        ("quality_error_handling", "unhandled_error", "", "Error not handled", f"{one('a', 'calls')} {one('b', 'can_return_error', 'a.o')} AND b.o = 'true' WHERE {d} AND " + _not("n", "n.s = d.o AND n.p = 'handles_error' AND n.o = a.o")),
        ("performance_concurrency", "deadlock", "", "Potential deadlock from lock ordering", f"{one('a', 'acquires_lock')} {one('b', 'acquires_lock')} AND b.o <> a.o WHERE {d} AND " + _not("n", "n.s = d.o AND n.p = 'acquires_locks_in_order'")),
        ("performance_network", "no_caching", "", "Network request without caching", f"{one('a', 'makes_request')} WHERE {d} AND " + _not("n", "n.s = a.o AND n.p = 'uses_cache'")),
        ("logic_dead_code", "dead_code", "", "Unreachable branch detected", f"{one('a', 'has_branch')} WHERE {d} AND " + _not("n", "n.s = a.o AND n.p = 'is_reachable' AND n.o = 'true'")),
        ("logic_dead_code", "dead_code", "", "Call to undefined function", f"{one('a', 'calls')} WHERE {d} AND " + _not("n", "n.p = 'defines' AND n.o = a.o")),
        ("logic_type_safety", "type_mismatch", "", "Type mismatch in assignment", f"{one('a', 'has_type')} {one('b', 'assigns_value')} {one('c', 'has_type', 'b.o')} WHERE {d} AND a.o <> c.o"),
        ("logic_type_safety", "type_mismatch", "", "Argument type mismatch", f"{one('a', 'calls')} {one('b', 'requires_type', 'a.o')} {one('g', 'passes_argument')} {one('c', 'has_type', 'g.o')} WHERE {d} AND b.o <> c.o"),
        ("logic_null_safety", "null_safety", "", "Potential null pointer access", f"{one('a', 'accesses_field')} {one('b', 'can_be_null', 'a.o')} AND b.o = 'true' WHERE {d} AND " + _not("n", "n.s = d.o AND n.p = 'checks_null' AND n.o = a.o")),
        ("logic_null_safety", "null_safety", "", "Unchecked null return value", f"{one('a', 'calls')} {one('b', 'returns_null', 'a.o')} AND b.o = 'true' WHERE {d} AND " + _not("n", "n.s = d.o AND n.p = 'checks_return_null'")),
        ("logic_consistency", "consistency", "", "Missing interface method implementation", f"{one('a', 'implements_interface')} {one('b', 'requires_method', 'a.o')} WHERE {d} AND " + _not("n", "n.s = d.o AND n.p = 'implements_method' AND n.o = b.o")),
        ("logic_consistency", "consistency", "", "Accessing non-existent schema field", f"{one('a', 'uses_schema')} {one('b', 'has_field', 'a.o')} {one('c', 'accesses_field')} AND c.o <> b.o WHERE {d} AND " + _not("n", "n.s = a.o AND n.p = 'has_field' AND n.o = c.o")),
        ("logic_temporal", "temporal", "", "Transition to invalid state", f"{one('a', 'has_state')} {one('b', 'transitions_to', 'a.o')} WHERE {d} AND " + _not("n", "n.s = b.o AND n.p = 'is_valid_state' AND n.o = 'true'")),
        ("logic_temporal", "temporal", "", "Missing transition guard", f"{one('a', 'has_state')} {one('b', 'requires_guard', 'a.o')} WHERE {d} AND " + _not("n", "n.s = a.o AND n.p = 'has_guard' AND n.o = b.o")),
        ("logic_formal_verification", "formal_verification", "", "Does not satisfy specification property", f"{one('a', 'has_specification')} {one('b', 'has_property', 'a.o')} WHERE {d} AND " + _not("n", "n.s = d.o AND n.p = 'satisfies_property' AND n.o = b.o")),
    ]
    out += [(rule, _row(rule, kind, sev, msg, body)) for rule, kind, sev, msg, body in special]
    out.append(("security_dependency_vulnerability", _row("security_dependency_vulnerability", "dependency_vulnerability", "v.o", "Dependency has known CVE", "JOIN rf a ON a.s = d.o AND a.p = 'has_cve' JOIN rf v ON v.s = a.o AND v.p = 'severity' WHERE d.p = 'imports'")))
    return out


_BODIES = _bodies()


def findings_sql(*names: str) -> str:
    return " UNION ".join(b for rule, b in _BODIES if any(rule == n or rule.startswith(n + "_") for n in names))


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(R.Rules(rule_facts(spark, sf_dir)))
        if sql:
            SQL[name] = sql if sql.startswith("WITH") else f"{RULES_CTE} {sql}"
        return fn

    return add


for _rule in dict.fromkeys(r for r, _ in _BODIES):
    query(f"rule_{_rule}", findings_sql(_rule))(lambda r, name=_rule: r.findings(name))
for _family, _weights in R.WEIGHTS.items():
    query(f"rule_{_family}_scan_file", f"SELECT file, count(*) AS n_findings, list_sort(list(rule || '|' || type || '|' || symbol || '|' || message)) AS findings FROM ({findings_sql(_family)}) GROUP BY 1")(lambda r, name=_family: r.scan_file(name).select("file", "n_findings", F.array_sort(F.transform("findings", lambda x: F.concat_ws("|", x["rule"], x["type"], x["symbol"], x["message"]))).alias("findings")))
    _points = "CASE rule " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _weights.items()) + " END"
    query(f"rule_{_family}_score", f"SELECT f.file, coalesce(x.score, 0)::DOUBLE AS score FROM (SELECT DISTINCT s AS file FROM rf WHERE p IN ('defines', 'imports')) f LEFT JOIN (SELECT file, sum({_points}) AS score FROM ({findings_sql(_family)}) GROUP BY 1) x ON x.file = f.file")(lambda r, name=_family: r.score(name))
_debt = "CASE rule " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.DEBT_HOURS.items()) + " END"
query("rule_quality_technical_debt", f"SELECT f.file, coalesce(x.h, 0)::DOUBLE AS debt_hours FROM (SELECT DISTINCT s AS file FROM rf WHERE p IN ('defines', 'imports')) f LEFT JOIN (SELECT file, sum({_debt}) AS h FROM ({findings_sql(*R.DEBT_HOURS)}) GROUP BY 1) x ON x.file = f.file")(lambda r: r.technical_debt())
query("rule_security_audit_report", f"SELECT h.s AS project, count(*) AS n_findings, count(DISTINCT f.file) AS n_files FROM ({findings_sql('security')}) f JOIN (SELECT DISTINCT s, o FROM rf WHERE p = 'has_file') h ON h.o = f.file GROUP BY 1")(lambda r: r.audit_report())
_REM = "(VALUES " + ", ".join(f"({_q(a)}, {_q(b)})" for a, b in R.table(R.REMEDIATION)) + ") m(type, remediation)"
for _family in R.WEIGHTS:
    query(f"rule_{_family}_remediation", f"SELECT f.*, m.remediation FROM ({findings_sql(_family)}) f JOIN {_REM} ON m.type = f.type")(lambda r, name=_family: r.remediation(name).select(*R.FINDING, "remediation"))
query("rule_smell_god_file", "SELECT s AS file, p AS smell, count(DISTINCT o) AS n FROM rf WHERE p IN ('imports', 'defines') AND NOT contains(s, ':') GROUP BY 1, 2 HAVING (p = 'imports' AND count(DISTINCT o) > 50) OR (p = 'defines' AND count(DISTINCT o) > 30)")(lambda r: r.smells())
query("rule_smell_hub", "SELECT a.symbol, n_out, n_in FROM (SELECT s AS symbol, count(DISTINCT o) AS n_out FROM rf WHERE p = 'calls' GROUP BY 1) a JOIN (SELECT o AS symbol, count(DISTINCT s) AS n_in FROM rf WHERE p = 'calls' GROUP BY 1) b USING (symbol) WHERE n_out > 10 AND n_in > 5")(lambda r: r.hubs())
query("rule_smell_circular_direct", "SELECT DISTINCT x.s AS a, x.o AS b FROM rf x JOIN rf y ON x.o = y.s AND x.s = y.o WHERE x.p = 'calls' AND y.p = 'calls' AND x.s <> x.o")(lambda r: r.mutual_calls())
query("rule_smell_layer_violation", "SELECT DISTINCT i.s AS file, i.o AS target, t.o AS tag FROM rf i JOIN rf t ON t.s = i.s AND t.p = 'has_tag' JOIN rf b ON b.s = i.o AND b.p = 'has_tag' AND b.o = 'backend' WHERE i.p = 'imports' AND t.o <> 'backend'")(lambda r: r.layer_violations())
query("rule_find_imports", "SELECT DISTINCT s AS file, o AS target FROM rf WHERE p = 'imports'")(lambda r: r.of("imports", "file", "target").distinct())
query("rule_find_defines", "SELECT DISTINCT s AS file, o AS symbol FROM rf WHERE p = 'defines'")(lambda r: r.defines)
for _family in ("quality", "impact"):
    query(f"rule_{_family}_metrics_history", f"SELECT DISTINCT a.s, t.o AS at, v.o AS value FROM rf a JOIN rf t ON t.s = a.o AND t.p = 'has_timestamp' JOIN rf v ON v.s = a.o AND v.p = 'has_value' WHERE a.p = 'has_{_family}_metric'")(lambda r, name=_family: r.metrics_history(f"has_{name}_metric"))
    query(f"rule_{_family}_trend", f"SELECT DISTINCT a.s, t.o FROM rf a JOIN rf t ON t.s = a.o AND t.p = 'has_trend' WHERE a.p = 'has_{_family}_metric'")(lambda r, name=_family: r.chains(f"has_{name}_metric", "has_trend"))
query("rule_performance_historical_analysis", "SELECT DISTINCT a.s, t.o FROM rf a JOIN rf h ON h.s = a.o AND h.p = 'has_history' JOIN rf t ON t.s = h.o AND t.p = 'trend' WHERE a.p = 'has_performance_metric'")(lambda r: R.REPORTS["performance_historical_analysis"](r))
query("rule_performance_load_tests", "SELECT DISTINCT d.s AS file, a.o AS target, 'concurrent_users' AS scenario, 100 AS level FROM rf d JOIN rf h ON h.s = d.o AND h.p = 'has_role' AND h.o = 'api_handler' JOIN rf a ON a.s = d.o AND a.p = 'handles_endpoint' WHERE d.p = 'defines' UNION SELECT DISTINCT d.s, a.o, 'query_load', 1000 FROM rf d JOIN rf a ON a.s = d.o AND a.p = 'executes_query' WHERE d.p = 'defines'")(lambda r: r.load_tests())
query("rule_valid_transitions", "SELECT DISTINCT t.s AS state, t.o AS next, g.o AS guard FROM rf t JOIN rf g ON g.s = t.s AND g.p = 'has_guard' JOIN rf k ON k.s = g.o AND k.p = 'is_satisfied' AND k.o = 'true' WHERE t.p = 'transitions_to'")(lambda r: r.valid_transitions())
query("rule_fully_implements", "SELECT DISTINCT c.s AS symbol, c.o AS interface FROM rf c WHERE c.p = 'implements_interface' AND NOT EXISTS (SELECT 1 FROM rf m WHERE m.s = c.o AND m.p = 'requires_method' AND NOT EXISTS (SELECT 1 FROM rf i WHERE i.s = c.s AND i.p = 'implements_method' AND i.o = m.o))")(lambda r: r.fully_implements())
query("rule_satisfied_properties", "SELECT DISTINCT s AS symbol, o AS property FROM rf WHERE p = 'satisfies_property'")(lambda r: r.of("satisfies_property", "symbol", "property").distinct())
query("rule_maintained_invariants", "SELECT DISTINCT s AS symbol, o AS invariant FROM rf WHERE p = 'maintains_invariant'")(lambda r: r.of("maintains_invariant", "symbol", "invariant").distinct())

# --- Impact -----------------------------------------------------------------------------------------------------------------

_DEP = "dep AS (SELECT DISTINCT s AS src, o AS dst FROM rf WHERE p IN ('calls', 'imports', 'uses_type'))"
_SYM = "(SELECT n FROM (SELECT dst AS n, count(*) AS i FROM dep GROUP BY 1) JOIN (SELECT src AS n, count(*) AS o FROM dep GROUP BY 1) USING (n) WHERE n LIKE 'planted/ring.go:%' ORDER BY least(i, o) DESC, n LIMIT 1)"
_BACK = f"{RULES_CTE}, {_DEP}, back AS (SELECT src AS node FROM dep WHERE dst = {_SYM} UNION SELECT dep.src FROM back JOIN dep ON dep.dst = back.node)"
_FORTH = f"forth AS (SELECT dst AS node FROM dep WHERE src = {_SYM} UNION SELECT dep.dst FROM forth JOIN dep ON dep.src = forth.node)"
_AFF = "aff AS (SELECT DISTINCT s AS file FROM rf WHERE p = 'defines' AND o IN (SELECT node FROM back))"


def target(r: R.Rules) -> str:
    """The node of the planted ring that is in the middle of most dependencies: it has ways in, out and round."""
    d = r.dependencies()
    n = d.groupBy(F.col("dst").alias("n")).agg(F.count(F.lit(1)).alias("i")).join(d.groupBy(F.col("src").alias("n")).agg(F.count(F.lit(1)).alias("o")), "n")
    return n.where("n like 'planted/ring.go:%'").orderBy(F.least("i", "o").desc(), "n").head()[0]


query("impact_direct_dependencies", f"{RULES_CTE}, {_DEP} SELECT * FROM dep")(lambda r: r.dependencies())
query("impact_transitive_dependencies", f"{RULES_CTE}, {_DEP}, {_FORTH} SELECT node FROM forth")(lambda r: r.depends_on(target(r)))
query("impact_reverse_dependencies", f"{RULES_CTE}, {_DEP} SELECT dst AS symbol, src AS dependent FROM dep")(lambda r: r.reverse_dependencies())
_DEEP = "deep_all AS (SELECT dst AS node, 2 AS depth FROM dep WHERE src = " + _SYM + " UNION SELECT dep.dst, depth + 1 FROM deep_all JOIN dep ON dep.src = deep_all.node WHERE depth < 40)"
query("impact_dependency_depth", f"{RULES_CTE}, {_DEP}, {_DEEP} SELECT node, min(depth) AS depth FROM deep_all GROUP BY 1")(lambda r: r.dependency_depth(target(r)))
query("impact_transitive_reverse", f"{_BACK} SELECT node FROM back")(lambda r: r.dependents(target(r)))
query("impact_blast_radius", f"{_BACK} SELECT count(*) AS radius FROM back")(lambda r: r.dependents(target(r)).agg(F.count(F.lit(1)).alias("radius")))
query("impact_affected_files", f"{_BACK}, {_AFF} SELECT file FROM aff")(lambda r: r.affected_files(target(r)))
query("impact_affected_services", f"{_BACK}, {_AFF} SELECT DISTINCT o AS service FROM rf JOIN aff ON s = file WHERE p = 'belongs_to_service'")(lambda r: r.affected_services(target(r)))
query("impact_circular", f"{_BACK}, {_FORTH} SELECT node FROM back WHERE node IN (SELECT node FROM forth)")(lambda r: r.circular(target(r)))
_IMPACT = f"{RULES_CTE}, {_DEP} SELECT d.o AS symbol, count(DISTINCT dep.src) AS impact FROM (SELECT DISTINCT o FROM rf WHERE p = 'defines') d LEFT JOIN dep ON dep.dst = d.o GROUP BY 1"
query("impact_high", f"{_IMPACT} HAVING count(DISTINCT dep.src) > 10")(lambda r: r.direct_impact().where("impact > 10"))
query("impact_low", f"{_IMPACT} HAVING count(DISTINCT dep.src) <= 2")(lambda r: r.direct_impact().where("impact <= 2"))
query("impact_report", f"""{_BACK}, {_FORTH}, {_AFF}, n AS (SELECT (SELECT count(*) FROM back) AS radius, (SELECT count(*) FROM aff) AS n_files, (SELECT count(DISTINCT o) FROM rf JOIN aff ON s = file WHERE p = 'belongs_to_service') AS n_services, (SELECT count(*) FROM back WHERE node IN (SELECT node FROM forth)) AS n_cycles)
SELECT {_SYM} AS symbol, *, radius * 2 + n_services * 10 + n_cycles * 15 AS score, CASE WHEN radius > 50 THEN 'high_impact' WHEN radius > 10 THEN 'medium_impact' ELSE 'low_impact' END AS prediction, CASE WHEN radius > 20 AND n_services > 2 THEN 'high_risk' WHEN radius > 10 AND radius <= 20 AND n_services <= 2 THEN 'medium_risk' WHEN radius <= 10 THEN 'low_risk' END AS regression_risk FROM n""")(lambda r: r.impact_report(target(r)))
query("impact_test_selection", f"{_BACK}, {_AFF} SELECT DISTINCT o AS test FROM rf WHERE p = 'has_test' AND s IN (SELECT node FROM back UNION SELECT file FROM aff)")(lambda r: r.tests_for(target(r)))
query("impact_graph_edges", f"{RULES_CTE}, {_DEP}, {_FORTH}, keep AS (SELECT node FROM forth WHERE node IN (SELECT o FROM rf WHERE p = 'defines')) SELECT src, dst FROM dep WHERE src IN (SELECT node FROM keep) AND dst IN (SELECT node FROM keep)")(lambda r: r.dependency_graph(target(r))[1])
query("impact_critical_paths", f"""{RULES_CTE}, {_DEP}, one AS (SELECT * FROM dep WHERE src <> dst), p AS (SELECT [src, dst] AS path, dst AS last, 1 AS length FROM one WHERE src = {_SYM} UNION ALL SELECT list_append(path, one.dst), one.dst, length + 1 FROM p JOIN one ON p.last = one.src WHERE length < 3 AND NOT list_contains(path, one.dst))
SELECT path, length FROM p WHERE last IN (SELECT s FROM rf WHERE p = 'is_critical' AND o = 'true')""")(lambda r: r.critical_paths(target(r)))
_N = f"""{_BACK}, {_FORTH}, {_AFF}, n AS (SELECT (SELECT count(*) FROM back) AS radius)"""
query("impact_remediation", f"""{_N}, issue AS (SELECT {_SYM} AS symbol, 'circular_dependency' AS type, node AS description FROM back WHERE node IN (SELECT node FROM forth) UNION ALL SELECT {_SYM}, CASE WHEN radius > 50 THEN 'high_impact' WHEN radius > 10 THEN 'medium_impact' ELSE 'low_impact' END, radius || ' dependents' FROM n)
SELECT symbol, issue.type, description, remediation FROM issue JOIN {_REM} ON m.type = issue.type""")(lambda r: r.impact_remediation(target(r)))
_NAME = short_sql("o")
_ROLES, _TAGS = ", ".join(map(_q, R.STICKY_ROLES)), ", ".join(map(_q, R.STICKY_TAGS))
QUERIES["sticky_facts"] = lambda spark, sf_dir: R.sticky(facts(spark, sf_dir)).select("s", "p", "o").distinct()
SQL["sticky_facts"] = f"""{FACTS_CTE} SELECT DISTINCT s, p, o FROM facts WHERE p = 'has_security_risk' OR p = 'defines' AND (o IN (SELECT s FROM facts WHERE p = 'has_role' AND o IN ({_ROLES}) OR p = 'has_tag' AND o IN ({_TAGS}))
OR regexp_matches(lower({_NAME}), '{"|".join(X.ATTENTION_ANYWHERE)}|^on_|callback$') OR regexp_matches({_NAME}, '^({"|".join(X.ATTENTION_PREFIX)})|({"|".join(X.ATTENTION_SUFFIX)})$'))"""
