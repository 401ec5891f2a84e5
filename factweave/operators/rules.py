"""The rule library: findings per file, scores, remediation and impact analysis.

Rules are rows of a table, not queries of their own: each says which shape it has and with which values. A shape is evaluated
once for all its rules, by joining the facts with the (broadcast, few dozen rows) table, so the whole library costs a handful
of joins, and naming a rule only narrows that table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import number_of, short_name
from factweave.operators import graph as G
from factweave.session import checkpoint

FINDING = ("file", "rule", "type", "symbol", "severity", "message")

# Fixed values. Shape "own": a symbol of the file has predicate = value. "via": a symbol has the first predicate with some object that has
# the second predicate = value. "band": low < value <= high, of the symbol's own predicate or of that of the object of another.
OWN = """
security_secret_leak|has_pattern|hardcoded_password|secret_leak|Critical|Hardcoded password detected
security_secret_leak|has_pattern|hardcoded_api_key|secret_leak|Critical|Hardcoded API key detected
security_secret_leak|has_pattern|hardcoded_token|secret_leak|Critical|Hardcoded token detected
security_secret_leak|has_pattern|hardcoded_secret|secret_leak|Critical|Hardcoded secret detected
quality_code_smell|has_pattern|god_class|god_class||God class detected (too many responsibilities)
quality_code_smell|has_pattern|long_method|long_method||Long method detected
quality_code_smell|has_pattern|deep_nesting|deep_nesting||Deep nesting detected
quality_code_smell|has_pattern|magic_number|magic_number||Magic number detected
performance_bottleneck|has_complexity|O(n^2)|bottleneck||Quadratic time complexity detected
performance_bottleneck|has_complexity|O(n^3)|bottleneck||Cubic time complexity detected
performance_bottleneck|has_complexity|O(2^n)|bottleneck||Exponential time complexity detected
performance_algorithm|has_pattern|nested_loop|nested_loop||Nested loop detected
performance_algorithm|has_pattern|repeated_computation|repeated_computation||Repeated computation without memoization
performance_algorithm|has_pattern|inefficient_data_structure|inefficient_data_structure||Inefficient data structure usage
"""
VIA = """
security_sql_injection|calls|has_pattern|sql_concatenation|sql_injection|Critical|SQL injection via string concatenation
security_sql_injection|calls|has_pattern|raw_sql_query|sql_injection|Critical|Raw SQL query without parameterization
security_xss|calls|has_pattern|html_injection|xss|High|Potential XSS via HTML injection
security_dangerous_pattern|calls|has_pattern|eval_execution|dangerous_pattern|High|Use of eval() function
security_dangerous_pattern|calls|has_pattern|unsafe_deserialization|dangerous_pattern|High|Unsafe deserialization
security_dangerous_pattern|calls|has_pattern|command_injection|dangerous_pattern|Critical|Command injection vulnerability
security_weak_crypto|calls|has_pattern|md5_hash|weak_crypto|High|Use of MD5 hash (insecure)
security_weak_crypto|calls|has_pattern|sha1_hash|weak_crypto|Medium|Use of SHA1 hash (consider SHA256)
security_weak_crypto|calls|has_pattern|weak_random|weak_crypto|High|Use of weak random number generator
quality_error_handling|handles_error|has_pattern|bare_return|bare_error_return||Bare error return without context
performance_bottleneck|calls|is_expensive|true|bottleneck||Call to expensive operation
performance_database|executes_query|has_pattern|n_plus_one|n_plus_one||N+1 query problem detected
performance_database|executes_query|has_pattern|missing_index|missing_index||Query without proper indexing
performance_database|executes_query|has_pattern|full_table_scan|full_table_scan||Full table scan detected
performance_network|makes_request|has_pattern|sequential_requests|sequential_requests||Sequential network requests
"""
# Shape "lacks": a symbol meets a condition (predicate, value or any) and has no fact of another predicate.
LACKS = """
security_auth_issue|has_role|api_handler|requires_authentication|auth_issue|Critical|API handler without authentication
quality_documentation|is_exported|true|has_doc_comment|missing_documentation||Exported symbol lacks documentation
quality_documentation|has_role|api_handler|has_api_documentation|missing_api_docs||API handler lacks documentation
quality_test_coverage|is_exported|true|has_test|missing_tests||Exported symbol lacks tests
quality_test_coverage|has_role|api_handler|has_integration_test|missing_integration_test||API handler lacks integration test
quality_fpt_standards|has_name|*|follows_naming_convention|naming_convention||Symbol does not follow naming convention
performance_memory_leak|creates_goroutine|*|waits_for_goroutine|memory_leak||Goroutine created without synchronization
performance_resource|creates_temp_file|*|cleans_up_temp_file|temp_file_leak||Temporary file not cleaned up
"""
# Shape "unpaired": a symbol has the first predicate with an object, but not the second with the same object.
UNPAIRED = """
performance_memory_leak|allocates_memory|deallocates_memory|memory_leak||Memory allocation without deallocation
performance_memory_leak|opens_resource|closes_resource|memory_leak||Resource opened without closing
performance_concurrency|accesses_shared_state|uses_lock|race_condition||Shared state access without synchronization
performance_concurrency|acquires_lock|releases_lock|deadlock||Lock acquired without release
performance_resource|reads_file|uses_buffering|unbuffered_io||Unbuffered file I/O
logic_contract_violation|has_precondition|validates_precondition|contract_violation||Precondition not validated
logic_contract_violation|has_postcondition|ensures_postcondition|contract_violation||Postcondition not ensured
logic_formal_verification|has_invariant|maintains_invariant|formal_verification||Invariant violation detected
"""
BAND = """
quality_cyclomatic_complexity||has_cyclomatic_complexity|15||high_complexity||Cyclomatic complexity exceeds threshold (15)
quality_cyclomatic_complexity||has_cyclomatic_complexity|10|15|medium_complexity||Cyclomatic complexity is high (10-15)
quality_code_duplication|has_duplicate|similarity_score|0.9||duplication||High code duplication detected
quality_code_duplication|has_duplicate|similarity_score|0.7|0.9|duplication||Moderate code duplication detected
quality_fpt_standards||has_line_count|100||function_length||Function exceeds 100 lines
quality_fpt_standards||has_parameter_count|5||parameter_count||Function has too many parameters
"""
# Shape "import": an imported thing has predicate = value; the finding names the file.
IMPORT = """
quality_dependency|is_unused|true|unused_import||Unused import detected
quality_dependency|is_deprecated|true|deprecated_import||Deprecated dependency imported
"""
# What to do about each type of finding.
REMEDIATION = """
sql_injection|Use parameterized queries or prepared statements
xss|Implement input validation and output encoding
csrf|Add CSRF tokens to state-changing requests
secret_leak|Move secrets to environment variables or secret manager
dangerous_pattern|Avoid eval() and unsafe functions; use safe alternatives
dependency_vulnerability|Update dependency to patched version
weak_crypto|Use strong cryptographic algorithms (SHA256, AES)
auth_issue|Implement proper authentication and authorization checks
high_complexity|Refactor function into smaller, focused functions
medium_complexity|Consider breaking down complex logic
duplication|Extract common code into reusable functions
missing_documentation|Add Go doc comments for exported symbols
missing_api_docs|Add OpenAPI/Swagger documentation
missing_tests|Add unit tests for exported functions
missing_integration_test|Add integration tests for API endpoints
naming_convention|Follow project naming conventions
function_length|Break long functions into smaller ones
parameter_count|Use struct or options pattern for many parameters
god_class|Split class into focused, single-responsibility classes
long_method|Extract methods for logical blocks
deep_nesting|Use early returns or extract nested logic
magic_number|Extract to named constants
unused_import|Remove unused imports
deprecated_import|Update to non-deprecated alternative
unhandled_error|Add proper error handling
bare_error_return|Wrap errors with context using fmt.Errorf
bottleneck|Optimize algorithm or use more efficient data structure
memory_leak|Ensure proper resource cleanup with defer/finally
race_condition|Add synchronization primitives (mutex, channel)
deadlock|Use consistent lock ordering or lock-free data structures
n_plus_one|Use batch queries or eager loading
missing_index|Add appropriate database indexes
full_table_scan|Add WHERE clause or index
sequential_requests|Use concurrent requests or batch processing
no_caching|Implement caching strategy
nested_loop|Optimize loop structure or use hash-based lookup
repeated_computation|Add memoization or caching
inefficient_data_structure|Use appropriate data structure for use case
unbuffered_io|Use buffered I/O operations
temp_file_leak|Ensure temporary files are cleaned up
dead_code|Remove unreachable code or fix control flow
type_mismatch|Ensure type compatibility or add type conversion
null_safety|Add null checks or use optional types
contract_violation|Implement contract validation logic
consistency|Ensure interface/schema compliance
temporal|Add state transition guards and validation
formal_verification|Implement specification compliance checks
circular_dependency|Refactor to break circular dependency
high_impact|Consider gradual rollout and extensive testing
medium_impact|Run affected tests and monitor closely
low_impact|Standard testing should be sufficient
"""
# Points of each rule's findings in the score of its family, in the families' order; hours of technical debt.
WEIGHTS = {
    "security": {"security_sql_injection": 10, "security_xss": 8, "security_csrf": 8, "security_secret_leak": 10, "security_dangerous_pattern": 9, "security_dependency_vulnerability": 7, "security_weak_crypto": 6, "security_auth_issue": 10},
    "quality": {"quality_cyclomatic_complexity": 5, "quality_code_duplication": 4, "quality_documentation": 2, "quality_test_coverage": 3, "quality_fpt_standards": 3, "quality_code_smell": 4, "quality_dependency": 2, "quality_error_handling": 5},
    "performance": {"performance_bottleneck": 9, "performance_memory_leak": 8, "performance_concurrency": 10, "performance_database": 7, "performance_network": 5, "performance_algorithm": 6, "performance_resource": 4},
    "logic": {"logic_dead_code": 3, "logic_type_safety": 8, "logic_null_safety": 7, "logic_contract_violation": 9, "logic_consistency": 6, "logic_temporal": 7, "logic_formal_verification": 10},
}
DEBT_HOURS = {"quality_cyclomatic_complexity": 2.0, "quality_code_duplication": 1.5, "quality_code_smell": 1.0, "quality_error_handling": 0.5}
IMPACT_WEIGHTS = (2, 10, 15)


@dataclass(frozen=True)
class RuleInfo:
    name: str
    category: str
    tier: int
    severity: str | None
    description: str


def table(text: str) -> list[list[str]]:
    return [line.split("|") for line in text.strip().splitlines()]


class Rules:
    """The library over facts(s, p, o)."""

    def __init__(self, facts: DataFrame):
        self.facts = facts.select("s", "p", "o")
        self.spark = facts.sparkSession
        self.defines = self.of("defines", "file", "symbol").distinct()
        self._dependencies: DataFrame | None = None
        self._reached: dict[tuple[str, bool, int], DataFrame] = {}

    def of(self, p: str, s: str, o: str) -> DataFrame:
        return self.facts.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))

    def having(self, p: str, value: str, s: str) -> DataFrame:
        return self.facts.where((F.col("p") == p) & (F.col("o") == value)).select(F.col("s").alias(s)).distinct()

    def any(self, p: str, s: str) -> DataFrame:
        return self.facts.where(F.col("p") == p).select(F.col("s").alias(s)).distinct()

    def _lookup(self, rows: list[list[str]], columns: str) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame([tuple(r) for r in rows], columns))

    def _finding(self, rows: DataFrame) -> DataFrame:
        return rows.select("file", "rule", "type", "symbol", F.when(F.col("severity") != "", F.col("severity")).alias("severity"), "message").distinct()

    def _special(self, symbols: DataFrame, rule: str, kind: str, severity: str, message: str) -> DataFrame:
        rows = symbols.join(self.defines, "symbol") if "file" not in symbols.columns else symbols
        return self._finding(rows.select("file", F.lit(rule).alias("rule"), F.lit(kind).alias("type"), "symbol", F.lit(severity).alias("severity"), F.lit(message).alias("message")))

    # --- Shapes ---------------------------------------------------------------------------------------------------

    def own(self, rows: list[list[str]]) -> DataFrame:
        look = self._lookup(rows, "rule string, p string, o string, type string, severity string, message string")
        return self._finding(self.facts.join(look, ["p", "o"]).withColumnRenamed("s", "symbol").join(self.defines, "symbol"))

    def via(self, rows: list[list[str]]) -> DataFrame:
        look = self._lookup(rows, "rule string, link string, p string, o string, type string, severity string, message string")
        marked = self.facts.join(look, ["p", "o"]).select(F.col("s").alias("target"), "link", "rule", "type", "severity", "message")
        links = self.facts.where(F.col("p").isin(*sorted({r[1] for r in rows}))).select(F.col("s").alias("symbol"), F.col("p").alias("link"), F.col("o").alias("target"))
        return self._finding(links.join(marked, ["link", "target"]).join(self.defines, "symbol"))

    def lacks(self, rows: list[list[str]]) -> DataFrame:
        look = self._lookup([[i, *r] for i, r in enumerate(rows)], "n int, rule string, p string, want string, missing string, type string, severity string, message string")
        met = self.facts.join(look, "p").where("want = '*' or o = want").select(F.col("s").alias("symbol"), "n", "missing", "rule", "type", "severity", "message").distinct()
        have = self.facts.where(F.col("p").isin(*sorted({r[3] for r in rows}))).select(F.col("s").alias("symbol"), F.col("p").alias("missing")).distinct()
        return self._finding(met.join(have, ["symbol", "missing"], "left_anti").join(self.defines, "symbol"))

    def unpaired(self, rows: list[list[str]]) -> DataFrame:
        look = self._lookup(rows, "rule string, p string, pair string, type string, severity string, message string")
        first = self.facts.join(look, "p").select(F.col("s").alias("symbol"), F.col("o").alias("thing"), "pair", "rule", "type", "severity", "message")
        second = self.facts.where(F.col("p").isin(*sorted({r[2] for r in rows}))).select(F.col("s").alias("symbol"), F.col("o").alias("thing"), F.col("p").alias("pair"))
        return self._finding(first.join(second, ["symbol", "thing", "pair"], "left_anti").join(self.defines, "symbol"))

    def band(self, rows: list[list[str]]) -> DataFrame:
        look = self._lookup([[r[0], r[1], r[2], float(r[3]), float(r[4] or "inf"), *r[5:]] for r in rows], "rule string, link string, p string, low double, high double, type string, severity string, message string")
        values = self.facts.join(look, "p").withColumn("x", number_of("o")).where("x > low and x <= high").select(F.col("s").alias("target"), "link", "rule", "type", "severity", "message")
        here = values.where("link = ''").withColumnRenamed("target", "symbol").drop("link")
        names = sorted({r[1] for r in rows if r[1]})
        found = here
        if names:
            links = self.facts.where(F.col("p").isin(*names)).select(F.col("s").alias("symbol"), F.col("p").alias("link"), F.col("o").alias("target"))
            found = here.unionByName(links.join(values, ["link", "target"]).drop("link", "target"))
        return self._finding(found.join(self.defines, "symbol"))

    def imported(self, rows: list[list[str]]) -> DataFrame:
        look = self._lookup(rows, "rule string, p string, o string, type string, severity string, message string")
        marked = self.facts.join(look, ["p", "o"]).select(F.col("s").alias("target"), "rule", "type", "severity", "message")
        return self._finding(self.of("imports", "file", "target").join(marked, "target").withColumn("symbol", F.col("file")))

    # --- Rules with a shape of their own ---------------------------------------------------------------------------

    def specials(self) -> dict[str, list[Callable[[], DataFrame]]]:
        calls = lambda: self.of("calls", "symbol", "target").distinct()
        handler = lambda: self.having("has_role", "api_handler", "symbol")
        none = lambda rows, p, s: rows.join(self.any(p, s), s, "left_anti")

        def csrf(method: str) -> DataFrame:
            rows = handler().join(self.having("handles_method", method, "symbol"), "symbol", "left_semi")
            return self._special(none(rows, "has_csrf_protection", "symbol"), "security_csrf", "csrf", "High", f"{method} handler without CSRF protection")

        def dom() -> DataFrame:
            target = none(self.having("has_pattern", "dom_manipulation", "target"), "has_sanitization", "target")
            return self._special(calls().join(target, "target", "left_semi"), "security_xss", "xss", "High", "DOM manipulation without sanitization")

        def authorised() -> DataFrame:
            rows = handler().join(self.having("requires_authentication", "true", "symbol"), "symbol", "left_semi")
            return self._special(none(rows, "has_authorization", "symbol"), "security_auth_issue", "auth_issue", "High", "Authenticated endpoint without authorization check")

        def cve() -> DataFrame:
            rows = self.of("imports", "file", "symbol").join(self.of("has_cve", "symbol", "cve"), "symbol").join(self.of("severity", "cve", "severity"), "cve")
            return self._finding(rows.select("file", F.lit("security_dependency_vulnerability").alias("rule"), F.lit("dependency_vulnerability").alias("type"), "symbol", "severity", F.lit("Dependency has known CVE").alias("message")))

        def unhandled() -> DataFrame:
            rows = calls().join(self.having("can_return_error", "true", "target"), "target", "left_semi").join(self.of("handles_error", "symbol", "target"), ["symbol", "target"], "left_anti")
            return self._special(rows, "quality_error_handling", "unhandled_error", "", "Error not handled")

        def lock_order() -> DataFrame:
            rows = self.of("acquires_lock", "symbol", "lock").groupBy("symbol").agg(F.min("lock").alias("a"), F.max("lock").alias("b")).where("a <> b")
            return self._special(none(rows, "acquires_locks_in_order", "symbol"), "performance_concurrency", "deadlock", "", "Potential deadlock from lock ordering")

        def uncached() -> DataFrame:
            rows = none(self.of("makes_request", "symbol", "request"), "uses_cache", "request")
            return self._special(rows, "performance_network", "no_caching", "", "Network request without caching")

        def unreachable() -> DataFrame:
            rows = self.of("has_branch", "symbol", "branch").join(self.having("is_reachable", "true", "branch"), "branch", "left_anti")
            return self._special(rows, "logic_dead_code", "dead_code", "", "Unreachable branch detected")

        def undefined() -> DataFrame:
            rows = calls().join(self.defines.select(F.col("symbol").alias("target")), "target", "left_anti")
            return self._special(rows, "logic_dead_code", "dead_code", "", "Call to undefined function")

        def assigned() -> DataFrame:
            rows = self.of("has_type", "symbol", "t1").join(self.of("assigns_value", "symbol", "value"), "symbol").join(self.of("has_type", "value", "t2"), "value").where("t1 <> t2")
            return self._special(rows, "logic_type_safety", "type_mismatch", "", "Type mismatch in assignment")

        def passed() -> DataFrame:
            need = calls().join(self.of("requires_type", "target", "t1"), "target").select("symbol", "t1").distinct()
            given = self.of("passes_argument", "symbol", "arg").join(self.of("has_type", "arg", "t2"), "arg").select("symbol", "t2").distinct()
            return self._special(need.join(given, "symbol").where("t1 <> t2"), "logic_type_safety", "type_mismatch", "", "Argument type mismatch")

        def null_field() -> DataFrame:
            rows = self.of("accesses_field", "symbol", "field").join(self.having("can_be_null", "true", "field"), "field", "left_semi").join(self.of("checks_null", "symbol", "field"), ["symbol", "field"], "left_anti")
            return self._special(rows, "logic_null_safety", "null_safety", "", "Potential null pointer access")

        def null_return() -> DataFrame:
            rows = none(calls().join(self.having("returns_null", "true", "target"), "target", "left_semi"), "checks_return_null", "symbol")
            return self._special(rows, "logic_null_safety", "null_safety", "", "Unchecked null return value")

        def interface() -> DataFrame:
            rows = self.of("implements_interface", "symbol", "interface").join(self.of("requires_method", "interface", "method"), "interface").join(self.of("implements_method", "symbol", "method"), ["symbol", "method"], "left_anti")
            return self._special(rows, "logic_consistency", "consistency", "", "Missing interface method implementation")

        def schema_field() -> DataFrame:
            # A schema with any field, and an accessed field that the schema does not have.
            used = self.of("uses_schema", "symbol", "schema").join(self.any("has_field", "schema"), "schema", "left_semi")
            rows = used.join(self.of("accesses_field", "symbol", "field"), "symbol").join(self.of("has_field", "schema", "field"), ["schema", "field"], "left_anti")
            return self._special(rows, "logic_consistency", "consistency", "", "Accessing non-existent schema field")

        def state() -> DataFrame:
            rows = self.of("has_state", "symbol", "state").join(self.of("transitions_to", "state", "next"), "state").join(self.having("is_valid_state", "true", "next"), "next", "left_anti")
            return self._special(rows, "logic_temporal", "temporal", "", "Transition to invalid state")

        def guard() -> DataFrame:
            rows = self.of("has_state", "symbol", "state").join(self.of("requires_guard", "state", "guard"), "state").join(self.of("has_guard", "state", "guard"), ["state", "guard"], "left_anti")
            return self._special(rows, "logic_temporal", "temporal", "", "Missing transition guard")

        def specification() -> DataFrame:
            rows = self.of("has_specification", "symbol", "spec").join(self.of("has_property", "spec", "property"), "spec").join(self.of("satisfies_property", "symbol", "property"), ["symbol", "property"], "left_anti")
            return self._special(rows, "logic_formal_verification", "formal_verification", "", "Does not satisfy specification property")

        return {
            "security_csrf": [lambda: csrf("POST"), lambda: csrf("PUT")], "security_xss": [dom], "security_auth_issue": [authorised], "security_dependency_vulnerability": [cve], "quality_error_handling": [unhandled], "performance_concurrency": [lock_order], "performance_network": [uncached],
            "logic_dead_code": [unreachable, undefined], "logic_type_safety": [assigned, passed], "logic_null_safety": [null_field, null_return], "logic_consistency": [interface, schema_field], "logic_temporal": [state, guard], "logic_formal_verification": [specification],
        }

    def findings(self, *names: str) -> DataFrame:
        """file, rule, type, symbol, severity, message: the findings of the named rules, or of a family, or of all."""
        want = lambda rule: not names or any(rule == n or rule.startswith(n + "_") for n in names)
        parts = []
        for text, shape in ((OWN, self.own), (VIA, self.via), (LACKS, self.lacks), (UNPAIRED, self.unpaired), (BAND, self.band), (IMPORT, self.imported)):
            rows = [r for r in table(text) if want(r[0])]
            if rows:
                parts.append(shape(rows))
        parts += [f() for rule, fs in self.specials().items() if want(rule) for f in fs]
        if not parts:
            raise ValueError(f"no rule is named {names}")
        return reduce(DataFrame.unionByName, parts).distinct()

    # --- What is made of findings --------------------------------------------------------------------------------------

    def scan_file(self, family: str) -> DataFrame:
        """file, n_findings, findings: the report of each file with any finding of a family."""
        f = self.findings(family)
        return f.groupBy("file").agg(F.count(F.lit(1)).alias("n_findings"), F.sort_array(F.collect_list(F.struct("rule", "type", "symbol", "message"))).alias("findings"))

    def score(self, family: str, weights: dict[str, float] | None = None) -> DataFrame:
        """file, score: the weighted number of findings of every file that defines or imports anything; 0 without any."""
        w = weights or WEIGHTS[family]
        points = F.lit(0.0)
        for rule, n in w.items():
            points = F.when(F.col("rule") == rule, float(n)).otherwise(points)
        sums = self.findings(*w).groupBy("file").agg(F.sum(points).alias("score"))
        files = self.facts.where("p in ('defines', 'imports')").select(F.col("s").alias("file")).distinct()
        return files.join(sums, "file", "left").select("file", F.coalesce("score", F.lit(0.0)).alias("score"))

    def technical_debt(self) -> DataFrame:
        return self.score("quality", DEBT_HOURS).withColumnRenamed("score", "debt_hours")

    def audit_report(self) -> DataFrame:
        """project, n_findings, n_files: all security findings of a project's files (has_file)."""
        f = self.findings("security").join(self.of("has_file", "project", "file").distinct(), "file")
        return f.groupBy("project").agg(F.count(F.lit(1)).alias("n_findings"), F.count_distinct("file").alias("n_files"))

    def remediation(self, *families: str) -> DataFrame:
        """The findings and what to do about each."""
        look = self._lookup(table(REMEDIATION), "type string, remediation string")
        return self.findings(*families).join(look, "type")

    def smells(self) -> DataFrame:
        """file, smell, n: files with over 50 imports or over 30 definitions."""
        rows = self.facts.where("p in ('imports', 'defines')").where(~F.col("s").contains(":")).groupBy(F.col("s").alias("file"), F.col("p").alias("smell")).agg(F.count_distinct("o").alias("n"))
        return rows.where("(smell = 'imports' and n > 50) or (smell = 'defines' and n > 30)")

    def hubs(self) -> DataFrame:
        """symbol, n_out, n_in: callers of over 10 that are called by over 5."""
        calls = self.of("calls", "a", "b")
        ends = calls.select(F.col("a").alias("symbol"), F.col("b").alias("o"), F.lit(None).cast("string").alias("i")).unionByName(calls.select(F.col("b").alias("symbol"), F.lit(None).cast("string").alias("o"), F.col("a").alias("i")))
        return ends.groupBy("symbol").agg(F.count_distinct("o").alias("n_out"), F.count_distinct("i").alias("n_in")).where("n_out > 10 and n_in > 5")

    def mutual_calls(self) -> DataFrame:
        calls = self.of("calls", "a", "b").where("a <> b").distinct()
        return calls.join(calls.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")

    def layer_violations(self) -> DataFrame:
        """file, target, tag: imports of backend files by files that carry another tag."""
        tags = self.of("has_tag", "file", "tag").where("tag <> 'backend'").distinct()
        backend = self.having("has_tag", "backend", "target")
        return self.of("imports", "file", "target").distinct().join(backend, "target", "left_semi").join(tags, "file").select("file", "target", "tag")

    def chains(self, first: str, *more: str) -> DataFrame:
        """s, o: subjects and what a chain of predicates leads to (metric histories and trends)."""
        rows = self.of(first, "s", "o")
        for p in more:
            rows = rows.join(self.of(p, "o", "n"), "o").select("s", F.col("n").alias("o"))
        return rows.distinct()

    def load_tests(self) -> DataFrame:
        """file, target, scenario, level: endpoints of handlers and executed queries, with the load to try."""
        a = self.having("has_role", "api_handler", "symbol").join(self.of("handles_endpoint", "symbol", "target"), "symbol").select("symbol", "target", F.lit("concurrent_users").alias("scenario"), F.lit(100).alias("level"))
        b = self.of("executes_query", "symbol", "target").select("symbol", "target", F.lit("query_load").alias("scenario"), F.lit(1000).alias("level"))
        return a.unionByName(b).join(self.defines, "symbol").select("file", "target", "scenario", "level").distinct()

    def valid_transitions(self) -> DataFrame:
        rows = self.of("transitions_to", "state", "next").join(self.of("has_guard", "state", "guard"), "state")
        return rows.join(self.having("is_satisfied", "true", "guard"), "guard", "left_semi").select("state", "next", "guard").distinct()

    def fully_implements(self) -> DataFrame:
        """symbol, interface: relational division by two anti joins (an interface without methods is implemented)."""
        claim = self.of("implements_interface", "symbol", "interface").distinct()
        missing = claim.join(self.of("requires_method", "interface", "method"), "interface").join(self.of("implements_method", "symbol", "method"), ["symbol", "method"], "left_anti").select("symbol", "interface")
        return claim.join(missing, ["symbol", "interface"], "left_anti")

    # --- Impact -----------------------------------------------------------------------------------------------------

    def dependencies(self) -> DataFrame:
        """src, dst: calls, imports and used types."""
        if self._dependencies is None:
            # Every traversal and report reads them again.
            self._dependencies = checkpoint(self.facts.where("p in ('calls', 'imports', 'uses_type')").select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct())
        return self._dependencies

    def reverse_dependencies(self) -> DataFrame:
        """symbol, dependent: who calls, imports or uses each thing."""
        return self.dependencies().select(F.col("dst").alias("symbol"), F.col("src").alias("dependent"))

    def dependents(self, symbol: str, depth: int = 1 << 30) -> DataFrame:
        """node: everything that depends on a symbol, however far."""
        return self._reach(symbol, True, depth)

    def depends_on(self, symbol: str, depth: int = 1 << 30) -> DataFrame:
        return self._reach(symbol, False, depth)

    def _reach(self, symbol: str, back: bool, depth: int) -> DataFrame:
        """A traversal is done once for each symbol and direction; what it reached is kept in its checkpoints."""
        key = (symbol, back, depth)
        if key not in self._reached:
            self._reached[key] = (G.callers if back else G.callees)(self.dependencies(), symbol, depth, 1 << 30)
        return self._reached[key].select("node")

    def dependency_depth(self, symbol: str) -> DataFrame:
        """node, depth: everything a symbol depends on, and the number of nodes on the shortest way to it, both ends counted (a direct one: 2)."""
        self.depends_on(symbol)
        return self._reached[symbol, False, 1 << 30].select("node", (F.col("depth") + 1).alias("depth"))

    def affected_files(self, symbol: str) -> DataFrame:
        return self.dependents(symbol).select(F.col("node").alias("symbol")).join(self.defines, "symbol").select("file").distinct()

    def affected_services(self, symbol: str) -> DataFrame:
        return self.affected_files(symbol).join(self.of("belongs_to_service", "file", "service"), "file").select("service").distinct()

    def circular(self, symbol: str) -> DataFrame:
        """node: what a symbol depends on that depends on it."""
        return self.depends_on(symbol).join(self.dependents(symbol), "node", "left_semi")

    def direct_impact(self) -> DataFrame:
        """symbol, impact: the number of things that depend on each defined symbol directly (0 without any)."""
        n = self.dependencies().groupBy(F.col("dst").alias("symbol")).agg(F.count_distinct("src").alias("impact"))
        return self.defines.select("symbol").distinct().join(n, "symbol", "left").select("symbol", F.coalesce("impact", F.lit(0)).alias("impact"))

    def impact_report(self, symbol: str) -> DataFrame:
        """One row: symbol, radius, n_files, n_services, n_cycles, score, prediction, regression_risk."""
        counts = [self.dependents(symbol).agg(F.count(F.lit(1)).alias("radius")), self.affected_files(symbol).agg(F.count(F.lit(1)).alias("n_files")), self.affected_services(symbol).agg(F.count(F.lit(1)).alias("n_services")), self.circular(symbol).agg(F.count(F.lit(1)).alias("n_cycles"))]
        row = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), counts)
        a, b, c = IMPACT_WEIGHTS
        risk = F.when((F.col("radius") > 20) & (F.col("n_services") > 2), "high_risk").when((F.col("radius") > 10) & (F.col("radius") <= 20) & (F.col("n_services") <= 2), "medium_risk").when(F.col("radius") <= 10, "low_risk")
        return row.select(F.lit(symbol).alias("symbol"), "radius", "n_files", "n_services", "n_cycles", (F.col("radius") * a + F.col("n_services") * b + F.col("n_cycles") * c).alias("score"), F.when(F.col("radius") > 50, "high_impact").when(F.col("radius") > 10, "medium_impact").otherwise("low_impact").alias("prediction"), risk.alias("regression_risk"))

    def impact_remediation(self, symbol: str) -> DataFrame:
        """symbol, type, description, remediation: what to do about a symbol's cycles and about the predicted impact of changing it."""
        loops = self.circular(symbol).select(F.lit(symbol).alias("symbol"), F.lit("circular_dependency").alias("type"), F.col("node").alias("description"))
        predicted = self.impact_report(symbol).select("symbol", F.col("prediction").alias("type"), F.concat(F.col("radius"), F.lit(" dependents")).alias("description"))
        return loops.unionByName(predicted).join(self._lookup(table(REMEDIATION), "type string, remediation string"), "type").select("symbol", "type", "description", "remediation")

    def metrics_history(self, predicate: str) -> DataFrame:
        """s, at, value: the measurements of a family (has_quality_metric, has_impact_metric, ...)."""
        m = self.of(predicate, "s", "metric").join(self.of("has_timestamp", "metric", "at"), "metric").join(self.of("has_value", "metric", "value"), "metric")
        return m.select("s", "at", "value").distinct()

    def tests_for(self, symbol: str) -> DataFrame:
        """test: the tests of everything that depends on a symbol and of the files it is in."""
        things = self.dependents(symbol).select(F.col("node").alias("s")).unionByName(self.affected_files(symbol).select(F.col("file").alias("s"))).distinct()
        return self.of("has_test", "s", "test").join(things, "s", "left_semi").select("test").distinct()

    def dependency_graph(self, symbol: str) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of the defined symbols a symbol depends on."""
        nodes = self.depends_on(symbol).join(self.defines.select(F.col("symbol").alias("node")), "node", "left_semi").distinct()
        edges = self.dependencies().join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
        return nodes, edges

    def critical_paths(self, symbol: str, longest: int = 3) -> DataFrame:
        """path, length: the simple paths from a symbol to something critical."""
        paths = G.paths_from(self.dependencies(), symbol, longest)
        return paths.withColumn("node", F.element_at("path", -1)).join(self.having("is_critical", "true", "node"), "node", "left_semi").select("path", "length")


# Roles, tags and name parts that make a fact worth keeping for good.
STICKY_ROLES = ("api_gateway", "authenticator", "main", "init", "public")
STICKY_TAGS = ("exported", "api")


def sticky(facts: DataFrame) -> DataFrame:
    """s, p, o: the facts that belong to the lasting partition."""
    from factweave.functions.text import is_attention_worthy

    roles = facts.where(F.col("p").eqNullSafe("has_role") & F.col("o").isin(*STICKY_ROLES) | F.col("p").eqNullSafe("has_tag") & F.col("o").isin(*STICKY_TAGS)).select(F.col("s").alias("o"))
    defines = facts.where("p = 'defines'")
    by_role = defines.join(roles.distinct(), "o", "left_semi").select("s", "p", "o")
    by_name = defines.where(is_attention_worthy(short_name("o"))).select("s", "p", "o")
    risky = facts.where("p = 'has_security_risk'").select("s", "p", "o")
    return by_role.unionByName(by_name).unionByName(risky).distinct()


# The named queries, their category, tier, severity and description.
CATALOGUE = [RuleInfo(*r) for r in (
    ("find_defines", "structural", 1, None, "Find all symbols defined in a file"), ("find_imports", "structural", 1, None, "Find all imports for a file"), ("smell_circular_direct", "smell", 1, "high", "Detect mutual call pairs (A calls B and B calls A)"), ("smell_imports", "smell", 1, None, "List files with imports"),
    ("smell_defines", "smell", 1, None, "List files with definitions"), ("smell_god_file", "smell", 1, "medium", "Detect files with excessive imports (>50) or definitions (>30)"), ("smell_hub", "smell", 1, "medium", "Detect hub files with high out-degree (>10) and in-degree (>5)"), ("smell_layer_violation", "smell", 1, "high", "Detect cross-layer dependency violations"),
    ("security_sql_injection", "security", 2, "critical", "Detect potential SQL injection vulnerabilities"), ("security_xss", "security", 2, "high", "Detect potential XSS vulnerabilities"), ("security_csrf", "security", 2, "high", "Detect potential CSRF vulnerabilities"), ("security_secret_leak", "security", 2, "critical", "Detect hardcoded secrets and credentials"),
    ("security_dangerous_pattern", "security", 2, "high", "Detect dangerous code patterns"), ("security_dependency_vulnerability", "security", 2, "high", "Detect vulnerable dependencies"), ("security_weak_crypto", "security", 2, "high", "Detect weak cryptographic practices"), ("security_auth_issue", "security", 2, "critical", "Detect authentication and authorization issues"),
    ("quality_cyclomatic_complexity", "quality", 2, "medium", "Detect high cyclomatic complexity"), ("quality_code_duplication", "quality", 2, "medium", "Detect code duplication"), ("quality_documentation", "quality", 2, "low", "Detect documentation gaps"), ("quality_test_coverage", "quality", 2, "medium", "Detect test coverage gaps"),
    ("quality_fpt_standards", "quality", 2, "medium", "Detect violations of the coding standard"), ("quality_code_smell", "quality", 2, "medium", "Detect code smells"), ("quality_dependency", "quality", 2, "medium", "Detect dependency issues"), ("quality_error_handling", "quality", 2, "medium", "Detect error handling issues"),
    ("performance_bottleneck", "performance", 2, "high", "Detect potential performance bottlenecks"), ("performance_memory_leak", "performance", 2, "high", "Detect potential memory leaks"), ("performance_concurrency", "performance", 2, "critical", "Detect concurrency issues"), ("performance_database", "performance", 2, "high", "Detect database query performance issues"),
    ("performance_network", "performance", 2, "medium", "Detect network performance issues"), ("performance_algorithm", "performance", 2, "medium", "Detect algorithmic inefficiencies"), ("performance_resource", "performance", 2, "medium", "Detect resource usage issues"),
    ("logic_dead_code", "logic", 2, "medium", "Detect dead code and unreachable branches"), ("logic_type_safety", "logic", 2, "high", "Detect type safety issues"), ("logic_null_safety", "logic", 2, "high", "Detect null safety issues"), ("logic_contract_violation", "logic", 2, "high", "Detect contract violations"),
    ("logic_consistency", "logic", 3, "high", "Detect consistency issues across components"), ("logic_temporal", "logic", 3, "high", "Detect temporal logic issues in state machines"), ("logic_formal_verification", "logic", 3, "critical", "Verify against formal specifications"),
    # Reports and analyses; those of one symbol take the parameter symbol.
    ("impact_direct_dependencies", "impact", 1, None, "Find direct dependencies of a symbol"), ("impact_transitive_dependencies", "impact", 2, None, "Find all transitive dependencies"), ("impact_reverse_dependencies", "impact", 1, None, "Find what depends on a symbol"), ("impact_transitive_reverse_dependencies", "impact", 2, None, "Find all transitive reverse dependencies"),
    ("impact_blast_radius", "impact", 2, None, "Calculate blast radius for a change"), ("impact_affected_files", "impact", 2, None, "Find files affected by a change"), ("impact_affected_services", "impact", 3, None, "Find services affected by a change"), ("impact_critical_path", "impact", 3, None, "Find critical path dependencies"),
    ("impact_circular_dependency", "impact", 2, "high", "Detect circular dependencies"), ("impact_dependency_depth", "impact", 2, None, "Calculate dependency depth"), ("impact_high_impact_symbols", "impact", 2, None, "Find high-impact symbols"), ("impact_low_impact_symbols", "impact", 2, None, "Find low-impact symbols"),
    ("impact_analysis_symbol", "impact", 3, None, "Perform comprehensive impact analysis for a symbol"), ("impact_risk_score", "impact", 3, None, "Calculate impact risk score for a change"), ("impact_change_prediction", "impact", 3, None, "Predict impact of a code change"), ("impact_regression_risk", "impact", 3, None, "Assess regression risk for a change"),
    ("impact_test_selection", "impact", 3, None, "Select tests to run based on impact"), ("impact_dependency_graph", "impact", 3, None, "Generate dependency graph data for visualization"), ("impact_remediation", "impact", 2, None, "Get remediation suggestions for impact issues"), ("impact_metrics_history", "impact", 3, None, "Track impact metrics over time"), ("impact_trend", "impact", 3, None, "Calculate impact trend for a symbol"),
    ("logic_scan_file", "logic", 3, None, "Perform comprehensive logic and consistency scan"), ("logic_consistency_score", "logic", 3, None, "Calculate logic consistency score for a file"), ("logic_remediation", "logic", 2, None, "Get remediation suggestions for logic issues"),
    ("performance_scan_file", "performance", 3, None, "Perform comprehensive performance scan"), ("performance_risk_score", "performance", 3, None, "Calculate performance risk score for a file"), ("performance_remediation", "performance", 2, None, "Get remediation suggestions for performance issues"), ("performance_load_test_scenario", "performance", 3, None, "Generate load testing scenarios"), ("performance_historical_analysis", "performance", 3, None, "Analyze historical performance trends"),
    ("quality_scan_file", "quality", 3, None, "Perform comprehensive quality scan"), ("quality_score", "quality", 3, None, "Calculate quality score for a file (SQALE model)"), ("quality_technical_debt", "quality", 3, None, "Calculate technical debt in hours"), ("quality_remediation", "quality", 2, None, "Get remediation suggestions for quality issues"), ("quality_metrics_history", "quality", 3, None, "Track quality metrics over time"), ("quality_trend", "quality", 3, None, "Calculate quality trend for a file"),
    ("security_scan_file", "security", 3, "critical", "Perform comprehensive security scan on a file"), ("security_risk_score", "security", 3, None, "Calculate security risk score for a file"), ("security_audit_report", "security", 3, None, "Generate comprehensive security audit report"), ("security_remediation", "security", 2, None, "Get remediation suggestions for vulnerabilities"),
    # Helpers that the analyses share.
    ("logic_valid_transitions", "logic", 2, None, "State transitions whose guard is satisfied"), ("logic_implements_interface", "logic", 2, None, "Symbols that have every method of an interface"), ("logic_satisfied_properties", "logic", 2, None, "Properties a symbol satisfies"), ("logic_maintained_invariants", "logic", 2, None, "Invariants a symbol maintains"),
)]


def _dependency_graph(r: Rules, symbol: str) -> DataFrame:
    """src, dst: the edges, and a row without dst for each node."""
    nodes, edges = r.dependency_graph(symbol)
    return edges.unionByName(nodes.select(F.col("node").alias("src"), F.lit(None).cast("string").alias("dst")))


#: How the named reports are made: of all symbols, or of one.
REPORTS: dict[str, Callable[[Rules], DataFrame]] = {
    **{f"{f}_scan_file": lambda r, f=f: r.scan_file(f) for f in WEIGHTS}, **{f"{f}_remediation": lambda r, f=f: r.remediation(f) for f in WEIGHTS},
    "security_risk_score": lambda r: r.score("security"), "quality_score": lambda r: r.score("quality"), "performance_risk_score": lambda r: r.score("performance"), "logic_consistency_score": lambda r: r.score("logic"),
    "security_audit_report": Rules.audit_report, "quality_technical_debt": Rules.technical_debt, "quality_metrics_history": lambda r: r.metrics_history("has_quality_metric"), "quality_trend": lambda r: r.chains("has_quality_metric", "has_trend"),
    "performance_load_test_scenario": Rules.load_tests, "performance_historical_analysis": lambda r: r.chains("has_performance_metric", "has_history", "trend"), "impact_metrics_history": lambda r: r.metrics_history("has_impact_metric"), "impact_trend": lambda r: r.chains("has_impact_metric", "has_trend"),
    "impact_direct_dependencies": Rules.dependencies, "impact_reverse_dependencies": Rules.reverse_dependencies, "impact_high_impact_symbols": lambda r: r.direct_impact().where("impact > 10"), "impact_low_impact_symbols": lambda r: r.direct_impact().where("impact <= 2"),
    "smell_god_file": Rules.smells, "smell_hub": Rules.hubs, "logic_valid_transitions": Rules.valid_transitions, "logic_implements_interface": Rules.fully_implements, "logic_satisfied_properties": lambda r: r.of("satisfies_property", "symbol", "property").distinct(), "logic_maintained_invariants": lambda r: r.of("maintains_invariant", "symbol", "invariant").distinct(),
}
SYMBOL_REPORTS: dict[str, Callable[[Rules, str], DataFrame]] = {
    "impact_transitive_dependencies": Rules.depends_on, "impact_transitive_reverse_dependencies": Rules.dependents, "impact_blast_radius": lambda r, s: r.dependents(s).agg(F.count(F.lit(1)).alias("radius")), "impact_affected_files": Rules.affected_files, "impact_affected_services": Rules.affected_services, "impact_critical_path": Rules.critical_paths,
    "impact_circular_dependency": Rules.circular, "impact_dependency_depth": Rules.dependency_depth, "impact_analysis_symbol": Rules.impact_report, "impact_risk_score": lambda r, s: r.impact_report(s).select("symbol", "score"), "impact_change_prediction": lambda r, s: r.impact_report(s).select("symbol", "prediction"), "impact_regression_risk": lambda r, s: r.impact_report(s).select("symbol", "regression_risk"),
    "impact_test_selection": Rules.tests_for, "impact_dependency_graph": _dependency_graph, "impact_remediation": Rules.impact_remediation,
}
