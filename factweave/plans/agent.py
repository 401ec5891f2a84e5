"""Plans of several steps: each step is a query whose bindings later steps may use."""

from __future__ import annotations

import json
import re
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.plans.compiler import compile_query
from factweave.plans.datalog import QueryError, Term, parse

_REF = re.compile(r"[\"']?(?:\{\{step_(\d+)_(\w+)\}\}|\$(\d+)\.(\w+))[\"']?")
# Words that an action must not contain, and the sizes it must keep to.
BLOCKED = ("drop", "delete", "truncate", "exec", "system(", "rm -rf")
MAX_CHARS, MAX_ITEMS, MAX_ROWS = 8000, 50, 5000


@dataclass
class Step:
    id: int
    task: str
    query: str
    explanation: str = ""
    status: str = "pending"
    error: str | None = None
    result: DataFrame | None = field(default=None, repr=False)


def read_plan(text: str) -> list[Step]:
    """Steps from JSON: a list of {id, task, query, explanation}, perhaps in a code fence."""
    body = re.sub(r"^```\w*\s*|\s*```$", "", text.strip())
    try:
        rows = json.loads(body)
    except ValueError as e:
        raise QueryError(f"the plan is no JSON: {e}") from e
    rows = rows.get("steps", []) if isinstance(rows, dict) else rows
    return [Step(int(r.get("id", i + 1)), str(r.get("task", "")), str(r.get("query", "")), str(r.get("explanation", ""))) for i, r in enumerate(rows)]


def bindings(rows: DataFrame, variable: str) -> DataFrame:
    """The distinct values of one variable of a step."""
    return rows.select(variable).distinct()


def verify(action: str, items: int = 0) -> str | None:
    """None if an action may run, else why not."""
    low = action.lower()
    if len(action) > MAX_CHARS:
        return f"longer than {MAX_CHARS} characters"
    if items > MAX_ITEMS:
        return f"more than {MAX_ITEMS} items"
    return next((f"contains {w!r}" for w in BLOCKED if w in low), None)


class Plan:
    """Runs steps in order. A reference to an earlier step's variable becomes a join on that column, so nothing is collected.

    A step fails if its rows are not counted within ``seconds`` or are more than ``most`` (None: no bound): a breaker against plans
    whose joins explode, not a cut of their rows.
    """

    def __init__(self, facts: DataFrame, steps: list[Step], seconds: float | None = 60.0, most: int | None = MAX_ROWS):
        self.facts, self.steps, self.seconds, self.most = facts, {s.id: s for s in steps}, seconds, most

    def _guarded(self, step: Step) -> int:
        """The number of the step's rows, as far as it matters; the job is cancelled when its time is over."""
        sc, tag = self.facts.sparkSession.sparkContext, f"step-{uuid.uuid4().hex}"
        over = threading.Event()

        def stop() -> None:
            over.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(self.seconds, stop) if self.seconds is not None else None
        sc.addJobTag(tag)
        try:
            if timer:
                timer.start()
            n = step.result.limit(1 if self.most is None else self.most + 1).count()
        except Exception as e:
            if over.is_set():
                raise QueryError(f"timed out after {self.seconds} seconds") from e
            raise
        finally:
            if timer:
                timer.cancel()
            sc.removeJobTag(tag)
        if self.most is not None and n > self.most:
            raise QueryError(f"more than {self.most} rows")
        return n

    def _linked(self, step: Step) -> tuple[str, list[tuple[str, int, str]]]:
        links: list[tuple[str, int, str]] = []

        def name(m: re.Match) -> str:
            n, var = int(m[1] or m[3]), m[2] or m[4]
            links.append((f"ref{len(links)}", n, var))
            return f"?ref{len(links) - 1}"

        return _REF.sub(name, step.query), links

    def run(self, step: Step) -> DataFrame:
        text, links = self._linked(step)
        rows = compile_query(text, self.facts)
        for column, n, var in links:
            earlier = self.steps.get(n)
            if earlier is None or earlier.result is None:
                raise QueryError(f"step {n} has no result")
            if var == "result":
                var = earlier.result.columns[0]
            if var not in earlier.result.columns:
                raise QueryError(f"step {n} has no variable {var}")
            rows = rows.join(bindings(earlier.result, var).withColumnRenamed(var, column), column, "left_semi")
        return rows

    def execute(self, correct: Callable[[Step, str], str | None] | None = None) -> list[Step]:
        """Run all steps. One that fails or finds nothing is tried once more: by ``correct``, else with its constants widened."""
        for step in sorted(self.steps.values(), key=lambda s: s.id):
            step.status = "running"
            try:
                step.result = self.run(step)
                if self._guarded(step) == 0:
                    raise LookupError("no rows")
                step.status = "success"
            except (QueryError, LookupError) as e:
                again = correct(step, str(e)) if correct else widen(step.query) if isinstance(e, LookupError) else None
                if not again or again == step.query:
                    step.status, step.error = ("success", None) if isinstance(e, LookupError) else ("failed", str(e))
                    continue
                try:
                    step.query = again
                    step.result = self.run(step)
                    self._guarded(step)
                    step.status = "corrected"
                except QueryError as f:
                    step.status, step.error = "failed", str(f)
        return list(self.steps.values())


def widen(query: str) -> str | None:
    """The query with the constant subjects and objects of its patterns made variables; predicates stay."""
    try:
        q = parse(query)
    except QueryError:
        return None
    n = 0
    atoms = []
    for a in q.atoms:
        args = list(a.args)
        if a.predicate == "triples" and not a.negated:
            for i in (0, 2):
                if args[i].kind == "c":
                    args[i] = Term("v", f"any{n}")
                    n += 1
        atoms.append(type(a)(a.predicate, tuple(args), a.negated))
    return str(type(q)(tuple(atoms), q.group_by, q.aggregates, q.order_by, q.limit, q.offset, q.head)) if n else None


def narrative(steps: list[Step]) -> str:
    """What a plan did, in words."""
    done = sum(s.status in ("success", "corrected") for s in steps)
    return "\n".join([f"{done} of {len(steps)} steps succeeded.", *(f"{s.id}. {s.task}: {s.status}" + (f" ({s.error})" if s.error else "") for s in steps)])


def orient(facts: DataFrame, candidates: DataFrame, threshold: float = 0.05, most: int = 8) -> DataFrame:
    """The candidates (column symbol_id) worth attention: of a centrality over the threshold, at most ``most``."""
    from factweave.operators.centrality import centrality

    scored = centrality(facts, attention=True).join(candidates.select("symbol_id").distinct(), "symbol_id", "left_semi")
    return scored.where(F.col("centrality") >= threshold).orderBy(F.col("centrality").desc(), "symbol_id").limit(most)


# The tasks of the loop.
TASKS = ("insight", "chat", "prune", "summary", "narrative", "resolve_symbol", "path_endpoints", "datalog", "path_narrative", "smart_search_analysis", "multi_file_summary", "refactor", "test_generation", "security_audit", "performance")
#: What an intent of a plain question is done by.
_BY_INTENT = {"who_calls": "resolve_symbol", "what_calls": "resolve_symbol", "find": "resolve_symbol", "how_reaches": "path_narrative", "summarize": "summary", "explain": "narrative", "security_audit": "security_audit", "refactor": "refactor", "test_generation": "test_generation", "performance": "performance"}
#: Words that speak for a task, with their weight; the intent of the question weighs INTENT_WEIGHT. The heaviest task wins, then the earlier one.
_WORDS = {
    "insight": (("architecture", 6), ("architectural", 6), ("component", 3), ("components", 3), ("coupling", 6), ("dependencies", 4), ("design", 3)), "prune": (("prune", 9), ("important", 4), ("key", 3), ("top", 4), ("central", 5)),
    "narrative": (("flow", 6), ("sequence", 5), ("happens", 5)), "path_endpoints": (("endpoint", 8), ("endpoints", 8), ("route", 6), ("routes", 6), ("api", 4)), "datalog": (("datalog", 10), ("triples", 9)),
    "smart_search_analysis": (("similar", 6), ("semantic", 6), ("results", 3)), "multi_file_summary": (("compare", 6), ("files", 3), ("across", 4)),
}
INTENT_WEIGHT = 5


def task_of(request: str) -> str:
    """The task a request asks for: its intent and its words, weighed; chat if nothing speaks for any."""
    from factweave.plans.nl import classify

    words = set(re.findall(r"[a-z]+", request.lower()))
    weight = dict.fromkeys(TASKS, 0)
    weight[_BY_INTENT.get(classify(request).name, "chat")] += INTENT_WEIGHT
    for task, cues in _WORDS.items():
        weight[task] += sum(w for word, w in cues if word in words)
    weight["chat"] = min(weight["chat"], 1)
    return max(TASKS, key=lambda t: (weight[t], -TASKS.index(t)))


@dataclass
class Turn:
    """What one turn of the loop knows: request, task, names, the symbols worth attention, the action and its outcome."""

    request: str
    task: str = "chat"
    names: list[str] = field(default_factory=list)
    attention: list[tuple[str, float]] = field(default_factory=list)
    action: str = ""
    refused: str | None = None
    outcome: str | None = None


class Loop:
    """observe, orient, decide, verify, act. ``find`` gives the symbols of a name (column symbol), ``act`` does the action of a verified turn."""

    def __init__(self, facts: DataFrame, find: Callable[[str], DataFrame], act: Callable[[Turn], str]):
        self.facts, self.find, self.act = facts, find, act

    def run(self, request: str) -> Turn:
        from factweave.plans.nl import classify

        turn = Turn(request, task_of(request), list(classify(request).targets))
        candidates = None
        for name in turn.names:
            rows = self.find(name).select(F.col("symbol").alias("symbol_id"))
            candidates = rows if candidates is None else candidates.unionByName(rows)
        if candidates is not None:
            turn.attention = [(r["symbol_id"], r["centrality"]) for r in orient(self.facts, candidates).collect()]
        turn.action = json.dumps({"task": turn.task, "request": request, "symbols": [s for s, _ in turn.attention]}, ensure_ascii=False)
        turn.refused = verify(turn.action, len(turn.attention))
        if turn.refused is None:
            turn.outcome = self.act(turn)
        return turn
