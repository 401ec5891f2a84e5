"""From the syntax tree to a DataFrame: joins in a connected, most-bound-first order; Catalyst and AQE do the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import number_of
from factweave.plans.datalog import Atom, Query, QueryError, parse
from factweave.schema import RESULT_LIMIT


def pattern(facts: DataFrame, atom: Atom, tag: str = "") -> DataFrame:
    """The bindings of one triple pattern: a pruned scan and a projection on its variables, each binding once."""
    cond, names = F.lit(True), {}
    for col, a in zip(("s", "p", "o"), atom.args, strict=True):
        if a.kind == "c":
            cond = cond & (F.col(col) == a.text)
        elif a.kind == "v":
            if a.text in names:
                cond = cond & F.col(col).eqNullSafe(F.col(names[a.text]))
            else:
                names[a.text] = col
    rows = facts.where(cond)
    if not names:
        return rows.limit(1).select(F.lit(True).alias(f"__there{tag}"))
    picked = rows.select(*(F.col(c).alias(v) for v, c in names.items()))
    # A fact is in the table once, so dropping a place without a variable is all that can repeat a binding.
    whole = len([a for a in atom.args if a.kind == "_"]) == 0
    return picked if whole else picked.distinct()


def order_atoms(atoms: list[Atom]) -> list[Atom]:
    """Connected before unconnected (no accidental cross joins), and among those the one with most constants first."""
    rest, out, seen = list(atoms), [], set()
    while rest:
        rank = lambda a: (bool(seen & set(a.variables())) or not seen, sum(x.kind == "c" for x in a.args), -len(a.variables()))
        best = max(rest, key=lambda a: (rank(a), -rest.index(a)))
        rest.remove(best)
        out.append(best)
        seen |= set(best.variables())
    return out


def constraint(atom: Atom, columns: set[str]) -> Column:
    """A filter of two terms; comparisons by number where both sides are numbers, else by text."""
    def value(i: int) -> Column:
        t = atom.args[i]
        if t.kind == "v" and t.text not in columns:
            raise QueryError(f"variable ?{t.text} is in no positive pattern")
        return F.col(t.text) if t.kind == "v" else F.lit(t.text)

    a, b = value(0), value(1)
    name = atom.predicate
    if name in ("eq", "neq"):
        out = a == b if name == "eq" else a != b
    elif name == "regex":
        out = F.regexp_like(a, b)
    elif name == "contains":
        out = F.contains(a, b)
    elif name == "starts_with":
        out = F.startswith(a, b)
    else:
        x, y = number_of(a), number_of(b)
        both = x.isNotNull() & y.isNotNull()
        by = {"gt": (x > y, a > b), "lt": (x < y, a < b), "ge": (x >= y, a >= b), "le": (x <= y, a <= b)}[name]
        out = F.when(both, by[0]).otherwise(by[1])
    return ~out if atom.negated else out


def compile_query(query: Query | str, facts: DataFrame, limit: int | None = None) -> DataFrame:
    """The rows of a query over facts(s, p, o): one text column a variable, without the question mark.

    Without modifiers the rows are the distinct bindings of all variables of the positive patterns. ``limit`` caps rows after
    every filter (the service uses 1000); the query's own LIMIT holds besides.
    """
    q = parse(query) if isinstance(query, str) else query
    facts = facts.select("s", "p", "o")
    positive = order_atoms(q.triples())
    if not positive:
        raise QueryError("a query needs at least one positive pattern")
    bound: DataFrame | None = None
    checks = []
    for i, atom in enumerate(positive):
        one = pattern(facts, atom, str(i))
        if not atom.variables():
            checks.append(one)
            continue
        if bound is None:
            bound = one
            continue
        shared = [v for v in atom.variables() if v in bound.columns]
        # Patterns without a common variable are independent conditions: their combinations are what was asked for.
        bound = bound.join(one, shared, "inner") if shared else bound.crossJoin(one)
    if bound is None:
        return checks[0].select() if not checks[1:] else reduce(lambda a, b: a.crossJoin(b), checks).select()
    for c in checks:
        bound = bound.join(F.broadcast(c), F.lit(True), "left_semi")
    columns = set(bound.columns)
    for atom in q.atoms:
        if atom.predicate != "triples":
            bound = bound.where(constraint(atom, columns))
    for i, atom in enumerate(a for a in q.atoms if a.predicate == "triples" and a.negated):
        missing = pattern(facts, atom, f"n{i}")
        shared = [v for v in atom.variables() if v in columns]
        if shared:
            bound = bound.join(missing.select(*shared).distinct(), shared, "left_anti")
        else:
            bound = bound.join(F.broadcast(missing.limit(1)), F.lit(True), "left_anti")
    return modify(q, bound, limit)


def modify(q: Query, rows: DataFrame, limit: int | None = None) -> DataFrame:
    """GROUP BY, aggregates, ORDER BY, OFFSET and LIMIT over rows of text columns."""
    if q.aggregates or q.group_by:
        known = set(rows.columns)
        for v in (*q.group_by, *(a[1] for a in q.aggregates if a[1] != "*")):
            if v not in known:
                raise QueryError(f"unknown variable ?{v}")
        outs = []
        for fn, var, name in q.aggregates or (("COUNT", "*", "count"),):
            x = number_of(var) if var != "*" else None
            outs.append((F.count(F.lit(1)) if fn == "COUNT" else F.coalesce(F.sum(x), F.lit(0.0)) if fn == "SUM" else {"MIN": F.min, "MAX": F.max, "AVG": F.avg}[fn](x)).alias(name))
        rows = rows.groupBy(*q.group_by).agg(*outs)
    if q.order_by:
        keys: list[Column] = []
        types = dict(rows.dtypes)
        for v, down in q.order_by:
            if v not in types:
                raise QueryError(f"unknown variable ?{v}")
            num = number_of(v) if types[v] == "string" else F.col(v).cast("double")
            # Nulls first, then numbers by value, then text; the reverse for DESC.
            parts = [F.col(v).isNotNull(), num.isNull(), num, F.col(v)]
            keys += [p.desc() if down else p.asc() for p in parts]
        rows = rows.orderBy(*keys)
    if q.offset:
        rows = rows.offset(q.offset)
    for n in (q.limit, limit):
        if n:
            rows = rows.limit(n)
    return rows


def run(query: str, facts: DataFrame) -> DataFrame:
    """A query as the service answers it: at most 1000 rows."""
    return compile_query(query, facts, RESULT_LIMIT)
