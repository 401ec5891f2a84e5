"""The query language: splitting, parsing, modifiers and what a query means on small facts."""

import pytest
from conftest import rows

from factweave.plans import datalog as D
from factweave.plans.compiler import compile_query

FACTS = [("main.go", "defines", "main"), ("main.go", "has_kind", "file"), ("main.go", "imports", "fmt"), ("utils.go", "defines", "helper"), ("a", "calls", "b"), ("b", "calls", "c"), ("b", "calls", "a"), ("c", "calls", "c"), ("x", "val", "10"), ("y", "val", "9"), ("z", "val", "text"), ("x", "cat", "A"), ("y", "cat", "A"), ("z", "cat", "B"), ("Execute", "calls", "b")]


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(FACTS, "s string, p string, o string").cache()


@pytest.mark.parametrize("text,parts", [("a, b, c", ["a", "b", "c"]), ('triples(A, "x,y", B), c', ['triples(A, "x,y", B)', "c"]), ("f(a, g(b, c)), d", ["f(a, g(b, c))", "d"]), ("", [])])
def test_split(text, parts):
    assert D.split_top(text) == parts


@pytest.mark.parametrize(
    "text,shape",
    [
        ('triples(?s, "calls", ?o)', [("triples", ["s", "calls", "o"])]), ('Head(X) :- triples(X, "calls", Y).', [("triples", ["X", "calls", "Y"])]), ('triples(A, "calls", B), A != B', [("triples", ["A", "calls", "B"]), ("neq", ["A", "B"])]),
        ('triples(?s, ?p, ?o), regex(?o, "Test.*")', [("triples", ["s", "p", "o"]), ("regex", ["o", "Test.*"])]), ("?calls(?a, ?b)".lstrip("?"), [("triples", ["a", "calls", "b"])]),
    ],
)
def test_parse(text, shape):
    assert [(a.predicate, [x.text for x in a.args]) for a in D.parse(text).atoms] == shape


@pytest.mark.parametrize("text", ["", "triples(?s, ?p)", "nonsense(?a, ?b)", 'triples(?s, "p", ?o', "triples(?s, ?p, ?o) LIMIT", 'triples(?a "x" ?b)'])
def test_errors(text):
    with pytest.raises((D.QueryError, ValueError)):
        D.parse(text)


def test_modifiers():
    q = D.parse('triples(?s, "p", ?o) GROUP BY ?s COUNT(*) AS n, SUM(?o) AS t ORDER BY n DESC, ?s ASC LIMIT 5 OFFSET 2')
    assert q.group_by == ("s",) and q.aggregates == (("COUNT", "*", "n"), ("SUM", "o", "t")) and q.order_by == (("n", True), ("s", False)) and (q.limit, q.offset) == (5, 2)
    assert D.parse(str(q)) == q and D.parse('triples(?s, "p", ?o) LIMIT 0').limit is None


def test_quoted_capital_is_a_constant(facts):
    assert rows(compile_query('triples("Execute", "calls", ?x)', facts)) == [("b",)]


@pytest.mark.parametrize(
    "text,want",
    [
        ('triples("main.go", ?p, ?o)', [("defines", "main"), ("has_kind", "file"), ("imports", "fmt")]), ('triples(?a, "calls", ?b), triples(?b, "calls", ?a), ?a != ?b', [("a", "b"), ("b", "a")]), ('triples(?a, "calls", ?a)', [("c",)]), ('triples(?s, "calls", "nobody")', []),
        ('triples(?f, "calls", _), not triples(_, "calls", ?f)', [("Execute",)]), ('triples(?s, "defines", ?o), regex(?o, "^h")', [("utils.go", "helper")]), ('triples(?s, "val", ?n), ?n > 9', [("x", "10"), ("z", "text")]), ('triples(?s, "val", ?n), contains(?n, "ex")', [("z", "text")]),
        ('triples(?s, "defines", ?o), triples("main.go", "has_kind", "file")', [("main.go", "main"), ("utils.go", "helper")]), ('triples(?s, "defines", ?o), triples("main.go", "has_kind", "dir")', []),
    ],
)
def test_meaning(facts, text, want):
    got = compile_query(text, facts)
    order = [v for a in D.parse(text).triples() for v in a.variables()]
    assert rows(got, *dict.fromkeys(v for v in order if v in got.columns)) == sorted(want)


def test_order_is_null_number_text(facts):
    assert [r[0] for r in compile_query('triples(?s, "val", ?n) ORDER BY ?n', facts).select("n").collect()] == ["9", "10", "text"]
    assert [r[0] for r in compile_query('triples(?s, "val", ?n) ORDER BY ?n DESC', facts).select("n").collect()] == ["text", "10", "9"]


def test_aggregates(facts):
    got = compile_query('triples(?s, "val", ?n), triples(?s, "cat", ?c) GROUP BY ?c COUNT(*) AS k, SUM(?n) AS t, MIN(?n) AS lo', facts)
    assert rows(got, "c", "k", "t", "lo") == [("A", 2, 19.0, 9.0), ("B", 1, 0.0, None)]
    assert rows(compile_query('triples(?a, "calls", ?b) COUNT(*) AS n', facts)) == [(5,)]


def test_unbound_variables_and_negation_order(facts):
    for text in ('triples(?a, "calls", ?b), ?z != ?a', 'not triples(?a, "calls", ?b)'):
        with pytest.raises(D.QueryError):
            compile_query(text, facts)
    assert D.validate('triples(?a, "calls", ?b), ?z != ?a') and D.validate('{"tool": "find_path"}') is None and D.validate("f(") and D.validate('calls(?a, ?b)') is None


def test_builders_parse():
    for text in (D.defines_of("a"), D.imports_of("a"), D.calls_of('x"y'), D.callers_of("a"), D.all_of("p"), D.of_type("file"), D.with_kind("func"), D.with_tag("t"), D.calls_between("a", "b"), D.internal_calls("a"), D.in_package("p"), D.outgoing("n"), D.incoming("n"), D.handlers_of("/r"), D.imports_only(), D.all_calls()):
        assert D.validate(text) is None
