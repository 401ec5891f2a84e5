"""P2: what counts as documentation, where it is found, and inheritance."""

import pytest
from conftest import rows

from factweave.llm.documented import describe, document_pairs, words_of

S = "symbol_key long, symbol_id string, symbol_name string, symbol_kind string, receiver_type string, signature string, doc_comment string, symbol_content string, description string"


@pytest.mark.parametrize("raw", ["// Merges the cached results.", "/**\n * Collects stale rows.\n * TODO: measure this\n */", "Loads the file and reports the first failure", "# Сливает обе части до запуска.", "// 控制台在队列清空之后读取事实。", '"""Returns the number of open sessions."""', "// Sorts rows. FIXME later.", "/** Emits the plan (`f(x)`) of a question. */", "// runJob counts open sessions"])
def test_statements(raw):
    assert describe(raw, words_of("runJob"))[0]


@pytest.mark.parametrize("raw", ["", None, "//", "// TODO: write docs", "// runJob.", "// Run job", "// runJob run job", "// see above", "-", "======", "// n/a", "//nolint:errcheck", "//go:noinline", "# noqa: E501", "// Copyright 2031 The Authors. All rights reserved.", "// SPDX-License-Identifier: MIT", "/**\n * @param x\n * @returns\n */", ":param x:\n:returns:", "// if err := s.flush(ctx); err != nil { return err }", "const out = await flush(queue, 20);", "for n in nodes: out.append(n.key)", "/** @override */", "Deprecated.", "XXX", "pylint: disable=too-many-locals", "..."])
def test_no_statements(raw):
    assert describe(raw, words_of("runJob"))[0] is None


def frame(spark, data):
    return spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(data)], S)


def test_places_and_kinds(spark):
    py = 'def load(x):\n    """Loads the rows of a file."""\n    return x\n'
    data = [
        ("a.py:load", "load", "function", None, None, None, py), ("a.py:load", "load", None, None, None, None, py), ("a.go:F", "F", "func", None, None, None, "// F joins both parts of it.\nfunc F() {\n}"), ("a.py:C", "C", "class", None, None, "Holds the rows of a file.", "class C:\n    pass"),
        ("a.go:v", "v", None, None, None, "// Holds the list of names.", 'var v = []string{"a"}'), ("a.ts:g", "g", "Function", None, None, "", "function g() {\n  // does something in here\n}"), ("a.ts:h", "h", "Method", "T", "h()", "// Counts open sessions.", None), ("a.ts:i", "i", "function", None, None, None, None), (None, None, None, None, None, None, None),
        ("a.py:load", "load", "function", None, None, None, py), ("a.py:k", "k", "function", None, None, None, "def k(a, b=(1, 2)) -> dict[str, int]:\n    '''Validates all bindings.'''\n"),
    ]
    got = document_pairs(frame(spark, data))
    assert [k for k, _ in rows(got, "symbol_key", "origin")] == [0, 1, 2, 6, 9, 10] or {k for k, _ in rows(got, "symbol_key", "origin")} == {0, 1, 2, 6, 9, 10}
    assert '"""' not in got.where("symbol_key = 0").head()["code"]


def test_inheritance(spark):
    data = [
        ("p/a.py:Base", "Base", "class", None, None, None, "class Base:\n    pass"), ("p/b.py:Mid", "Mid", "class", None, None, None, "class Mid(Base):\n    pass"), ("p/c.py:Leaf", "Leaf", "class", None, None, None, "class Leaf(Mid):\n    pass"), ("p/d.py:Loop", "Loop", "class", None, None, None, "class Loop(Loop):\n    pass"),
        ("p/a.py:Base.run", "run", "method", "Base", None, "Runs the whole pipeline once.", "def run(self):\n    pass"), ("p/c.py:Leaf.run", "run", "method", "Leaf", None, "{@inheritDoc}", "def run(self):\n    pass"), ("p/c.py:Leaf.own", "own", "method", "Leaf", None, None, "def own(self):\n    pass"), ("p/d.py:Loop.run", "run", "method", "Loop", None, None, "def run(self):\n    pass"), ("q/c.py:Leaf.run", "run", "method", "Leaf", None, None, "def run(self):\n    pass"),
    ]
    got = {k: (o, d) for k, o, d in rows(document_pairs(frame(spark, data)), "symbol_key", "origin", "description")}
    assert got == {4: ("own", "Runs the whole pipeline once."), 5: ("inherited", "Runs the whole pipeline once.")}


def test_empty_and_long(spark):
    assert document_pairs(frame(spark, [])).count() == 0
    long = [("a.py:f", "f", "function", None, None, "Reads the facts of a topic. " * 20_000, "x" * 500_000)]
    assert document_pairs(frame(spark, long)).count() == 1


def test_classes_of_one_name_and_cycles(spark):
    """Two classes Base of one project keep their own documentation; hierarchies may be deep or cyclic."""
    cls = lambda f, n, base: (f"p/{f}:{n}", n, "class", None, None, None, f"class {n}({base}):\n    pass")
    run = lambda f, n, doc: (f"p/{f}:{n}.run", "run", "method", n, None, doc, "def run(self):\n    pass")
    data = [
        cls("x/a.py", "Base", "object"), run("x/a.py", "Base", "Reads every row of the table."), cls("y/a.py", "Base", "object"), run("y/a.py", "Base", "Sends the whole message again."),
        cls("x/b.py", "Leaf", "Base"), run("x/b.py", "Leaf", None), cls("y/b.py", "Twig", "Base"), run("y/b.py", "Twig", None), cls("z/b.py", "Lost", "Base"), run("z/b.py", "Lost", None),
        cls("c/1.py", "Ring", "Gnir"), cls("c/2.py", "Gnir", "Ring"), run("c/1.py", "Ring", None),
        *(cls("d/d.py", f"D{i}", f"D{i + 1}") for i in range(34)), cls("d/d.py", "D34", "object"), run("d/d.py", "D34", "Closes all of the open files."), run("d/d.py", "D0", None),
    ]
    got = {i: d for i, o, d in rows(document_pairs(frame(spark, data)), "symbol_id", "origin", "description") if o == "inherited"}
    assert got == {"p/x/b.py:Leaf.run": "Reads every row of the table.", "p/y/b.py:Twig.run": "Sends the whole message again.", "p/d/d.py:D0.run": "Closes all of the open files."}
