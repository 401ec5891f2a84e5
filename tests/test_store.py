"""Stores, functions, extraction, incremental runs, streams, registry, questions, plans and the engine."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from factweave.engine import Engine, check_text
from factweave.functions import text as X
from factweave.operators import enrich, filegraph, hydrate, search
from factweave.plans import agent, nl
from factweave.plans.datalog import QueryError
from factweave.plans.registry import QueryDefinition, Registry, fill, read_rules
from factweave.sources import incremental, store, tree
from factweave.sources.store import FactStore
from factweave.streaming import ingest

SPO = "topic int, s string, p string, o string"


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(1, "main.go", "defines", "main"), (1, "main.go", "has_kind", "file"), (1, "main.go", "imports", "fmt"), (1, "utils.go", "defines", "helper"), (2, "main.go", "defines", "other")], SPO)


def test_scans(base):
    s = FactStore(base)
    assert s.in_topic(1).scan(s="main.go").count() == 3 and s.scan(s="main.go", p="imports").count() == 1 and s.scan(topic=1).count() == 4 and s.scan(s="main.go", p="defines", o="main").count() == 1
    assert s.scan(s="no").count() == 0 and rows(s.subjects_of("defines", "helper")) == [("utils.go",)] and s.merged(1, 2).count() == 5 and s.about("main.go").count() == 4


def test_save_and_load(base, spark, tmp_path):
    FactStore(base).save(str(tmp_path / "f"))
    assert rows(FactStore.load(spark, str(tmp_path / "f")).facts.select("topic", "s", "p", "o")) == rows(base)


def test_delete_takes_symbols_along(spark):
    f = spark.createDataFrame([(1, "a.go", "defines", "a.go:F"), (1, "a.go:F", "calls", "b"), (1, "ab.go", "defines", "x")], SPO)
    gone = FactStore(f).delete_subject(spark.createDataFrame([("a.go",)], "file string"))
    assert rows(gone.facts, "s") == [("ab.go",)]


@pytest.mark.parametrize("fn,cases", [
    (X.short_name, {"a/b.go:T.M": "M", "a/b.go:F": "F", "x": "x", "a:b.": "b."}), (X.base_name, {"a/b/c": "c", "c": "c"}), (X.dir_name, {"a/b/c": "a/b", "c": ""}), (X.guess_kind, {"NewThing": "func", "Thing": "struct", "thing": "symbol", "go(x)": "func"}),
    (X.package_of, {"a/b/c.go": "a.b", "c.go": "root"}), (X.clean_route, {"/a?b=1": "/a", "/a": "/a"}), (X.number_of, {"1.5": 1.5, " 1.5": None, "1f": None, "-2e3": -2000.0, "x": None}), (X.infer_kind, {"f.go:main": "entry", "f.go:TestX": "test", "f": "symbol"}), (X.plain_name, {"a:f(x)": "f", "a:f": "f"}),
])
def test_functions(spark, fn, cases):
    got = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in cases], "x string").select("x", fn("x")).collect()}
    assert got == cases


def test_fuzzy_finds_the_expected(spark):
    corpus = spark.createDataFrame([("pkg/service/graph.go",), ("pkg/service/cluster.go",), ("pkg/repl/search.go",), ("cmd/server.go",)], "path string")
    for q, want in (("graph", "pkg/service/graph.go"), ("serch", "pkg/repl/search.go"), ("pkg/service/cluster.go", "pkg/service/cluster.go")):
        assert want in [r[0] for r in search.fuzzy(corpus, "path", q, 3).collect()]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [1.0]), (6, [0.0, 0.0])], "id long, embedding array<double>")
    assert [r[0] for r in search.nearest(v, "id", "embedding", [1.0, 0.0], 3).collect()] == [1, 2, 3] and search.nearest(v, "id", "embedding", [1.0, 0.0], 9, least=0.5).count() == 2


def test_interfaces_meet_their_structs(spark):
    f = spark.createDataFrame([("pkg/service:Processor", "has_kind", "interface"), *((f"pkg/service:{n}", "has_kind", "struct") for n in ("ProcessorImpl", "DefaultProcessor", "RandomStruct"))], "s string, p string, o string")
    assert rows(search.wired_interfaces(f), "target") == [("pkg/service:DefaultProcessor",), ("pkg/service:ProcessorImpl",)]


def test_slices(spark):
    df = spark.createDataFrame([("a\nb\nc",)], "c string")
    for lo, hi, want in ((2, 3, "b\nc"), (1, 1, "a"), (0, 0, "a\nb\nc"), (3, 9, "c"), (5, 9, "")):
        assert df.select(store.source_slice("c", lo, hi)).head()[0] == want


PY = 'import os\nfrom .dep import y\n\nclass A:\n    """An a."""\n    def run(self):\n        return helper(1)\n\ndef helper(x):\n    return print(x)\n'


def write_tree(root):
    (root / "pkg" / "node_modules").mkdir(parents=True)
    (root / "pkg" / "m.py").write_text(PY)
    (root / "pkg" / "dep.py").write_text("y = 1\n")
    (root / "pkg" / "node_modules" / "skip.js").write_text("x")
    (root / "main.go").write_text('package main\n\n// Main starts.\nfunc main() {\n\trun()\n}\n\ntype Server struct {\n\tName string\n}\n')
    (root / "note.txt").write_text("no")


def test_tree_to_facts(spark, tmp_path):
    write_tree(tmp_path)
    files = tree.read_tree(spark, str(tmp_path))
    assert rows(files, "path") == [("main.go",), ("pkg/dep.py",), ("pkg/m.py",)]
    ex = tree.extract(files)
    f = {(s, p, o) for s, p, o in rows(tree.facts_of_tree(files, ex, 7), "s", "p", "o")}
    assert {("pkg/m.py", "defines", "pkg/m.py:A.run"), ("pkg/m.py:A.run", "calls", "pkg/m.py:helper"), ("pkg/m.py", "imports", "pkg/dep.py"), ("pkg/m.py", "imports", "os"), ("main.go:Server", "has_role", "data_contract"), ("main.go:main", "has_doc", "Main starts."), ("main.go", "has_tag", "backend"), ("pkg/m.py:A", "type", "class")} <= f
    assert not any(o == "print" for _, p, o in f if p == "calls")
    docs = tree.documents_of_tree(ex, 7)
    assert docs.where("doc_id = 'pkg/m.py:helper'").head()["metadata"]["start_line"] == 9


def test_incremental_equals_full(spark, tmp_path):
    write_tree(tmp_path)
    files = tree.read_tree(spark, str(tmp_path)).cache()
    files.count()
    empty = FactStore(spark.createDataFrame([], SPO))
    none = spark.createDataFrame([], "path string, hash string, mtime long")
    first, h, d = incremental.update(empty, none, files, 7)
    assert {c for _, c in rows(d)} == {"added"}
    changed = files.where("path <> 'main.go'").withColumn("content", F.when(F.col("path") == "pkg/m.py", F.lit("def other():\n    pass\n")).otherwise(F.col("content")))
    second, _, d2 = incremental.update(first, h, changed, 7)
    assert dict(rows(d2)) == {"main.go": "deleted", "pkg/m.py": "changed", "pkg/dep.py": "unchanged"}
    full, _, _ = incremental.update(empty, none, changed, 7)
    assert rows(second.facts.select("topic", "s", "p", "o")) == rows(full.facts.select("topic", "s", "p", "o"))


def test_virtual_facts(spark):
    f = spark.createDataFrame([("r.go", "defines", "r.go:GetUser"), ("r.go", "has_tag", "backend"), ("ui.ts:load", "references", "/api/user?id=1"), ("m.go:User", "has_role", "data_contract")], "s string, p string, o string")
    texts = spark.createDataFrame([("r.go", 'r := gin.New()\nr.GET("/api/user", h.GetUser)'), ("ui.ts", "const u: User = load()")], "file string, content string")
    got = set(rows(enrich.virtual_facts(f, texts)))
    assert {("/api/user", "handled_by", "r.go:GetUser"), ("ui.ts:load", "calls_api", "/api/user"), ("ui.ts:load", "calls", "r.go:GetUser"), ("r.go:GetUser", "has_tag", "backend"), ("r.go:GetUser", "has_role", "api_handler"), ("ui.ts", "exposes_model", "m.go:User")} <= got


def test_hydration(spark):
    f = spark.createDataFrame([("a.go:F", "has_kind", "func"), ("a.go:F", "start_line", "2"), ("a.go:F", "end_line", "3"), ("p/a.go:G", "has_kind", "func")], "s string, p string, o string")
    files = spark.createDataFrame([("a.go", "1\n2\n3\n4")], "id string, content string")
    none = spark.createDataFrame([], "id string, content string")
    assert hydrate.symbol(f, "a.go:F", "p", none, files).head()["content"] == "2\n3" and hydrate.symbol(f, "a.go:G", "p", none, files).head()["id"] == "p/a.go:G" and hydrate.symbol(f, "zz", "p", none, files).count() == 0


def test_registry(spark, tmp_path):
    r = Registry()
    assert r.get("smell_hub").severity == "medium" and [d.tier for d in r.list()] == sorted(d.tier for d in r.list())
    (tmp_path / "x.dl").write_text('query_metadata("mine", "Mine").\nquery_metadata("mine", "tier", "2").\nquery_metadata("mine", "template", "triples(?s, \\"{p}\\", ?o)").\nfind_x(A, B) :-\n    triples(A, "x", B).\n')
    assert r.load(str(tmp_path)) == 2 and r.get("mine").parameters() == ["p"] and r.reload() == 2
    f = spark.createDataFrame([("a", "x", "b")], "s string, p string, o string")
    assert rows(r.execute("mine", f, {"p": "x"})) == [("a", "b")] and rows(r.execute("find_x", f)) == [("a", "b")]
    with pytest.raises(QueryError):
        r.execute("mine", f)
    with pytest.raises(QueryError):
        r.register(QueryDefinition("a b"))
    assert fill('"{v}"', {"v": "a'b\"c"}) == '"a\\\'b\\"c"' and read_rules("") == []


@pytest.mark.parametrize("question,intent,target", [("Who calls Engine.Run?", "who_calls", "Engine.Run"), ("What does Parse call?", "what_calls", "Parse"), ("path from A to B", "how_reaches", "A"), ("Where is Store defined?", "find", "Store"), ("any security problems?", "security_audit", None), ("hello there", "chat", None), ("explain graph.go", "explain", "graph.go"), ("callees of Store.Open", "what_calls", "Store.Open"), ("How does Login reach Query?", "how_reaches", "Login"), ("summarize pkg/a.go", "summarize", "pkg/a.go"), ("write tests for Parser", "test_generation", "Parser"), ("how can I simplify engine.go", "refactor", "engine.go"), ("why is Scan slow", "performance", "Scan"), ("", "chat", None)])
def test_intents(question, intent, target):
    i = nl.classify(question)
    assert i.name == intent and (target is None or i.targets[0] == target)


def test_plans(spark):
    f = spark.createDataFrame([("a", "calls", "b"), ("b", "calls", "c"), ("x", "calls", "y")], "s string, p string, o string")
    steps = agent.read_plan('```json\n[{"id": 1, "task": "t", "query": "triples(\\"a\\", \\"calls\\", ?n)"}, {"id": 2, "task": "u", "query": "triples($1.n, \\"calls\\", ?m)"}, {"id": 3, "task": "v", "query": "triples(\\"zz\\", \\"calls\\", ?m)"}, {"id": 4, "task": "w", "query": "oops"}]\n```')
    done = agent.Plan(f, steps).execute()
    assert [s.status for s in done] == ["success", "success", "corrected", "failed"] and rows(done[1].result, "m") == [("c",)] and "3 of 4" in agent.narrative(done)
    assert agent.verify("select 1") is None and agent.verify("rm -rf /") and agent.verify("x" * 9000) and agent.verify("x", 99)


def test_engine(spark):
    f = spark.createDataFrame([(1, "f.go", "type", "file"), (1, "f.go", "defines", "f.go:A"), (1, "f.go", "defines", "f.go:B"), (1, "f.go:A", "calls", "f.go:B"), (1, "f.go:A", "type", "function")], SPO)
    docs = spark.createDataFrame([("f.go", "l1\nl2")], "doc_id string, content string")
    e = Engine(f, docs, project="p")
    assert e.query('calls(?a, ?b)').count() == 1 and e.query('calls(?a, ?b)') is e.query('calls(?a, ?b)') and e.query("smell_circular_direct").count() == 0
    assert rows(e.what_calls("f.go:A"), "target") == [("f.go:B",)] and e.source("f.go", 2, 2).head()["content"] == "l2" and e.files().count() == 1
    part, links, cursor = e.graph_page({"offset": 0, "limit": 2})
    assert part.count() == 2 and cursor["offset"] == 2
    assert "f.go:A" in e.ask("Who calls B?")["answer"] and e.ask("path from A to B")["intent"] == "how_reaches"
    assert e.central(1).count() == 1 and e.communities().count() >= 1 and e.flow("f.go:A", "f.go:B").count() == 2 and e.path("f.go:A", "f.go:B").count() == 2
    for bad in ("", "x" * 600, "a; drop table", "../x"):
        with pytest.raises(QueryError):
            check_text(bad)
    with pytest.raises(QueryError):
        e.semantic_search([1.0])


def test_stream_of_facts(spark, tmp_path, small):
    src = tmp_path / "in"
    spark.read.parquet(f"{small}/refs.parquet").limit(50).write.parquet(str(src / "a"))
    for turn in range(2):
        q = ingest.upsert_facts(ingest.refs_stream(spark, str(src / "*")), str(tmp_path / "facts"), str(tmp_path / f"c{turn}"))
        q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "facts"))
    assert got.count() == got.dropDuplicates(["topic", "s", "p", "o"]).count() == store.facts_of_refs(spark.read.parquet(str(src / "a"))).count()


def test_project_files(tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "metadata.json").write_text('{"name": "One", "description": "d"}')
    (tmp_path / "two").mkdir()
    assert [p["name"] for p in store.list_projects(str(tmp_path))] == ["One", "two"]
    (tmp_path / "project.yaml").write_text("name: x\ntags: [a, b]\ncomponents:\n  api:\n    type: backend\n    language: go\n")
    assert store.read_project(str(tmp_path / "project.yaml")) == {"name": "x", "tags": ["a", "b"], "components": {"api": {"type": "backend", "language": "go"}}}


def test_every_rule_has_a_name(spark):
    from factweave.operators.rules import CATALOGUE, REPORTS, SYMBOL_REPORTS

    f = spark.createDataFrame([("f.go", "defines", "f.go:A"), ("f.go", "defines", "f.go:B"), ("f.go:A", "calls", "f.go:B"), ("f.go:B", "calls", "f.go:A"), ("f.go:A", "has_impact_metric", "m"), ("m", "has_trend", "up"), ("m", "has_value", "3"), ("m", "has_timestamp", "t")], "s string, p string, o string")
    r = Registry()
    assert {c.name for c in CATALOGUE} >= set(REPORTS) | set(SYMBOL_REPORTS) and len({c.name for c in CATALOGUE}) == len(CATALOGUE)
    assert rows(r.execute("impact_circular_dependency", f, {"symbol": "f.go:A"})) == [("f.go:A",), ("f.go:B",)] and rows(r.execute("impact_trend", f)) == [("f.go:A", "up")] and rows(r.execute("impact_metrics_history", f)) == [("f.go:A", "t", "3")]
    assert rows(r.execute("impact_dependency_depth", f, {"symbol": "f.go:A"})) == [("f.go:A", 3), ("f.go:B", 2)] and r.execute("impact_remediation", f, {"symbol": "f.go:A"}).count() == 3 and r.execute("impact_dependency_graph", f, {"symbol": "f.go:A"}).count() == 4
    assert r.execute("security_scan_file", f).count() == 0 and r.execute("quality_technical_debt", f).count() == 1
    with pytest.raises(QueryError):
        r.execute("impact_blast_radius", f)


def test_kept_rows_age_and_are_few(spark):
    from factweave.engine import RowCache

    now = [0.0]
    c = RowCache(300, 2, lambda: now[0])
    made = []
    make = lambda k: lambda: made.append(k) or spark.createDataFrame([(k,)], "k string")
    first = c.get(("a",), make("a"))
    assert c.get(("a",), make("a")) is first and made == ["a"]
    now[0] = 301.0
    assert c.get(("a",), make("a")) is not first
    c.get(("b",), make("b"))
    c.get(("c",), make("c"))
    assert list(c.kept) == [("b",), ("c",)]
    c.clear()
    assert not c.kept


def test_plans_have_a_breaker(spark):
    f = spark.createDataFrame([("a", "calls", str(i)) for i in range(30)], "s string, p string, o string")
    step = lambda: [agent.Step(1, "t", 'triples(?a, "calls", ?b)')]
    assert agent.Plan(f, step(), most=10).execute()[0].error == "more than 10 rows" and agent.Plan(f, step(), most=30).execute()[0].status == "success" and agent.Plan(f, step(), seconds=None, most=None).execute()[0].status == "success"


def test_one_turn_of_the_loop(spark):
    f = spark.createDataFrame([(1, "f.go", "defines", "f.go:Run"), (1, "f.go:Run", "calls", "f.go:Go"), (1, "f.go:X", "calls", "f.go:Run")], SPO)
    e = Engine(f)
    turn = e.work("Who calls Run?")
    assert turn.task == "resolve_symbol" and turn.names == ["Run"] and turn.attention[0][0] == "f.go:Run" and turn.refused is None and "f.go:X" in turn.outcome
    assert e.work("please rm -rf everything", lambda t: "done").refused and e.work("list the api endpoints", lambda t: "done").task == "path_endpoints" and agent.task_of("hello") == "chat" and agent.task_of("any security problems?") == "security_audit"
    assert e.ask("Who calls Run?")["total"] == 1


def test_lookups(spark):
    f = spark.createDataFrame([("a/x.go", "defines", "a/x.go:T.Run"), ("a/x.go:T.Run", "has_name", "Run"), ("b/y.go", "defines", "odd"), ("c/" + "z" * 60 + ".go:Run", "has_name", "Run")], "s string, p string, o string")
    t = spark.createDataFrame([("q/w.go:F",), ("odd",), ("pkg.Run",), ("nowhere",), (None,)], "target string")
    assert rows(filegraph.symbol_files(f, t)) == [("nowhere", None), ("odd", "b/y.go"), ("pkg.Run", "a/x.go"), ("q/w.go:F", "q/w.go")]
    p = spark.createDataFrame([("proj/a/b",), ("host/proj/c",), ("host/x/proj",), ("fmt",), ("projx",)], "p string")
    assert [r[0] for r in p.select(filegraph.project_file_of("p", "proj")).collect()] == ["a/b", "proj/c", "x/proj", "", "projx"]
    n = spark.createDataFrame([("a.go:F",), ("b.go",), ("lib/c.go",)], "id string")
    d = spark.createDataFrame([("a.go", "x"), ("b.go", "")], "doc_id string, content string")
    assert rows(filegraph.internal_nodes(n, d, ("lib/",))) == [("a.go:F", True), ("b.go", False), ("lib/c.go", True)]
    assert hydrate.context_text(F.lit("x")) is not None and len(spark.range(1).select(hydrate.context_text(F.repeat(F.lit("x"), 3000))).head()[0]) == 2000 + len("\n... (truncated)")


def test_pages_and_newest(spark):
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(50)], "id string")
    links = spark.createDataFrame([("n010", "n011", "r"), ("n001", "n040", "r")], "source string, target string, relation string")
    a, la = filegraph.page(nodes, links, 10, 10)
    b, lb = filegraph.page(nodes, links, 0, 10, after="n009")
    assert rows(a) == rows(b) == [(f"n{i:03d}",) for i in range(10, 20)] and rows(la) == rows(lb) == [("n010", "n011", "r")]
    f = spark.createDataFrame([(1, "s", "p", str(i), i % 7) for i in range(100)], "topic int, s string, p string, o string, at int")
    kept = FactStore(f).retain("at", 20)
    want = sorted(((-(i % 7), str(i)) for i in range(100)))[:20]
    assert {r["o"] for r in kept.collect()} == {o for _, o in want}


def test_signatures_and_documents(spark, tmp_path):
    from factweave.sources.tree import documents_of_tree, extract, save_documents

    files = spark.createDataFrame([("p/a.go", "package p\n\n// Run it.\nfunc (t *T) Run(m map[string]int) error {\n\treturn nil\n}\n"), ("p/b.py", "def f(a: dict = {'x': 1}) -> int:\n    return 1\n")], "path string, content string")
    got = {r["id"]: r["signature"] for r in extract(files).where("what = 'symbol'").collect()}
    assert got == {"p/a.go:T.Run": "func (t *T) Run(m map[string]int) error", "p/b.py:f": "def f(a: dict = {'x': 1}) -> int:"}
    save_documents(documents_of_tree(extract(files), 3), str(tmp_path / "docs"))
    assert spark.read.parquet(str(tmp_path / "docs")).where("topic = 3").count() == 4
