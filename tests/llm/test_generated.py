"""P1 on small files, one of each sort, and cross-repository copies against brute force."""

import random

from conftest import rows

from factweave.llm.generated import find_generated, line_index

NODES = "node_key long, node_id string, code string, origin string"
SYMS = "symbol_id string, symbol_content string, node_key long"
HAND = "package a\n\nfunc Run(x int) error {\n\tif x > limit {\n\t\treturn nil\n\t}\n\treturn process(x)\n}\n"


def found(spark, nodes, symbols=()):
    n = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(nodes)], NODES)
    s = spark.createDataFrame([(*r, 7) for r in symbols], SYMS)
    return {k: o for k, o in rows(find_generated(n, s), "node_key", "origin")}


MIN = "!function(a){a.b=function(c){return c*2}}(q);for(var i=0;i<a.length;i++)e[i]^=a[i];" * 12


def test_sorts(spark):
    blob = "export const table = [" + ", ".join(f"0x{i:02x}" for i in range(200)) + "];\n"
    nodes = [
        ("a/x.go", "// Code generated by toolx. DO NOT EDIT.\n" + HAND), ("a/y.go", HAND + "\n// Autogenerated from s.schema with toolx. Do not modify by hand.\n"), ("a/app.js", MIN), ("a/w/package-lock.json", '{"lockfileVersion": 3}'), ("a/vendor/lib/z.go", HAND), ("a/q.pb.go", HAND), ("a/t.ts", blob), ("a/l.py", "# lib v1.2.3 | (c) lib contributors | MIT\n" + HAND),
        ("a/h.go", HAND), ("a/vendors/h.go", "// Helpers for the vendor screens.\n" + HAND), ("a/gen/h.go", "// This module generates stubs for tests.\n" + HAND), ("a/s.ts", "const weights = [1, 2, 3];\nfunction f(x) { return weights[x]; }\n"), ("a/c.json", '{"a": [' + ", ".join(map(str, range(200))) + "]}"), ("a/k.go", "// Keys generated by the planner are cached; do not edit the order.\n" + HAND), ("a/long.py", 'Q = "' + "a.b <> 3 AND " * 60 + '"\n\n' + "def f(x):\n    return Q.format(x)\n" * 3),
        ("a/e.go", ""), ("a/n.go", None), (None, HAND), (None, None),
    ]
    assert found(spark, nodes) == {0: "generated", 1: "generated", 2: "minified", 3: "lock", 4: "vendored", 5: "generated", 6: "data", 7: "vendored"}


def test_null_code_is_judged_by_symbols(spark):
    nodes = [("a/m.js", None), ("a/h.go", None), ("a/q_pb2.py", None)]
    symbols = [("a/m.js:a", MIN), ("a/m.js:b", MIN), ("a/h.go:Run", HAND), (None, MIN), ("a/h.go:X", None)]
    assert found(spark, nodes, symbols) == {0: "minified", 2: "generated"}


def test_copies_of_vendored_files(spark):
    r = random.Random(3)
    body = [f"value_{i} = compute_{r.randrange(10**6)}(left_{i}, right_{i})" for i in range(40)]
    lib = "\n".join(body)
    edited = "\n".join([*body[:-3], *(f"own_{i} = something_else_{i}(1)" for i in range(3))])
    half = "\n".join([*body[:20], *(f"own_{i} = something_else_{i}(1)" for i in range(20))])
    nodes = [("a/third_party/l/x.py", lib), ("b/src/x.py", lib), ("c/src/y.py", edited), ("d/src/z.py", half), ("a/src/same_repo.py", lib)]
    assert found(spark, nodes) == {0: "vendored", 1: "vendored", 2: "vendored"}


def test_a_third_are_copies(spark):
    body = "\n".join(f"alpha_{i} = beta_{i}(gamma_{i}, delta)" for i in range(30))
    nodes = [("lib/vendor/k/k.py", body)] + [(f"r{i}/src/k.py", body + f"\nown_line_number = {i}") for i in range(60)] + [(f"r{i}/src/own.py", "\n".join(f"unique_{i}_{j} = call_{i}_{j}(x)" for j in range(12))) for i in range(120)]
    assert set(found(spark, nodes)) == set(range(61))


def test_repeated_rows_and_empty_tables(spark):
    nodes = [("a/q.pb.go", HAND), ("a/q.pb.go", HAND), ("a/q.pb.go", None)]
    assert set(found(spark, nodes)) == {0, 1, 2} and found(spark, []) == {}
    assert line_index(spark.createDataFrame([], NODES)).count() == 0


def test_very_long_text(spark):
    assert found(spark, [("a/big.go", HAND * 20_000)]) == {}


def test_every_library_version_counts(spark):
    """The best-voted library holds too little of the copy, another one all of it; libraries known by their symbols alone; own versions."""
    body = [f"value_{i} = compute_{i * i}(left_{i}, right_{i})" for i in range(40)]
    nodes = [("a/vendor/l.py", "\n".join(body[:32])), ("m/vendor/l.py", "\n".join(body)), ("z/vendor/l.py", "\n".join(body[8:])), ("q/src/l.py", "\n".join(body)), ("m/src/l.py", "\n".join(body))]
    assert found(spark, nodes) == {0: "vendored", 1: "vendored", 2: "vendored", 3: "vendored"}
    nodes = [("a/vendor/l.py", None), ("q/src/l.py", "\n".join(body)), ("r/src/l.py", None)]
    symbols = [("a/vendor/l.py:f", "\n".join(body[:20])), ("a/vendor/l.py:g", "\n".join(body[20:])), ("r/src/l.py:f", "\n".join(body[5:20]))]
    assert found(spark, nodes, symbols) == {0: "vendored", 1: "vendored", 2: "vendored"}
    nodes = [("a/vendor/l.py", "\n".join(body)), ("q/src/l.py", "\n".join(body)), ("q/src/l.py", HAND * 9 + "\n".join(f"own_{i} = something_{i}(1)" for i in range(9)))]
    assert found(spark, nodes) == {0: "vendored", 1: "vendored"}


def test_copies_against_brute_force(spark):
    r = random.Random(8)
    pool = [f"name_{i} = call_{i * 7}(first, second_{i})" for i in range(60)]
    texts = [(f"r{r.randrange(6)}/{'vendor' if i % 2 else 'src'}/f{i}.py", set(r.sample(pool[: r.choice([12, 20, 60])], r.choice([8, 9, 10, 11])) if r.random() < 0.7 else pool[: r.choice([10, 12, 20, 40])])) for i in range(80)]
    want = {i for i, (p, ls) in enumerate(texts) if "/vendor/" in p or any("/vendor/" in q and q.split("/")[0] != p.split("/")[0] and 10 * len(ls & ms) >= 9 * len(ls) for q, ms in texts)}
    # Of unknown age: files that hold a body in three repositories or more make copies, too.
    homes = {}
    for p, ls in texts:
        homes.setdefault(frozenset(ls), set()).add(p.split("/")[0])
    want |= {i for i, (p, ls) in enumerate(texts) if any(q.split("/")[0] and len(homes[frozenset(ms)]) >= 3 and 10 * len(ls & ms) >= 9 * len(ls) for q, ms in texts)}
    assert set(found(spark, [(p, "\n".join(sorted(ls))) for p, ls in texts])) == want


def test_copies_without_a_name(spark):
    """No folder, name or notice tells of these: the older file is the original, and what stands in many repositories is nobody's own."""
    lib = "\n".join(f"value_{i} = compute_{i * 31}(left_{i}, right_{i})" for i in range(40))
    part = "\n".join([*lib.split("\n")[:37], *(f"own_{i} = something_{i}(1)" for i in range(3))])
    other = "\n".join(f"total_{i} = gather_{i * 17}(rows_{i}, seen)" for i in range(20))
    alone = "\n".join(f"step_{i} = follow_{i * 13}(edge_{i}, mark)" for i in range(20))
    data = [("z/src/a.py", lib, "2031-01-01"), ("b/src/a.py", lib, "2032-01-01"), ("c/src/b.py", part, "2033-01-01"), *((f"r{i}/src/o.py", other, None) for i in range(3)), ("x/s.py", alone, None), ("y/s.py", alone, None), ("z/src/again.py", lib, "2034-01-01")]
    n = spark.createDataFrame([(i, p, c, t) for i, (p, c, t) in enumerate(data)], "node_key long, node_id string, code string, modified_at string")
    got = rows(find_generated(n, spark.createDataFrame([], SYMS)), "node_key", "origin", "evidence")
    assert [(k, e.split()[2]) for k, _, e in got] == [(1, "an"), (2, "an"), (3, "several"), (4, "several"), (5, "several")]


def test_an_original_split_over_two_libraries(spark):
    """Two libraries hold a part of the file each, a third all of it."""
    body = [f"value_{i} = compute_{i * i}(left_{i}, right_{i})" for i in range(40)]
    nodes = [("a/vendor/l/a.py", "\n".join(body[:20])), ("b/vendor/l/b.py", "\n".join(body[20:])), ("m/vendor/l/m.py", "\n".join(body)), ("q/src/q.py", "\n".join(body)), ("s/src/own.py", HAND * 3)]
    assert found(spark, nodes) == {0: "vendored", 1: "vendored", 2: "vendored", 3: "vendored"}
