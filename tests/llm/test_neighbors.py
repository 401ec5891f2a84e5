"""P5 against brute force: recall, ties, copies, unusable vectors, tiny and empty tables."""

import numpy as np
import pytest
from conftest import rows

from factweave.llm import neighbors as N

V = "vec_id long, embedding array<float>, near string, score string"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v], "c", "c") for i, v in zip(ids if ids is not None else range(len(vectors)), vectors, strict=True)], V)


def brute(x, ids, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {int(ids[i]): [int(ids[j]) for j in np.lexsort((ids, -s[i]))[:k]] for i in range(len(x))}


def test_recall_against_brute_force(spark):
    """Every id divisible by 50 against all rows."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(150, 64))
    x = (centers[rng.integers(0, 150, 3000)] + 0.35 * rng.normal(size=(3000, 64))).astype(np.float32) * rng.uniform(0.1, 9, (3000, 1)).astype(np.float32)
    got: dict = {}
    for q, n in rows(N.most_similar(frame(spark, x), rows_per_part=128), "vec_id", "near"):
        got.setdefault(q, set()).add(n)
    want = brute(x.astype(np.float64), np.arange(3000), 5)
    asked = range(0, 3000, 50)
    assert sum(len(got[q] & set(want[q])) for q in asked) / (5 * len(asked)) >= 0.95 and all(len(got[q]) == 5 for q in range(3000))


def test_copies_and_ties(spark):
    """A third of all rows are one vector: each copy has the smallest other ids; nothing is gathered or lost."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 64)).astype(np.float32)
    x[:100] = x[0]
    got: dict = {}
    for q, n, r in rows(N.most_similar(frame(spark, x)), "vec_id", "near", "rank"):
        got.setdefault(q, {})[r] = n
    assert all(sorted(got[q].values()) == sorted(i for i in range(6) if i != q)[:5] for q in range(100)) and all(set(got[q]) == {1, 2, 3, 4, 5} for q in range(300))


def test_unusable_and_redelivered(spark):
    rng = np.random.default_rng(3)
    x = [*rng.normal(size=(8, 64)), None, np.zeros(64), np.full(64, np.nan), np.ones(63), np.ones(65)]
    df = frame(spark, x).unionByName(frame(spark, x)).unionByName(spark.createDataFrame([(None, [1.0] * 64, "c", "c")], V))
    got = rows(N.similar_pairs(N.most_similar(df)))
    assert {i for p in got for i in p} == set(range(8)) and all(a < b for a, b in got) and len(got) == len(set(got))


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_tiny(spark, n):
    x = np.eye(64)[:n] + 0.1
    got = rows(N.most_similar(frame(spark, list(x))), "vec_id", "near")
    assert len(got) == n * (n - 1)


def test_blocks_and_lonely_partitions(spark):
    """Small blocks give what large ones give; a query alone in its partition is compared with all rows."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 64)).astype(np.float32)
    a = N.most_similar(frame(spark, x), rows_per_part=1000)
    b = N.most_similar(frame(spark, x), rows_per_part=1000, query_block=50, code_block=64, keep=64)
    same = len(set(rows(a, "vec_id", "near")) & set(rows(b, "vec_id", "near"))) / (400 * 5)
    assert same > 0.9
    c: dict = {}
    for q, n in rows(N.most_similar(frame(spark, x), rows_per_part=4, spill=1), "vec_id", "near"):
        c.setdefault(q, set()).add(n)
    assert all(len(v) == 5 for v in c.values()) and len(c) == 400


def test_anisotropic_codes_keep_inner_products():
    """The weighted loss has the smaller error along the vectors themselves."""
    rng = np.random.default_rng(5)
    x = N.unit(rng.normal(size=(2000, 64))).astype(np.float32)
    err = {}
    for t in (0.0, 0.4):
        m = N.fit(x, 4, 2, t)
        part = m.nearest(x, 1)[:, 0]
        codes = m.encode(x, part)
        back = m.centroids[part] + m.books[np.arange(32), codes].reshape(len(x), 64)
        err[t] = np.mean(((x - back) * x).sum(1) ** 2)
    assert err[0.4] < err[0.0]


def test_packed_tables_equal_decoding():
    rng = np.random.default_rng(6)
    x = N.unit(rng.normal(size=(200, 64))).astype(np.float32)
    m = N.fit(x, 4, 2, 0.2)
    part = m.nearest(x, 1)[:, 0]
    codes = m.encode(x, part)
    t = N.tables(m, x[:3])
    p = N.pack(codes)
    got = sum(t[:, b, :][:, p[:, b]] for b in range(p.shape[1]))
    want = x[:3] @ m.books[np.arange(32), codes].reshape(200, 64).T
    assert np.allclose(got, want, atol=1e-4)


@pytest.mark.parametrize("spread", [1e-4, 1e-3, 1e-2])
def test_recall_in_a_group_of_near_copies(spark, spread):
    """A third of all rows lie within a small distance of one another, at lengths far from 1."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4500, 64))
    x[:1500] = x[0] / np.linalg.norm(x[0]) + spread / 8 * rng.normal(size=(1500, 64))
    x = (x * rng.uniform(0.1, 9, (4500, 1))).astype(np.float32)
    got: dict = {}
    for q, n in rows(N.most_similar(frame(spark, x)), "vec_id", "near"):
        got.setdefault(q, set()).add(n)
    want = brute(x.astype(np.float64), np.arange(4500), 5)
    assert sum(len(got[q] & set(want[q])) for q in range(1500)) / 7500 > 0.99 and all(len(got[q]) == 5 for q in range(4500))


def test_copies_up_to_length(spark):
    """Vectors that differ by a power of two in length alone have one unit vector and are one crowd."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(120, 64)).astype(np.float32)
    x[:60] = x[0] * 2.0 ** (np.arange(60) % 9 - 4)[:, None]
    kept, answers = N.split_crowds(frame(spark, x).toDF("id", "e", "a", "b").select("id", "e"), 5)
    assert kept.count() == 66 and answers.count() == 54 * 5


def test_two_levels_of_centroids(spark, monkeypatch):
    """Many partitions: found and looked up in two levels; every vector has a home, and the pairs stay those of brute force."""
    monkeypatch.setattr(N, "TWO_LEVELS", 8)
    rng = np.random.default_rng(5)
    centers = N.unit(rng.normal(size=(150, 64)))
    x = N.unit(np.repeat(centers, 12, axis=0) + rng.normal(scale=0.04, size=(1800, 64))).astype(np.float32)
    m = N.fit(x, 60, 2, 0.2)
    assert m.coarse is not None and m.starts[-1] == len(m.centroids) and abs(len(m.centroids) - 60) < 12
    flat = N._best(x @ m.centroids.T, 1)[:, 0]
    assert (m.nearest(x, 6)[:, 0] == flat).mean() > 0.98
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r["vec_id"], r["near"]) for r in N.most_similar(df, rows_per_part=30, sample_rows=1000).collect()}
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    assert len(got & want) / len(want) > 0.99
