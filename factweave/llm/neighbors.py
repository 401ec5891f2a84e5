"""P5: the k most similar vectors for every vector of a collection.

An inverted file over k-means centroids holds every vector as a four-bit product code of its residual, fitted with the
score-aware anisotropic loss (the error along the vector costs more than that across it, since only the former moves large
inner products). A code is spilled to the few partitions nearest to its vector, so a query looks in its own partition
alone: it scans the codes there with per-query tables, two codes a byte, and reranks the best of them exactly. Only codes are
spilled; full vectors travel only where a candidate list names them. The exact scores also tell how far the codes err: a query
whose best could have been left out within that error (many vectors nearly equal, so that their codes tie) is compared exactly
with all rows that a bound of angles leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.session import checkpoint, maybe_broadcast, own_columns, ship


@dataclass(frozen=True)
class Model:
    """Unit centroids (K, d), codebooks (m, 16, d/m), the weight of the parallel error.

    Many centroids have a level above: ``coarse`` (C, d), whose cell c holds the centroids from starts[c] to starts[c + 1].
    """

    centroids: np.ndarray
    books: np.ndarray
    eta: float
    coarse: np.ndarray | None = None
    starts: np.ndarray | None = None

    def nearest(self, x: np.ndarray, count: int, cells: int = 8) -> np.ndarray:
        """The ``count`` nearest partitions of each vector, nearest first; with two levels those of its ``cells`` nearest cells are looked at."""
        count = min(count, len(self.centroids))
        if self.coarse is None:
            return _best(x @ self.centroids.T, count)
        near = _best(x @ self.coarse.T, min(cells, len(self.coarse)))
        score, part = np.full((len(x), count), -np.inf, np.float32), np.zeros((len(x), count), np.int64)
        for c in np.unique(near):
            rows = np.nonzero((near == c).any(1))[0]
            lo, hi = self.starts[c], self.starts[c + 1]
            both = np.hstack([score[rows], x[rows] @ self.centroids[lo:hi].T])
            ids = np.hstack([part[rows], np.broadcast_to(np.arange(lo, hi), (len(rows), hi - lo))])
            top = _best(both, count)
            score[rows], part[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(ids, top, 1)
        return part

    def encode(self, x: np.ndarray, part: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (n, m) of the residuals: coordinate descent on the anisotropic loss."""
        m, _, w = self.books.shape
        codes = np.zeros((len(x), m), np.uint8)
        # A few thousand rows at a time: the work space of a round then stays in the processor's cache.
        for lo in range(0, len(x), 2048):
            xs = np.ascontiguousarray(x[lo : lo + 2048].reshape(-1, m, w).transpose(1, 0, 2), np.float32)
            r = xs - np.ascontiguousarray(self.centroids[part[lo : lo + 2048]].reshape(-1, m, w).transpose(1, 0, 2), np.float32)
            books = self.books.astype(np.float32)
            # (m, n, 16): squared error and error along the vector of every codeword.
            square = (r**2).sum(2)[:, :, None] - 2 * (r @ books.transpose(0, 2, 1)) + (books**2).sum(2)[:, None, :]
            side = (xs * r).sum(2)[:, :, None] - xs @ books.transpose(0, 2, 1)
            code = square.argmin(2)
            along = np.take_along_axis(side, code[:, :, None], 2)[:, :, 0]
            total = along.sum(0)
            every = np.arange(xs.shape[1])
            for _ in range(rounds):
                for j in range(m):
                    rest = total - along[j]
                    best = (square[j] + np.float32(self.eta - 1) * (rest[:, None] + side[j]) ** 2).argmin(1)
                    code[j] = best
                    along[j] = side[j][every, best]
                    total = rest + along[j]
            codes[lo : lo + 2048] = code.T
        return codes


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _best(s: np.ndarray, count: int) -> np.ndarray:
    """The columns of the ``count`` largest values of each row, largest first."""
    count = min(count, s.shape[1])
    top = np.argpartition(-s, count - 1, axis=1)[:, :count]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1), 1)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Unit centroids (k, d) of unit vectors; an empty cell keeps its centroid."""
    c = x[rng.choice(len(x), k, replace=len(x) < k)].astype(np.float32)
    for _ in range(rounds):
        a = _assign(x, c)
        order = np.argsort(a, kind="stable")
        found, starts = np.unique(a[order], return_index=True)
        sums = np.add.reduceat(x[order], starts, axis=0)
        ok = np.linalg.norm(sums, axis=1) >= 1e-9
        c[found[ok]] = unit(sums[ok])
    return c


def _assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[lo : lo + 8192] @ c.T).argmax(1) for lo in range(0, len(x), 8192)])


#: From so many centroids on they are found, and looked up, in two levels.
TWO_LEVELS = 2048


def fit(sample: np.ndarray, parts: int, width: int, threshold: float, seed: int = 7) -> Model:
    """Centroids and codebooks from a sample of unit vectors. The codebooks are fitted on at most 20,000 of them."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    parts = int(max(1, min(parts, len(sample))))
    coarse = starts = None
    if parts < TWO_LEVELS:
        c = kmeans(sample, parts, rng)
    else:
        coarse = kmeans(sample, int(np.sqrt(parts)), rng)
        home = _assign(sample, coarse)
        share = np.bincount(home, minlength=len(coarse)) * parts / len(sample)
        cells = [kmeans(sample[home == i], max(1, round(n)), rng) if n > 0 else coarse[i : i + 1] for i, n in enumerate(share)]
        starts, c = np.concatenate([[0], np.cumsum([len(x) for x in cells])]), np.concatenate(cells)
    model = Model(c, np.zeros((d // width, 16, width), np.float32), 1.0, coarse, starts)
    sample = sample[rng.choice(len(sample), min(len(sample), 20_000), replace=False)]
    a = model.nearest(sample, 1)[:, 0]
    # Score-aware weight for unit vectors whose inner products matter above the threshold (Guo et al., 2020).
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    m = d // width
    r = (sample - c[a]).reshape(len(sample), m, width)
    xs = sample.reshape(len(sample), m, width)
    books = r[rng.choice(len(r), 16, replace=len(r) < 16)].transpose(1, 0, 2).astype(np.float32).copy()
    for _ in range(8):
        codes = Model(c, books, eta).encode(sample, a, rounds=1)
        err = r - books[np.arange(m), codes]
        along = np.einsum("nmw,nmw->nm", xs, err)
        total = along.sum(1)
        for j in range(m):
            rest = total - along[:, j]
            x, y = xs[:, j], r[:, j]
            lhs = np.eye(width) + (eta - 1) * x[:, :, None] * x[:, None, :]
            rhs = y + (eta - 1) * x * (rest + (x * y).sum(1))[:, None]
            chosen = np.eye(16)[codes[:, j]].T
            left, right = (chosen @ lhs.reshape(len(x), -1)).reshape(16, width, width), chosen @ rhs
            seen = chosen.any(1)
            books[j, seen] = np.linalg.solve(left[seen], right[seen][:, :, None])[:, :, 0]
    return Model(c, books, eta, coarse, starts)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.hstack([codes, np.zeros((len(codes), 1), np.uint8)])
    return codes[:, 0::2] | codes[:, 1::2] << 4


def tables(model: Model, q: np.ndarray) -> np.ndarray:
    """(n, bytes, 256): what every byte of a code adds to the score of each query."""
    m, _, w = model.books.shape
    lut = np.einsum("nmw,mkw->nmk", q.reshape(len(q), m, w), model.books)
    if m % 2:
        lut = np.concatenate([lut, np.zeros((len(q), 1, 16), lut.dtype)], axis=1)
    return (lut[:, 1::2, :, None] + lut[:, 0::2, None, :]).reshape(len(q), -1, 256).astype(np.float32)


def scan(model: Model, qid: np.ndarray, q: np.ndarray, ids: np.ndarray, parts: np.ndarray, packed: np.ndarray, keep: int, k: int, slack: float, step: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each query the ids of the best table scores (itself left out), as (query number, id, score) triples, and each query's floor.

    At most ``keep`` of a query, and none that lies ``slack`` below its k-th best. No code left out scores above the floor; it is
    minus infinity if none was left out.
    """
    rows, cand, est, floors = [], [], [], []
    base = model.centroids[np.unique(parts)]
    where = np.searchsorted(np.unique(parts), parts)
    columns = [np.ascontiguousarray(packed[:, b]) for b in range(packed.shape[1])]
    for lo in range(0, len(q), step):
        t = tables(model, q[lo : lo + step])
        s = (q[lo : lo + step] @ base.T).astype(np.float32)[:, where]
        for b, col in enumerate(columns):
            s += t[:, b, :][:, col]
        s[qid[lo : lo + step, None] == ids[None, :]] = -np.inf
        top = np.argpartition(-s, min(keep, s.shape[1] - 1), axis=1)[:, :keep] if s.shape[1] > keep else np.broadcast_to(np.arange(s.shape[1]), s.shape)
        best = np.take_along_axis(s, top, 1)
        ok = np.isfinite(best)
        floor = best.min(1) if s.shape[1] > keep else np.full(len(best), -np.inf)
        kth = -np.partition(-best, k - 1, axis=1)[:, k - 1 : k] if best.shape[1] >= k else np.full((len(best), 1), -np.inf)
        low = ok & (best < kth - slack)
        floors.append(np.maximum(floor, np.where(low, best, -np.inf).max(1)))
        ok &= ~low
        rows.append((lo + np.nonzero(ok)[0]))
        cand.append(ids[top[ok]])
        est.append(best[ok])
    return np.concatenate(rows), np.concatenate(cand), np.concatenate(est), np.concatenate(floors).astype(np.float32)


def _matrix(column: pa.ChunkedArray | pa.Array, d: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, d)


def _sample(rows: DataFrame, dim: int) -> np.ndarray:
    column = rows.toArrow().column(0).combine_chunks()
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim)


def _bytes(x: np.ndarray) -> pa.Array:
    raw, w = np.ascontiguousarray(x).tobytes(), x.shape[1] * x.itemsize
    return pa.array([raw[i * w : (i + 1) * w] for i in range(len(x))], pa.binary())


def usable(vectors: DataFrame, key: str, embedding: str, dim: int) -> DataFrame:
    """id, e: one row per id whose embedding has ``dim`` numbers, none NaN or null, and is not all zero."""
    e = F.col("e")
    rows = own_columns(vectors, key, embedding).toDF("id", "e").where("id is not null").where((F.size(e) == dim) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x)) & F.exists(e, lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("e").alias("e"))


def split_crowds(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows to index, answers of the rest): of vectors with one and the same unit vector only the k+1 smallest ids need be searched.

    Every other copy has the k smallest of them as its most similar vectors. The smallest ids are found by k+1 partially
    aggregated minima, so a vector that a third of all rows share is never gathered in one task.
    """
    length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # The length is bound by a lambda, else it would be computed anew for each number.
    directions = F.transform(F.array(length), lambda n: F.transform("e", lambda x: x.cast("double") / n))
    keyed = rows.select("id", F.xxhash64(directions[0]).alias("h"))
    crowds = keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select("h")
    if crowds.isEmpty():
        return rows, None
    members = checkpoint(keyed.join(maybe_broadcast(crowds), "h", "left_semi").select("h", "id"))
    least = members.groupBy("h").agg(F.min("id").alias("last")).withColumn("ids", F.array("last"))
    for _ in range(k):
        more = members.join(maybe_broadcast(least.select("h", "last")), "h").where(F.col("id") > F.col("last")).groupBy("h").agg(F.min("id").alias("next"))
        least = checkpoint(least.join(more, "h").select("h", F.col("next").alias("last"), F.array_append("ids", F.col("next")).alias("ids")))
    rest = members.join(maybe_broadcast(least), "h").where(~F.array_contains("ids", F.col("id")))
    answers = rest.select("id", F.posexplode(F.slice("ids", 1, k))).select("id", F.col("col").alias("near"), F.lit(1.0).alias("score"))
    return rows.join(rest.select("id"), "id", "left_anti"), answers


def most_similar(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", dim: int = 64, k: int = 5, sample_rows: int = 20_000, rows_per_part: int = 512, max_parts: int = 1 << 16, spill: int = 6, keep: int = 32, slack: float = 0.25, width: int = 2, threshold: float = 0.2, doubt: float = 3.0, query_block: int = 8192, code_block: int = 1 << 17) -> DataFrame:
    """key, near, score, rank: the k vectors of highest cosine similarity to every usable vector (ties: the smaller id).

    The index holds every row and has a partition for each ``rows_per_part`` of them, up to ``max_parts``; it is fitted on about
    ``sample_rows`` rows, or on eight rows a partition if those are more (half a million at most by default). Rows whose embedding is null, of another
    length, all zero, or has a null or NaN are left out; a repeated id is one vector (of different embeddings the least). Fewer than
    k other vectors give fewer rows. Extra columns are ignored; an empty table gives no rows.
    """
    if dim % width:
        raise ValueError("the width of a subspace must divide the dimension")
    spark = ship(vectors.sparkSession)
    out = f"{key} long, near long, score double, rank int"
    rows = checkpoint(usable(vectors, key, embedding, dim))
    n = rows.count()
    if n < 2:
        return spark.createDataFrame([], out)
    rows, crowd_answers = split_crowds(rows, k)
    parts = max(1, min(n // rows_per_part, max_parts))
    wanted = max(sample_rows, 8 * parts)
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < max(1, int(1_000_000 * min(1.0, wanted / n)))).select("e").limit(2 * wanted)
    sample = _sample(picked, dim)
    if len(sample) < 64:
        sample = _sample(rows.select("e").limit(wanted), dim)
    model = fit(unit(sample), min(parts, len(sample) // 8), width, threshold)
    shared = spark.sparkContext.broadcast((model.centroids, model.books, model.eta, model.coarse, model.starts))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim)
            u = unit(x)
            near = m.nearest(u, spill)
            part = near[:, 0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1]), pa.int32()), pa.array(near.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), lists, b.column(0), _bytes(pack(m.encode(u, part))), _bytes(x)], names=["part", "homes", "id", "code", "vec"])

    indexed = checkpoint(rows.select(F.col("id").cast("long"), "e").mapInArrow(index, "part int, homes array<int>, id long, code binary, vec binary"))
    # Sizes of at most max_parts partitions decide into how many blocks a home's queries and codes are split.
    plan = [
        (h, int(max(1, -(-q // query_block))), int(max(1, -(-c // code_block))))
        for h, q, c in indexed.select("part", F.explode("homes").alias("home")).groupBy("home").agg(F.sum((F.col("part") == F.col("home")).cast("long")), F.count(F.lit(1))).collect()
    ]
    homes = F.broadcast(spark.createDataFrame(plan, "home int, qn int, cn int"))
    blocks = lambda n: F.expr(f"sequence(0, {n} - 1)")
    queries = indexed.withColumnRenamed("part", "home").join(homes, "home").select("home", F.pmod(F.xxhash64("id"), F.col("qn")).cast("int").alias("qb"), "cn", "id", "vec")
    scanned = queries.select("home", "qb", F.explode(blocks("cn")).alias("cb"), "id", "vec").toDF("home", "qb", "cb", "id", "vec")
    codes = (
        indexed.select("part", F.explode("homes").alias("home"), "id", "code").join(homes, "home")
        .select("home", F.explode(blocks("qn")).alias("qb"), F.pmod(F.xxhash64("id"), F.col("cn")).cast("int").alias("cb"), "part", "id", "code")
        .toDF("home", "qb", "cb", "part", "id", "code")
    )

    def scan_block(left: pa.Table, right: pa.Table) -> pa.Table:
        m = Model(*shared.value)
        if not left.num_rows or not right.num_rows:
            return pa.table({"home": pa.array([], pa.int32()), "qb": pa.array([], pa.int32()), "id": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.int64())), "est": pa.array([], pa.list_(pa.float32())), "floor": pa.array([], pa.float32())})
        qid = left.column("id").to_numpy()
        packed = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(right.num_rows, -1)
        row, near, est, floor = scan(m, qid, unit(_matrix(left.column("vec"), dim, np.float32)), right.column("id").to_numpy(), right.column("part").to_numpy(), packed, keep, k, slack)
        # One row a query: its candidates as a list (``row`` is in order).
        ends = np.searchsorted(row, np.arange(len(qid) + 1))
        same = lambda c: pa.array(np.full(len(qid), left.column(c)[0].as_py(), np.int32))
        return pa.table({"home": same("home"), "qb": same("qb"), "id": pa.array(qid), "near": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(near, pa.int64())), "est": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(est, pa.float32())), "floor": pa.array(floor)})

    by = ["home", "qb", "cb"]
    candidates = checkpoint(scanned.groupBy(*by).cogroup(codes.groupBy(*by)).applyInArrow(scan_block, "home int, qb int, id long, near array<long>, est array<float>, floor float"))
    # A full vector goes once to every block that names it.
    named = candidates.select("home", "qb", F.explode("near").alias("id")).distinct().join(indexed.select("id", "vec"), "id").select("home", "qb", "id", "vec").toDF("home", "qb", "id", "vec")
    # A query has a list from each block of codes it was scanned against, nearly always one.
    lists = candidates if max(c for *_, c in plan) == 1 else candidates.groupBy("home", "qb", "id").agg(F.collect_list(F.struct("near", "est")).alias("l"), F.max("floor").alias("floor")).select("home", "qb", "id", F.flatten("l.near").alias("near"), F.flatten("l.est").alias("est"), "floor")
    listed = lists.join(indexed.select("id", "vec"), "id").select("home", "qb", "id", "vec", "near", "est", "floor").toDF("home", "qb", "id", "vec", "near", "est", "floor")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        errors: list[np.ndarray] = []
        bound = 0.0
        qs, ns, ss, rs, us = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int32)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            ids = right.column("id").to_numpy()
            order = np.argsort(ids)
            x = unit(_matrix(right.column("vec"), dim, np.float32).astype(np.float64))
            q = unit(_matrix(left.column("vec"), dim, np.float32).astype(np.float64))
            for i, (qid, near, est, floor) in enumerate(zip(*(left.column(c).to_pylist() for c in ("id", "near", "est", "floor")), strict=True)):
                near, first = np.unique(np.array(near, np.int64), return_index=True)
                score = x[order[np.searchsorted(ids, near, sorter=order)]] @ q[i]
                top = np.lexsort((near, -score))[:k]
                qs.append(np.full(len(top), qid, np.int64))
                ns.append(near[top])
                ss.append(score[top])
                rs.append(np.arange(1, len(top) + 1, dtype=np.int32))
                errors.append(score - np.array(est)[first])
                # Of a query from which nothing was left out, all others must have been seen.
                us.append(np.full(len(top), np.inf if floor == -np.inf and len(near) < n - 1 else floor - score[top[-1]] if len(near) >= k else np.inf))
            # The error of the codes is told from all candidates of the block: one query has few.
            err = np.concatenate([np.zeros(0), *errors])
            bound = -(err.mean() + doubt * err.std() + 1e-6) if len(err) else 0.0
        return pa.table({key: np.concatenate(qs), "near": np.concatenate(ns), "score": np.concatenate(ss), "rank": np.concatenate(rs), "unsure": np.concatenate(us) > bound})

    found = checkpoint(listed.groupBy("home", "qb").cogroup(named.groupBy("home", "qb")).applyInArrow(rerank, f"{out}, unsure boolean"))
    last = found.where(F.col("rank") == min(k, n - 1)).select(F.col(key).alias("id"), "score", "unsure")
    found = found.drop("unsure")
    wanting = indexed.join(last.where("not unsure"), "id", "left_anti").join(last.select("id", F.col("score").alias("low")), "id", "left").select("id", "vec", F.coalesce("low", F.lit(-1.0)).alias("low"), "part")
    if not wanting.isEmpty():
        # A partition with too few codes, or too many that the tables can not tell apart: its queries are compared exactly.
        wanting = checkpoint(wanting)
        found = found.join(wanting.select(F.col("id").alias(key)), key, "left_anti").unionByName(_against_all(wanting, indexed, key, dim, k, out))
    if crowd_answers is None:
        return found
    ranked = crowd_answers.withColumn("rank", F.lit(0)).select(F.col("id").cast("long").alias(key), F.col("near").cast("long"), "score", "rank")
    place = F.sum(F.lit(1)).over(_by(key))
    return found.unionByName(ranked.withColumn("rank", place.cast("int")))


def _against_all(queries: DataFrame, indexed: DataFrame, key: str, dim: int, k: int, out: str, block: int = 512, at_once: int = 1 << 16) -> DataFrame:
    """A stated query set (id, vec, low, part) against all rows: each task keeps its k best per query, then the best of those are kept.

    ``low`` is a score that k other rows reach. A block of queries of one part lies within an angle of its mean, so rows farther from
    the mean than that and the angle of the least ``low`` together are no query's nearest and are not compared.
    """
    spark = queries.sparkSession
    parts: list[DataFrame] = []

    def one(blocks: list[list]) -> DataFrame:
        shared = spark.sparkContext.broadcast([(np.array([r[0] for r in rows], np.int64), b"".join(bytes(r[1]) for r in rows), min(r[2] for r in rows)) for rows in blocks])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = []
            for qid, raw, low in shared.value:
                q = unit(np.frombuffer(raw, np.float32).reshape(-1, dim).astype(np.float64))
                pivot = unit(q.mean(0, keepdims=True))[0]
                reach = np.arccos(np.clip((q @ pivot).min(), -1, 1)) + np.arccos(np.clip(low, -1, 1)) + 1e-6
                state.append([qid, q, pivot, np.cos(reach) if reach < np.pi else -2.0, np.full((len(qid), k), -np.inf), np.full((len(qid), k), -1, np.int64)])
            for b in batches:
                if not b.num_rows:
                    continue
                all_ids = b.column(0).to_numpy()
                x = unit(_matrix(b.column(1), dim, np.float32).astype(np.float64))
                for entry in state:
                    qid, q, pivot, bound, score, best = entry
                    close = np.nonzero(x @ pivot >= bound)[0]
                    if not len(close):
                        continue
                    ids = all_ids[close]
                    s = q @ x[close].T
                    s[qid[:, None] == ids[None, :]] = -np.inf
                    top = np.argpartition(-s, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.broadcast_to(np.arange(s.shape[1]), s.shape)
                    score, best = np.hstack([score, np.take_along_axis(s, top, 1)]), np.hstack([best, ids[top]])
                    order = np.lexsort((best, -score), axis=1)[:, :k]
                    entry[4], entry[5] = np.take_along_axis(score, order, 1), np.take_along_axis(best, order, 1)
            for qid, _, _, _, score, best in state:
                ok = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(qid[np.nonzero(ok)[0]]), pa.array(best[ok]), pa.array(score[ok])], names=[key, "near", "score"])

        return indexed.select("id", "vec").mapInArrow(compare, f"{key} long, near long, score double")

    blocks: list[list] = []
    held, part = 0, None
    for row in queries.orderBy("part").toLocalIterator():
        if held == at_once:
            parts.append(one(blocks))
            blocks, held, part = [], 0, None
        if part != row[3] or len(blocks[-1]) == block:
            blocks.append([])
            part = row[3]
        blocks[-1].append(row)
        held += 1
    parts.append(one(blocks))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "near"))), 1, k)
    return found.groupBy(key).agg(best.alias("b")).select(key, F.posexplode("b")).select(key, F.col("col.near").alias("near"), (-F.col("col.s")).alias("score"), (F.col("pos") + 1).cast("int").alias("rank"))


def _by(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("near")


def similar_pairs(near: DataFrame, key: str = "vec_id") -> DataFrame:
    """vec_a < vec_b: the pairs of which one is among the most similar vectors of the other."""
    return near.select(F.least(key, "near").alias("vec_a"), F.greatest(key, "near").alias("vec_b")).distinct()


def with_symbols(near: DataFrame, vectors: DataFrame, key: str = "vec_id", symbol: str = "symbol_id") -> DataFrame:
    """near with the neighbours' symbol ids (the least, if deliveries of one vector differ; null if none has any)."""
    names = own_columns(vectors, key, symbol).toDF("near", symbol).groupBy("near").agg(F.min(symbol).alias(symbol))
    return near.join(names, "near", "left").select(key, "near", symbol, "score", "rank")
