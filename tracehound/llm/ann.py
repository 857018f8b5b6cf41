"""Approximate nearest neighbours over learned partitions.

Fitting works on a bounded sample (``SAMPLE`` distinct vectors, those with the
smallest id hashes): the sample's exact k-nearest-neighbour graph is cut into
balanced parts (median splits along principal axes, then moves that lower the
number of cut edges while no part grows beyond ``SLACK`` times its share), and
a small network with one hidden layer learns, for a vector, how its neighbours
spread over the parts.  The model is the only thing broadcast (bounded by
dimensions and parts).

Every vector is indexed: it goes to its most probable part.  A query goes to
its most probable parts, as many as held-out points of the sample need to reach
``recall`` of their neighbours, where all vectors are compared with it in double
precision.  Equal vectors are indexed once with their smallest ids (as
many as a result can show), so copies of one vector cannot fill a part; a part
larger than ``ROWS`` vectors is searched in hashed pieces.

Rows: vectors that are null, zero, or hold a null or non-finite component take
no part, nor do rows with a null id or with another length than most vectors
have.  Rows that repeat id and vector count once.  With fewer than k + 1
vectors all candidates are returned.  An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import common, worker

SAMPLE = 6000
NEIGHBOURS = 10
HIDDEN = 96
EPOCHS = 8
SLACK = 1.1
ROWS = 20_000
SALTS = 32


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """Exact k nearest neighbours of each row, in blocks."""
    sq, out = (x * x).sum(1), []
    for a in range(0, len(x), 512):
        d = sq[None] - 2 * x[a : a + 512] @ x.T
        d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
        out.append(np.argpartition(d, min(k, len(x) - 1) - 1, 1)[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Part of each vertex of the neighbour graph; parts is a power of two."""
    n, label = len(x), np.zeros(len(x), np.int64)
    for level in range(parts.bit_length() - 1):
        for p in range(1 << level):
            here = np.flatnonzero(label == p)
            if len(here) < 2:
                continue
            c = x[here] - x[here].mean(0)
            axis = np.linalg.eigh(c.T @ c)[1][:, -1]
            label[here[np.argsort(c @ axis, kind="stable")[len(here) // 2 :]]] = p + (1 << level)
    src = np.repeat(np.arange(n), near.shape[1])
    ends = np.concatenate([src, near.ravel()]), np.concatenate([near.ravel(), src])
    most = int(np.ceil(SLACK * n / parts))
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.float32)
        np.add.at(votes, (ends[0], label[ends[1]]), 1)
        want = votes.argmax(1)
        gain = votes[np.arange(n), want] - votes[np.arange(n), label]
        sizes, moved = np.bincount(label, minlength=parts), 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if sizes[want[v]] < most:
                sizes[label[v]] -= 1
                sizes[want[v]] += 1
                label[v] = want[v]
                moved += 1
        if moved < n // 500:
            break
    return label


class Router:
    """Softmax network with one hidden layer, trained with Adam."""

    def __init__(self, x: np.ndarray, target: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std() + 1e-12
        d, m = x.shape[1], target.shape[1]
        w = [rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, m)), np.zeros(m)]
        z = (x - self.mean) / self.scale
        mom, vel, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(z))
            for a in range(0, len(z), 128):
                at = order[a : a + 128]
                h = np.maximum(z[at] @ w[0] + w[1], 0)
                p = self._softmax(h @ w[2] + w[3])
                g = (p - target[at]) / len(at)
                gh = (g @ w[2].T) * (h > 0)
                step += 1
                for k, grad in enumerate((z[at].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                    mom[k] = 0.9 * mom[k] + 0.1 * grad
                    vel[k] = 0.999 * vel[k] + 0.001 * grad**2
                    w[k] = w[k] - 0.003 * (mom[k] / (1 - 0.9**step)) / (np.sqrt(vel[k] / (1 - 0.999**step)) + 1e-8)
        self.w = w

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w[0] + self.w[1], 0)
        return self._softmax(h @ self.w[2] + self.w[3])


def parts_for(vectors: int) -> int:
    """A power of two near half of the square root, 4 to 256."""
    return 1 << int(np.clip(np.round(np.log2(max(vectors, 1) ** 0.5 / 2)), 2, 8))


class Model:
    """A router, and the number of parts that a query must look into."""

    def __init__(self, x: np.ndarray, parts: int, recall: float):
        near = graph(x, min(NEIGHBOURS, len(x) - 1))
        label = balanced_parts(x, near, parts)
        target = np.zeros((len(x), parts))
        np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), label[near.ravel()]), 1 / near.shape[1])
        kept = np.arange(len(x)) % 5 > 0  # a fifth is held out to set the number
        p = Router(x[kept], target[kept]).probabilities(x)
        held = np.flatnonzero(~kept)
        # the place of each neighbour's part in the held-out point's order
        place = np.argsort(np.argsort(-p[held], 1, kind="stable"), 1)
        wanted = np.take_along_axis(place, p.argmax(1)[near[held]], 1)
        reached = np.cumsum(np.bincount(wanted.ravel(), minlength=parts)) / wanted.size
        self.probes = int(np.searchsorted(reached, recall) + 1)
        self.router = Router(x, target)

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.router.probabilities(x).argmax(1)

    def seen(self, x: np.ndarray) -> np.ndarray:
        """Which parts each row looks into: its most probable ones."""
        p = self.router.probabilities(x)
        out = np.zeros(p.shape, bool)
        np.put_along_axis(out, np.argsort(-p, 1, kind="stable")[:, : self.probes], True, 1)
        return out


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part, without repeats."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        "vec_id IS NOT NULL AND size(v) > 0 AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity')) AND exists(v, c -> c <> 0)"
    )
    rows = common.stash(rows.distinct(), "vectors")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == lengths["n"]) if lengths else rows


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids): every different vector with its ``keep`` smallest ids.  The
    first ranking is salted, so copies of one vector meet in small parts."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    first = salted.withColumn("r", F.row_number().over(W.partitionBy("v", "salt").orderBy("vec_id"))).where(F.col("r") <= keep)
    return first.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, keep).alias("ids"))  # SALTS * keep at most


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, recall: float = 0.95, id_col="vec_id", vec_col="embedding", every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each query, by
    Euclidean distance; ties go to the smaller id.  Queries are the rows of
    ``vectors`` whose id is divisible by ``every`` unless given (same columns)."""
    rows = valid(vectors, id_col, vec_col)
    asked = valid(queries, id_col, vec_col) if queries is not None else rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    base = common.stash(distinct_vectors(rows, k + 1), "vector-classes")
    found = base.count()
    sample = base.select("v").orderBy(F.xxhash64(F.col("ids")[0])).limit(SAMPLE).collect()  # bounded by SAMPLE
    parts = parts_for(found)
    model = Model(np.array([r.v for r in sample]), parts, recall) if len(sample) >= 20 * parts else None
    blob = rows.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    pieces = found // (parts * ROWS) + 1

    def to_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(blob.value)
        for b in batches:
            part = m.home(_matrix(b.column(0))) if m else np.zeros(b.num_rows, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part, pa.int32())], ["v", "ids", "part"])

    def to_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(blob.value)
        for b in batches:
            q, part = np.nonzero(m.seen(_matrix(b.column(1)))) if m else (np.arange(b.num_rows), np.zeros(b.num_rows, int))
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(q)).columns, pa.array(part, pa.int32())], ["vec_id", "v", "part"])

    def rerank(ask: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if ask.num_rows and held.num_rows:
            x, ids, q, qid = _matrix(held["v"]), held["ids"].to_pylist(), _matrix(ask["v"]), ask["vec_id"].to_pylist()
            sq, most = (x * x).sum(1), min(k + 1, len(x)) - 1
            for i, own in enumerate(qid):
                rough = sq - 2 * (x @ q[i])
                near = np.flatnonzero(rough <= np.partition(rough, most)[most] + 1e-9 * (sq.max() + q[i] @ q[i]))
                exact = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
                best = sorted((float(s), v) for s, c in zip(exact, near, strict=True) for v in ids[c] if v != own)
                out += [(own, v, s) for s, v in best[:k]]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    # two vectors may share a query's id: both are compared, the nearer counts
    index = worker.map_batches(base, to_home, "v array<double>, ids array<long>, part int").withColumn("piece", F.pmod(F.xxhash64("v"), F.lit(pieces)))
    routed = worker.map_batches(asked.select("vec_id", "v"), to_seen, "vec_id long, v array<double>, part int")
    routed = routed.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)).cast("array<long>")))
    near = routed.groupBy("part", "piece").cogroup(index.groupBy("part", "piece")).applyInArrow(worker.per_group(rerank), "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
