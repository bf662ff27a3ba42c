"""Operator 2: exact top-k inner products by columnar branch-and-bound.

Queries are broadcast in blocks of at most QUERY_BYTES; each task reads its
candidates in vertical layout (one row per dimension).  Scores are accumulated
block of dimensions by block; after each block the remaining mass of a pair is
bounded by Cauchy-Schwarz (norm of the query's rest times norm of the
candidate's rest), and pairs that can no longer reach the query's current
k-th score are compacted away.  Bounds are compared with ``<``, so ties with
the k-th score survive and are settled by the smaller id.

A task keeps the best k per query; a window over (query, score) with a rank
limit merges them, cut map-side first.  Nothing is sampled: every candidate is
compared with every query, in blocks.

Vectors that are null or hold a null or non-finite component take no part;
vectors of different lengths count as padded with zeros.  Rows with a query's
id are its own and no candidates of it; of repeated rows of one id and score
one is listed; a null id is neither query nor candidate.  Empty tables give an
empty result.  Components are whole numbers; sums are exact up to 2^53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 5
DIM_BLOCK = 16
QUERY_BYTES = 32 << 20
TILE_QUERIES = 256
TILE_ROWS = 2048
#: share of pairs left below which a tile goes on with the pairs alone
SPARSE = 0.25


def quantize(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) per component, or null where the vector takes no part."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(wide.isNotNull() & ~bad, F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def _matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Vertical layout (dimension x row) of a list column, padded with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.values.slice(column.offsets[0].as_py(), int(size.sum())).to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(int(size.max(initial=0)), dim or 0)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return np.ascontiguousarray(out.T)


class Best:
    """The k best (score, id) per query so far, and the score to reach."""

    def __init__(self, n: int, k: int) -> None:
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max, np.int64)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        k = self.score.shape[1]
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        again = np.append(False, (q[1:] == q[:-1]) & (ids[1:] == ids[:-1]) & (score[1:] == score[:-1]))
        q, ids, score = q[~again], ids[~again], score[~again]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < k
        for j in np.unique(q[top]):
            mine = top & (q == j) if len(q) < 64 else slice(*np.searchsorted(q, [j, j + 1]))
            s = np.concatenate([self.score[j], score[mine][:k]])
            i = np.concatenate([self.id[j], ids[mine][:k]])
            first = np.lexsort((i, -s))
            keep = first[np.append(True, (np.diff(s[first]) != 0) | (np.diff(i[first]) != 0))][:k]
            self.score[j, :len(keep)], self.id[j, :len(keep)] = s[keep], i[keep]


def _rest(m: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norm of what is left of each column at every cut."""
    square = np.add.reduceat(m * m, cuts, axis=0) if m.shape[0] else np.zeros((len(cuts), m.shape[1]))
    return np.sqrt(np.cumsum(square[::-1], axis=0)[::-1])


def _tile(best: Best, at: int, q: np.ndarray, qid: np.ndarray, c: np.ndarray, cid: np.ndarray) -> None:
    cuts = list(range(0, q.shape[0], DIM_BLOCK))
    qr, cr = _rest(q, cuts), _rest(c, cuts)
    floor = best.score[at:at + q.shape[1], -1]
    total = np.zeros((q.shape[1], c.shape[1]))
    qi = ci = part = None
    for b, lo in enumerate(cuts):
        hi = min(lo + DIM_BLOCK, q.shape[0])
        if qi is None:
            total += q[lo:hi].T @ c[lo:hi]
        else:
            part = part + np.einsum("ij,ij->j", q[lo:hi][:, qi], c[lo:hi][:, ci])
        if b + 1 == len(cuts):
            break
        # the bound is raised by a relative rounding margin, so it never cuts a pair that could tie
        if qi is None:
            alive = total + qr[b + 1][:, None] * cr[b + 1] * (1 + 1e-9) + 1e-6 >= floor[:, None]
            if alive.mean() < SPARSE:
                qi, ci = np.nonzero(alive)
                part = total[qi, ci]
        else:
            alive = part + qr[b + 1][qi] * cr[b + 1][ci] * (1 + 1e-9) + 1e-6 >= floor[qi]
            qi, ci, part = qi[alive], ci[alive], part[alive]
    if qi is None:
        qi, ci = np.nonzero(total >= floor[:, None])
        part = total[qi, ci]
    ok = (part >= floor[qi]) & (qid[qi] != cid[ci])
    if ok.any():
        best.add(at + qi[ok], cid[ci[ok]], part[ok])


def _search(model, k: int):
    def run(batches):
        qid, q = model.value
        best = Best(len(qid), k)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            rows = _matrix(batch.column(1), q.shape[0])
            own = np.zeros((rows.shape[0], q.shape[1]))
            own[:q.shape[0]] = q
            for a in range(0, len(ids), TILE_ROWS):
                for b in range(0, len(qid), TILE_QUERIES):
                    _tile(best, b, own[:, b:b + TILE_QUERIES], qid[b:b + TILE_QUERIES],
                          rows[:, a:a + TILE_ROWS], ids[a:a + TILE_ROWS])
        j, r = np.nonzero(np.isfinite(best.score))
        yield pa.RecordBatch.from_arrays([pa.array(qid[j]), pa.array(best.id[j, r]),
                                          pa.array(best.score[j, r].astype(np.int64))], ["query_id", "vec_id", "score"])

    return run


def _query_blocks(queries: DataFrame):
    """(ids, matrix) of at most QUERY_BYTES each."""
    ids: list[int] = []
    rows: list = []
    size = 0
    for i, v in queries.toLocalIterator():
        if ids and size + 8 * len(v) > QUERY_BYTES:
            yield np.array(ids, np.int64), _matrix(pa.array(rows, pa.list_(pa.int64())))
            ids, rows, size = [], [], 0
        ids.append(i)
        rows.append(v)
        size += 8 * len(v)
    if ids:
        yield np.array(ids, np.int64), _matrix(pa.array(rows, pa.list_(pa.int64())))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding",
          scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of the quantized vectors per query row."""
    spark = vectors.sparkSession
    usable = vectors.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), quantize(F.col(vector), scale).alias("v"), is_query.alias("q")).where("v IS NOT NULL")
    found = None
    for block in _query_blocks(usable.where("q").select("id", "v").dropDuplicates()):
        model = spark.sparkContext.broadcast(block)
        part = usable.select("id", "v").mapInArrow(_search(model, k), "query_id long, vec_id long, score long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
