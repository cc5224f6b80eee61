"""Nearest neighbours by a block matrix join over int8 tiles.

Vectors are normalised and quantised to int8 with a scale of their own; the length of what the
rounding left bounds the error of every product: with u = s * c + r, |<u, v> - s_u s_v <c_u, c_v>| is at
most |r_u| + |r_v| (1 + |r_u|). A task holds a cell of rows and a portion of queries, in blocks; one integer product
tile gives all approximate cosines of two blocks, those whose upper bound reaches the k-th best lower bound (after
a query's first tile: its k-th best cosine so far) are computed again in double precision, and heaps merge the best of
all cells. So the answer is exact.

A tile's integer product runs as a float32 matrix product of at most 1024 dimensions at a time, which is
exact: its sums stay below 2 ** 24.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.vectors import dots, norms, to_matrix, usable

ROW_BLOCK, QUERY_BLOCK = 8192, 512
#: Bytes of the vectors that a task holds of the rows, and of the queries.
CELL_BYTES = 96 << 20
NEIGHBOURS = 5
_SLACK = 1e-9
_ROUNDED = 1e-6
_FOUND = pa.schema([("query_id", pa.int64()), ("score", pa.float64()), ("vec_id", pa.int64())])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as float32), scales and lengths of the rounding errors of the normalised rows."""
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    scale = np.abs(u).max(axis=1) / 127
    codes = np.rint(u / scale[:, None])
    error = np.sqrt(((u - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes.astype(np.float32), scale, error


def integer_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a[:, :1024] @ b[:, :1024].T
    for at in range(1024, a.shape[1], 1024):
        out = out.astype(np.float64) + a[:, at : at + 1024] @ b[:, at : at + 1024].T
    return out


def best_of_tile(q_ids, q, ids, x, k: int):
    """The k nearest rows of one block for each query: indices of queries, indices of rows, cosines."""
    cq, sq, eq = quantise(q)
    cx, sx, ex = quantise(x)
    near = integer_product(cq, cx) * (sq[:, None] * sx[None, :])
    bound = eq[:, None] + (1 + eq[:, None]) * ex[None, :] + _SLACK
    lower = np.where(q_ids[:, None] == ids[None, :], -np.inf, near - bound)
    kth = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] > k else np.full(len(q), -np.inf)
    alive = (near + bound >= kth[:, None]) & (lower > -np.inf)
    rows, cols = np.nonzero(alive)
    nq, nx = norms(q), norms(x)
    score = np.empty(len(rows))
    for at in range(0, len(rows), 1 << 16):
        i, j = rows[at : at + (1 << 16)], cols[at : at + (1 << 16)]
        score[at : at + (1 << 16)] = dots(q[i], x[j]) / (nq[i] * nx[j])
    order = np.lexsort((ids[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    start = np.searchsorted(rows, np.arange(len(q)))
    top = np.arange(len(rows)) - start[rows] < k
    return rows[top], cols[top], score[top]


def _batches(table: pa.Table, most: int):
    """ids and vectors in double precision of at most `most` rows at a time; of rows with one id, the one of the least vector."""
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    again = ids[order][1:] == ids[order][:-1]
    gone = np.zeros(len(ids), bool)
    if again.any():
        for same in np.split(order, np.flatnonzero(~again) + 1):
            if len(same) > 1:
                vectors = [tuple(v) for v in table.column("v").take(pa.array(same)).to_pylist()]
                gone[same] = True
                gone[same[vectors.index(min(vectors))]] = False
    at = 0
    for batch in table.select(["v"]).to_batches(max_chunksize=most):
        n, stay = len(batch), ~gone[at : at + len(batch)]
        if stay.any():
            yield ids[at : at + n][stay], to_matrix(batch.column(0), len(batch.column(0)[0]))[stay]
        at += n


class _Asked:
    """A block of queries and the best that each has met so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.codes, self.scale, self.error = quantise(q)
        self.length = norms(q)
        self.owner, self.score, self.near = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.kth = np.full(len(q), -np.inf)

    def meet(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, scale: np.ndarray, error: np.ndarray, length: np.ndarray) -> None:
        if np.isinf(self.kth).any():  # not all have k yet
            i, j, score = best_of_tile(self.ids, self.q, ids, x, self.k)
            return self._keep(i, score, ids[j])
        product = integer_product(self.codes, codes)
        # cosine <= product * both scales + bound, with the greatest error of the rows; _ROUNDED is for the products of float32
        bound = self.error + (1 + self.error) * error.max() + _SLACK + _ROUNDED
        least = ((self.kth - bound) / self.scale).astype(product.dtype)
        product *= scale.astype(product.dtype)
        i, j = np.divmod(np.flatnonzero(product >= least[:, None]), len(ids))
        other = self.ids[i] != ids[j]
        i, j = i[other], j[other]
        score = np.empty(len(i))
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            score[at : at + (1 << 16)] = dots(self.q[a], x[b]) / (self.length[a] * length[b])
        good = score >= self.kth[i]
        self._keep(i[good], score[good], ids[j[good]])

    def _keep(self, owner: np.ndarray, score: np.ndarray, near: np.ndarray) -> None:
        if not len(owner):
            return
        owner, score, near = (np.concatenate(x) for x in ((self.owner, owner), (self.score, score), (self.near, near)))
        order = np.lexsort((near, -score, owner))
        owner = owner[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        top = place < self.k
        self.owner, self.score, self.near = owner[top], score[order][top], near[order][top]
        last = place[top] == self.k - 1
        self.kth[self.owner[last]] = self.score[last]


def _cell(k: int, row_block: int, query_block: int):
    """The k nearest of a cell's rows for each query of a portion, in blocks of so many."""

    def run(key, table, queries):
        if not len(table) or not len(queries):
            return _FOUND.empty_table()
        asked = [_Asked(ids, q, k) for ids, q in _batches(queries, query_block)]
        for ids, x in _batches(table, row_block):
            codes, scale, error = quantise(x)
            length = norms(x)
            for block in asked:
                block.meet(ids, x, codes, scale, error, length)
        return pa.table([np.concatenate(c) for c in zip(*((b.ids[b.owner], b.score, b.near) for b in asked), strict=True)], schema=_FOUND)

    return run


def _merge(k: int):
    """Keeps the k best of each query from rows sorted by query, by a heap of k."""

    def run(batches):
        query, heap, out = None, [], []

        def close():
            for rank, (score, other) in enumerate(sorted(heap, reverse=True), 1):
                out.append((query, rank, -other, score))

        for batch in batches:
            for q, score, vec in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if q != query:
                    close()
                    query, heap = q, []
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                else:
                    heapq.heappushpop(heap, (score, -vec))
            if len(out) > 10000:
                yield _ranked(out)
                out = []
        close()
        yield _ranked(out)

    return run


def _ranked(out: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], ["query_id", "rank", "vec_id", "score"])


def nearest(queries: DataFrame, rows: DataFrame, k: int = NEIGHBOURS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of greatest cosine for each query, ties to the smaller id.

    A row is no neighbour of a query with its own id. Vectors that are null, zero or hold a null or
    non-finite component, null ids and vectors of another length than the query's take no part; of
    rows with one id, one counts. Cells of at most about CELL_BYTES of rows meet portions of as many bytes of
    queries, so the queries move once for each cell and the rows once for each portion, whatever the number of blocks.
    """
    rows, queries = _good(rows, vec_id, vector), _good(queries, vec_id, vector)
    n, width = _extent(rows)
    n_queries, q_width = _extent(queries)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    cells = max(1, -(-n * width // CELL_BYTES), min(-(-n // ROW_BLOCK), 2 * cores))
    portions = max(1, -(-n_queries * q_width // CELL_BYTES))
    data = _dealt(rows, "cell", cells, "portion", portions).groupBy("dim", "cell", "portion")
    asked = _dealt(queries, "portion", portions, "cell", cells).groupBy("dim", "cell", "portion")
    found = data.cogroup(asked).applyInArrow(_cell(k, ROW_BLOCK, QUERY_BLOCK), "query_id long, score double, vec_id long")
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


def _good(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    good = df.where(F.col(f"`{vec_id}`").isNotNull() & usable(vector))
    return good.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"), F.size(f"`{vector}`").alias("dim"))


def _extent(df: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of the longest one."""
    size = 4 if dict(df.dtypes)["v"] == "array<float>" else 8
    n, dim = df.agg(F.count(F.lit(1)), F.max("dim")).first()
    return n, size * (dim or 1)


def _dealt(df: DataFrame, own: str, n: int, other: str, copies: int) -> DataFrame:
    """The rows dealt by a hash of the id into `n` of what `own` numbers, and a copy of each for all that `other` numbers."""
    return df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def op3_ann(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows.where("vec_id % 50 = 0"), rows)


#: Sums in the order of the components, as the operator's.
ORACLE_ANN = """
WITH good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
length AS (SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS n FROM good),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id,
         list_reduce(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2]), lambda a, b: a + b) / (q.n * r.n) AS score
  FROM length q JOIN length r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
