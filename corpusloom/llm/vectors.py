"""What the vector operators share: usable vectors, blocks of them, cosine in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether the vector is neither null nor zero and holds no null or non-finite component."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def to_matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dim)


def blocks(rows: DataFrame, vec_id: str, vector: str, n_blocks: int, extra: str | None = None) -> DataFrame:
    """Blocks (dim, block, n, ids, data, extra) of the rows, dealt by a hash of the id; data holds doubles.

    Of rows with the same id, one stays. `extra`: a long column to carry along.
    """
    v = F.col(f"`{vector}`")
    own = F.lit(0).cast("long") if extra is None else F.col(extra)
    dealt = rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v"), own.alias("extra"), F.size(v).alias("dim"), F.pmod(F.xxhash64(F.col(f"`{vec_id}`")), F.lit(n_blocks)).cast("int").alias("block"))

    def gather(key, table):
        dim, block = (k.as_py() for k in key)
        ids = table.column("id").to_numpy()
        data = to_matrix(table.column("v"), dim)
        order = np.lexsort((*data.T[::-1], ids))
        ids, data, more = ids[order], data[order], table.column("extra").to_numpy()[order]
        first = np.concatenate([[True], ids[1:] != ids[:-1]])
        ids, data, more = ids[first], data[first], more[first]
        return pa.table({"dim": [dim], "block": [block], "n": [len(ids)], "ids": [ids.tobytes()], "data": [data.tobytes()], "extra": [more.tobytes()]}, schema=_BLOCK)

    return dealt.groupBy("dim", "block").applyInArrow(gather, "dim int, block int, n int, ids binary, data binary, extra binary")


_BLOCK = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("data", pa.binary()), ("extra", pa.binary())])


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(dots(x, x))


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise dot products, summed in the order of the components whatever the rows' number."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * y[:, k]
    return out
