"""Dedup and summary of sentences by vectors that come as a column."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WINDOW = 500
#: Rows of a block of `pairs_over`, on average, and those of its products at a time; beyond what rounding moves a cosine.
BLOCK, ROWS, MARGIN = 2048, 128, 1e-8
SUMMARY_SHARE, SUMMARY_LEAST, SUMMARY_MOST, SUMMARY_FROM = 0.2, 3, 10, 4


def cosine(a, b):
    """Cosine of two array columns in double precision; 0 where a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def _dot(x, y):
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def unit(v):
    """The array in double precision, by its length; zeros where that is 0."""
    wide = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(wide, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def mean_pool(tokens, mask):
    """Unit mean of the token vectors (array of arrays) whose mask is 1; zeros if there are none."""
    used = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["t"])
    zero = F.transform(F.get(tokens, F.lit(0)), lambda _: F.lit(0.0))
    total = F.aggregate(used, zero, lambda s, t: F.zip_with(s, t, lambda a, b: a + b.cast("double")))
    return unit(F.transform(total, lambda x: x / F.greatest(F.size(used), F.lit(1))))


def greedy_dedup(rows: DataFrame, group: str, order: str, vector: str, threshold: float = 0.8, window: int = WINDOW) -> DataFrame:
    """group, order, kept, kept_order, similarity: in order, a row goes if its nearest of the last `window` kept rows is near enough.

    Of equally near ones the last counts. The order within a group matters, so a group is one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        places, vectors, out = [], [], []
        for place, v in zip(pdf[order], pdf[vector], strict=True):
            x = np.asarray(v, np.float64)
            n = np.sqrt(x @ x)
            x = x / n if n > 0 else x
            if places:
                sims = np.stack(vectors[-window:]) @ x
                best = len(sims) - 1 - int(sims[::-1].argmax())
                if sims[best] >= threshold:
                    out.append((place, False, places[-window:][best], float(sims[best])))
                    continue
            places.append(place)
            vectors.append(x)
            out.append((place, True, None, None))
        frame = pd.DataFrame(out, columns=[order, "kept", "kept_order", "similarity"])
        frame["kept_order"] = frame["kept_order"].astype("Int64")
        frame.insert(0, group, pdf[group].iloc[0])
        return frame

    kinds = dict(rows.dtypes)
    return rows.select(group, order, vector).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {order} {kinds[order]}, kept boolean, kept_order long, similarity double")


def extractive_summary(rows: DataFrame, group: str, order: str, vector: str, window: int = WINDOW) -> DataFrame:
    """group, order, centrality of the most central rows of each group of four or more: a fifth, at least 3, at most 10.

    Centrality is the mean cosine to the group's landmarks but itself; landmarks are every stride-th row,
    at most `window` of them, so a group of n rows makes at most n * window products.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    ranked = rows.select(group, order, unit(F.col(vector)).alias("v")).withColumn("n", n).where(F.col("n") >= SUMMARY_FROM)
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).withColumn("stride", F.ceil(F.col("n") / window))
    marks = ranked.where("r % stride = 0").select(F.col(group).alias("__g"), F.col("r").alias("mr"), F.col("v").alias("mv"))
    pairs = ranked.join(marks, (F.col(group) == F.col("__g")) & (F.col("r") != F.col("mr")))
    scored = pairs.groupBy(group, order, "n").agg(F.avg(_dot(F.col("v"), F.col("mv"))).alias("centrality"))
    take = F.greatest(F.lit(SUMMARY_LEAST), F.least(F.round(F.col("n") * SUMMARY_SHARE).cast("int"), F.least(F.lit(SUMMARY_MOST), F.col("n").cast("int"))))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.round("centrality", 9).desc(), order)))
    return best.where(F.col("rank") <= take).select(group, order, F.round("centrality", 6).alias("centrality"))


def _tile_pairs(table: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places p, q and similarities of the pairs of a tile (i, j, block, v) that may reach the threshold, and of those that are no number.

    A matrix product leaves out what is surely below; the others' sums are made in the order of the components.
    """
    v, block = table.column("v").combine_chunks(), table.column("block").to_numpy()
    x = np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(v), -1) if len(v.flatten()) else np.zeros((len(v), 0))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    with np.errstate(all="ignore"):
        norm = np.zeros(len(x))
        for k in range(x.shape[1]):
            norm += x[:, k] * x[:, k]
        norm = np.sqrt(norm)[:, None]
        x = np.where(~(norm <= 0), x / norm, 0.0)
        i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for at in range(0, len(left), ROWS):
            near = ~(x[left[at : at + ROWS]] @ x[right].T < threshold - MARGIN)
            if i == j:
                near &= np.arange(len(right))[None] > np.arange(at, at + len(near))[:, None]
            p, q = np.nonzero(near)
            p, q = left[at + p], right[q]
            sums = np.zeros(len(p))
            for k in range(x.shape[1]):
                sums += x[p, k] * x[q, k]
            out.append((p, q, sums))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def pairs_over(rows: DataFrame, group: str, order: str, vector: str, threshold: float) -> DataFrame:
    """group, a, b, similarity of the pairs of one group (a before b) at or over a threshold.

    The rows of a group are dealt into blocks, and each two blocks meet in one task; rows without a group or with null components are in no pair.
    """
    v = F.col(vector)
    used = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), v.alias("v"), F.size(v).alias("dim")).where(F.col("g").isNotNull() & F.col("o").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    blocks = used.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = used.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("o", "v"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("g", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "o", "v")
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}

    def meet(key, table):
        p, q, sums = _tile_pairs(table, threshold)
        o = table.column("o").combine_chunks()
        return pa.table([pa.repeat(key[0], len(p)), o.take(pa.array(p)), o.take(pa.array(q)), pa.array(sums, from_pandas=False)], ["g", "x", "y", "similarity"])

    both = dealt.groupBy("g", "dim", "i", "j").applyInArrow(meet, f"g {kinds['g']}, x {kinds['o']}, y {kinds['o']}, similarity double")
    both = both.where((F.col("x") != F.col("y")) & (F.round("similarity", 9) >= threshold))
    return both.select(F.col("g").alias(group), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round("similarity", 6).alias("similarity"))
