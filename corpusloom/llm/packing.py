"""Packing by optimal length buckets.

The global histogram of lengths decides the bucket boundaries: dynamic programming over it finds
the `buckets` boundaries with the least padding when every sequence is padded to its bucket's
boundary. Inside a bucket, sequences are dealt into batches whose padded tokens stay within a
budget.

The histogram is exact below 1024 and has 256 cells for each doubling above, so it has some
thousand cells however many rows there are; the driver sees those cells alone. A cell's upper end
is the greatest length in it, so no boundary cuts a sequence.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import gapless_rank, materialize
from corpusloom.llm.mixing import word_count

EXACT, FINE = 1024, 256
BUCKETS, TOKEN_BUDGET = 8, 16384


def cell_of(length: Column) -> Column:
    """The histogram cell of a length >= 1, as its lower end."""
    shift = F.greatest(F.lit(0), F.floor(F.log2(length.cast("double"))) - 8).cast("int")
    step = F.pow(F.lit(2.0), shift).cast("long")
    return F.when(length < EXACT, length).otherwise(F.floor(length / step).cast("long") * step)


def optimal_boundaries(cells: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Upper ends of the buckets with the least padding, for cells (greatest length, rows, tokens) in order.

    Of equal paddings, the one whose last buckets begin earliest wins.
    """
    if not cells:
        return []
    top, rows, tokens = (np.array(x, np.int64) for x in zip(*cells, strict=True))
    n = np.concatenate([[0], np.cumsum(rows)])
    m = np.concatenate([[0], np.cumsum(tokens)])
    size = len(top)
    # cost[i, j]: padding of one bucket of the cells i to j - 1
    best = np.full(size + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    back = []
    for _ in range(min(buckets, size)):
        new, came = best.copy(), np.full(size + 1, -1)
        for j in range(1, size + 1):
            cost = best[:j] + top[j - 1] * (n[j] - n[:j]) - (m[j] - m[:j])
            i = int(cost.argmin())
            if cost[i] < new[j]:
                new[j], came[j] = cost[i], i
        back.append(came)
        best = new
    ends, j, k = [], size, len(back) - 1
    while j > 0 and k >= 0:
        if back[k][j] >= 0:
            ends.append(int(top[j - 1]))
            j = int(back[k][j])
        k -= 1
    return ends[::-1]


def pack(rows: DataFrame, length: str = "length", key: str = "doc_id", buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, copy: str | None = None) -> DataFrame:
    """`rows` with bucket (from 0, by boundary), pad_to, batch (from 0 in its bucket) and slot (from 0 in its batch).

    `copy`: a column for the place among rows of equal key and length, from 0. Columns that have these names are replaced.

    Each batch has at most max(1, token_budget // pad_to) sequences, so its padded tokens stay within
    the budget unless one sequence alone exceeds it. Null lengths and lengths below 1 have no batch
    (bucket null). Rows are dealt in MD5 order of the key; equal keys are rows of their own.
    """
    own = F.col(f"`{length}`").cast("long")
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    histogram = rows.select(own.alias("n")).where("n >= 1").groupBy(cell_of(F.col("n")).alias("cell"))
    cells = histogram.agg(F.max("n").alias("top"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens")).orderBy("cell").collect()
    ends = optimal_boundaries([(c["top"], c["rows"], c["tokens"]) for c in cells], buckets)
    bucket, pad_to = F.lit(None).cast("int"), F.lit(None).cast("long")
    for b in reversed(range(len(ends))):
        bucket, pad_to = F.when(own <= ends[b], F.lit(b)).otherwise(bucket), F.when(own <= ends[b], F.lit(ends[b]).cast("long")).otherwise(pad_to)
    filled = own >= 1
    dealt = rows.withColumn("bucket", F.when(filled, bucket)).withColumn("pad_to", F.when(filled, pad_to))
    dealt = dealt.withColumn("__h", F.md5(name)).withColumn("__b", F.substring("__h", 1, 2))
    ranked = gapless_rank(dealt, ["bucket"], "__b", [F.col("__h"), F.col(f"`{key}`"), own], "__rank", copy).drop("__h", "__b")
    per = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("pad_to"))).cast("long")
    ranked = ranked.withColumn("batch", F.when(F.col("bucket").isNotNull(), F.floor(F.col("__rank") / per).cast("long")))
    return ranked.withColumn("slot", F.when(F.col("bucket").isNotNull(), F.pmod("__rank", per))).drop("__rank")


def packed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, length (words), bucket, pad_to, batch, slot of each document."""
    sized = materialize(docs.select("doc_id", word_count().alias("length")), "lengths")
    return pack(sized).select("doc_id", "length", "bucket", "pad_to", "batch", "slot")


def packed_rows(docs: DataFrame) -> DataFrame:
    """`docs` with all columns and length (words), bucket, pad_to, batch, slot and copy."""
    return pack(docs.withColumn("length", word_count()), copy="copy")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_layer(k: int) -> str:
    """Least padding of the cells up to j in at most k buckets, and the boundaries; fewer buckets and an earlier begin win ties."""
    return f"""
m{k} AS (
  SELECT c.j, min(p.cost + c.top * (c.n - p.n) - (c.m - p.m)) AS cost, arg_min(p.ends, (p.cost + c.top * (c.n - p.n) - (c.m - p.m)) * 100000 + p.j) AS ends
  FROM cells c JOIN p{k - 1} p ON p.j < c.j GROUP BY c.j),
p{k} AS (
  SELECT p.j, p.n, p.m, CASE WHEN m.cost < p.cost THEN m.cost ELSE p.cost END AS cost, CASE WHEN m.cost < p.cost THEN list_append(m.ends, c.top) ELSE p.ends END AS ends
  FROM p{k - 1} p LEFT JOIN m{k} m USING (j) LEFT JOIN cells c USING (j))"""


ORACLE_PACKING = f"""
WITH sized AS (
  SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS length FROM documents),
grouped AS (
  SELECT CASE WHEN length < 1024 THEN length ELSE (length >> CAST(floor(log2(length)) - 8 AS INT)) << CAST(floor(log2(length)) - 8 AS INT) END AS cell, max(length) AS top, count(*) AS rows, CAST(sum(length) AS BIGINT) AS tokens
  FROM sized WHERE length >= 1 GROUP BY 1),
cells AS (
  SELECT row_number() OVER (ORDER BY cell) AS j, top, CAST(sum(rows) OVER (ORDER BY cell) AS BIGINT) AS n, CAST(sum(tokens) OVER (ORDER BY cell) AS BIGINT) AS m FROM grouped),
p0 AS (
  SELECT 0 AS j, 0 AS n, 0 AS m, 0 AS cost, CAST([] AS BIGINT[]) AS ends
  UNION ALL SELECT j, n, m, 1000000000000, CAST([] AS BIGINT[]) FROM cells),
{",".join(map(_sql_layer, range(1, BUCKETS + 1)))},
best AS (SELECT unnest(ends) AS pad_to, generate_subscripts(ends, 1) - 1 AS bucket, unnest(list_concat([0], ends[1:len(ends) - 1])) AS above FROM p{BUCKETS} WHERE j = (SELECT max(j) FROM cells)),
ranked AS (
  SELECT s.*, b.bucket, b.pad_to, row_number() OVER (PARTITION BY b.bucket ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, length) - 1 AS r
  FROM sized s LEFT JOIN best b ON s.length > b.above AND s.length <= b.pad_to)
SELECT doc_id, length, CAST(bucket AS INTEGER) AS bucket, pad_to, CASE WHEN bucket IS NOT NULL THEN r // greatest(1, {TOKEN_BUDGET} // pad_to) END AS batch,
  CASE WHEN bucket IS NOT NULL THEN r % greatest(1, {TOKEN_BUDGET} // pad_to) END AS slot FROM ranked
"""
