"""Helpers shared by the corpus operators: shared storage, components, distributed ranks."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bits of the bitmap that `sift` broadcasts, at most.
SIFT_BITS = 1 << 27


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset and all run in one process, a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


class _Written(threading.local):
    """Tables that this thread has written to the shared folder and not deleted, by path."""

    def __init__(self):
        self.paths: list[str] = []


_written = _Written()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: short lineage, survives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    _written.paths.append(path)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for table in tables:
        if path := table.__dict__.get("written_to"):
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    if (jvm := getattr(spark, "_jvm", None)) is not None and path in _written.paths:
        _written.paths.remove(path)
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def settled(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The result of `build`, materialized; the tables that it wrote on the way are deleted."""
    before = list(_written.paths)
    out = materialize(build(), label)
    for path in [p for p in _written.paths if p not in before and p != out.written_to]:
        _delete(spark, path)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of the texts, from one pass over that column."""
    return df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def sift(rows: DataFrame, key: str, ids: DataFrame, absent: bool = False) -> DataFrame:
    """`rows` whose `key` (a long) may be among the values of the only column of `ids`; with `absent` the others, which surely are not.

    It spares a join with `ids` the shuffle of most rows without a partner; a null key is absent. A bitmap of hashes is
    broadcast, 16 to 32 bits a value and never more than SIFT_BITS (16 MB) in all: beyond SIFT_BITS / 16 values more rows
    may be let through, in the end all, but never fewer.
    """
    bits = min(SIFT_BITS, max(1 << 15, 1 << (16 * ids.count()).bit_length()))

    def place(name):
        return F.pmod(F.xxhash64(F.col(f"`{name}`").cast("long")), F.lit(bits))

    (value,) = ids.columns
    seen = ids.where(F.col(f"`{value}`").isNotNull()).select(place(value).alias("at"))
    seen = seen.select(F.shiftright("at", 15).alias("__block"), F.col("at").bitwiseAND(32767).alias("bit"))
    bitmap = seen.groupBy("__block").agg(F.bitmap_construct_agg("bit").alias("__bits"))
    at = place(key)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(at.bitwiseAND(32767), 3).cast("int") + 1, F.lit(1))), 16, 10)
    found = (F.shiftright(at, 15) == F.col("__block")) & (F.getbit(byte.cast("long"), at.bitwiseAND(7).cast("int")) == 1)
    return rows.join(F.broadcast(bitmap), F.col(f"`{key}`").isNotNull() & found, "left_anti" if absent else "left_semi")


def gapless_rank(df: DataFrame, group: list[str], bucket: str, order: list[Column], out: str, tie: str | None = None) -> DataFrame:
    """0-based rank of each row inside its group, by (bucket, order), as the column `out`; `tie`: the place among rows of equal order, from 0.

    No task sees a whole group: rows are ranked inside (group, bucket) and shifted by the
    total of the buckets before, which come from a table of one row for each bucket.
    """
    totals = df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    keys = [*group, bucket]
    inside = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("__r", F.row_number().over(inside) - 1)
    ties = [] if tie is None else [(F.col("__r") + 1 - F.col("__first")).cast("int").alias(tie)]
    if ties:
        ranked = ranked.withColumn("__first", F.rank().over(inside))
    on = [ranked[k].eqNullSafe(offsets[k]) for k in keys]
    joined = ranked.join(offsets, on)
    return joined.select(*[ranked[c] for c in df.columns if c not in (out, tie)], (F.col("__r") + F.col("__off")).cast("long").alias(out), *ties)


def _forest(batches):
    """Union-find over the edges of one partition; emits a star for each component seen there."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = find(a), find(b)
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            if ra != rb:
                lo, hi = (ra, rb) if ra < rb else (rb, ra)
                parent[hi] = lo
    lo, hi = [], []
    for x in list(parent):
        if (root := find(x)) != x:
            lo.append(root)
            hi.append(x)
    for at in range(0, len(lo), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(lo[at : at + 65536], pa.int64()), pa.array(hi[at : at + 65536], pa.int64())], ["lo", "hi"])


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of `edges` (two long columns): node, component (its smallest node).

    Alternating large-star and small-star rounds, each two shuffles of at most the edges; the
    edges of a partition are first contracted to stars in place. Nothing goes to the driver but
    a checksum a round. Nodes without an edge to another node are not returned.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns)
    e = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi")
    e = materialize(e.mapInArrow(_forest, "lo long, hi long"), "cc")
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))  # lo: the node, hi: its neighbour
        least = both.groupBy("lo").agg(F.min("hi").alias("m")).withColumn("m", F.least("m", "lo"))
        large = both.where("hi > lo").join(least, "lo").select(F.col("m").alias("lo"), "hi").distinct()
        best = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(best, "hi").where("lo > m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        old, e = e, materialize(small.unionByName(best.select(F.col("m").alias("lo"), "hi")).distinct(), "cc")
        release(old)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if now == last:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        last = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def offsets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a (large) binary or string array without nulls, and the offset of each value plus the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = column.cast(pa.large_binary())
    _, off, data = large.buffers()
    offsets = np.frombuffer(off, np.int64)[large.offset : large.offset + len(large) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
