"""Sharding by weighted rendezvous hashing of stable record keys.

A key draws a uniform number for each shard, from MD5 of "key#shard"; the shard with the greatest
-weight / ln(u) gets it. A draw depends on the key and that shard alone, so a further shard only
takes the keys for which its own draw wins, and moves none between the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import gapless_rank


def uniform(key: Column, shard: int) -> Column:
    """A number in (0, 1) from 52 bits of MD5; the same in any engine."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"#{shard}"))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard, 0 to len(weights) - 1, of a text key; equal scores go to the smaller shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    draws = [F.struct((-float(w) / F.ln(uniform(key, i))).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)]
    return (-F.array_max(F.array(*draws))["shard"]).cast("int")


def shard(docs: DataFrame, weights: list[float], key: str = "doc_id", grown_by: float = 1.0, then: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with shard, slot (gapless from 0 in each shard) and grown_shard (with one more shard of weight `grown_by`).

    Keys are compared as text; a null key counts as the empty text. Rows with equal keys share a
    shard and get slots of their own. Slots follow MD5 of the key, then the key, then the columns `then`, so that rows that
    are equal in all of these alone may change places between runs.
    """
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    dealt = docs.withColumn("shard", rendezvous(name, weights)).withColumn("grown_shard", rendezvous(name, [*weights, grown_by]))
    dealt = dealt.withColumn("__h", F.md5(name)).withColumn("__b", F.substring("__h", 1, 2))
    return gapless_rank(dealt, ["shard"], "__b", [F.col("__h"), F.col(f"`{key}`"), *(F.col(f"`{c}`") for c in then)], "slot").drop("__h", "__b")


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document in shards 0 to 7 by the law `key`: doc_id and the number of shards decide.

    Copies of a text have keys of their own and are not held together.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    return shard(rows, [1.0] * 8, then=("size", "text_crc32")).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql_draw(shard: int) -> str:
    return f"CAST('0x' || substr(md5(k || '#{shard}'), 1, 13) AS BIGINT)"


#: With equal weights the greatest draw wins; CRC-32 is folded over the bytes by its table.
ORACLE_SHARDING = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents),
dealt AS (
  SELECT doc_id, text, md5(k) AS h, [{", ".join(map(_sql_draw, range(9)))}] AS u FROM keyed),
placed AS (
  SELECT *, list_position(u[1:8], list_max(u[1:8])) - 1 AS shard, list_position(u, list_max(u)) - 1 AS grown FROM dealt)
SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size,
  CAST(xor(4294967295, list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS BIGINT) AS text_crc32,
  'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM placed, crc
"""
