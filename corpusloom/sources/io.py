"""Sources and sinks: literals, whole files, batches, transcripts; texts, contracts, pruned copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.kernels import text_kernel
from corpusloom.functions.strict_json import parse
from corpusloom.functions.text import lines


class InputError(ValueError):
    """Input that cannot be used; `code` is the exit code of a command."""

    code = 2


def literal(spark: SparkSession, *texts: str) -> DataFrame:
    """doc_id (from 0), text."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's path), text: each file is one document."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def table(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    return spark.read.parquet(path).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


def _batch(text: str) -> list[tuple] | None:
    ok, value = parse(text)
    if not ok or not isinstance(value, list):
        return None
    flag = lambda x, name, default: x.get(name) if isinstance(x.get(name), bool) else default
    out = []
    for i, x in enumerate(value):
        x = x if isinstance(x, dict) else {}
        name, body = x.get("id"), x.get("text")
        out.append((i, name if isinstance(name, str) else None, body if isinstance(body, str) else None, flag(x, "restore_punctuation", True), flag(x, "include_embedding", False)))
    return out


def batch(spark: SparkSession, path: str) -> DataFrame:
    """item, id, text, restore_punctuation, include_embedding of a file with a JSON array of requests, in order.

    InputError names the first item without a text id or text; so a bad item refuses the whole batch.
    """
    kind = "array<struct<item:int,id:string,text:string,restore_punctuation:boolean,include_embedding:boolean>>"
    rows = spark.read.text(path, wholetext=True).select(text_kernel(_batch, kind)(F.col("value")).alias("b"))
    if not rows.where("b is null").isEmpty():
        raise InputError("a batch must be a JSON array")
    items = rows.select(F.explode("b").alias("b")).select("b.*")
    bad = items.where("id is null or text is null").orderBy("item").select("item", F.col("id").isNull().alias("no_id")).first()
    if bad is not None:
        raise InputError(f"item {bad['item']}: missing or non-string {'id' if bad['no_id'] else 'text'}")
    return items


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """session (the file's path), line_index (from 0), line; a file is read whole, as the order of its lines counts."""
    files = whole_files(spark, path)
    return files.select(F.col("doc_id").alias("session"), F.posexplode(lines(F.col("text"))).alias("line_index", "line"))


def write_texts(results: DataFrame, path: str, column: str = "compressed") -> None:
    results.select(column).write.text(path, lineSep="\n")


def write_contract(results: DataFrame, path: str, key: str = "doc_id") -> None:
    from corpusloom.plans.router import contract_json

    contract_json(results, key).select("json").write.text(path)


def write_batch(results: DataFrame, path: str, key: str = "id") -> None:
    """The contract of each result with its id in front, an object a line."""
    from corpusloom.plans.router import contract_json

    name = F.expr("substr(n, 1, length(n) - 1)")  # without the brace at its end
    rows = contract_json(results, key).withColumn("n", F.to_json(F.struct(F.col(key).cast("string").alias("id")), {"ignoreNullFields": "false"}))
    rows.select(F.concat(name, F.lit(","), F.expr("substr(json, 2)")).alias("json")).write.text(path)


def write_transcript(pruned: DataFrame, path: str, session: str = "session") -> None:
    """A copy, a folder for each session, its lines in order."""
    pruned.repartition(session).sortWithinPartitions(session, "line_index").select("line", session).write.partitionBy(session).text(path)
