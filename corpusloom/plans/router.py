"""The router: rewrites, detection, and the compressor of each kind, as one plan without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.kernels import settled
from corpusloom.functions.text import sentences
from corpusloom.operators.detect import detect
from corpusloom.operators.diffs import diff_kernel
from corpusloom.operators.json_rows import json_kernel
from corpusloom.operators.line_runs import collapse_runs
from corpusloom.operators.logs import compress_logs
from corpusloom.operators.prepass import prepass
from corpusloom.operators.prose import cascade_kernel
from corpusloom.operators.search import compress_search
from corpusloom.operators.shape_model import heuristic_label
from corpusloom.plans.levels import SIZE_GATE, level

CORE = ["compressed", "kind", "source", "chars_before", "chars_after"]
DETAIL = ["elements_before", "elements_after", "lines_before", "lines_after", "files_affected", "hunks_removed", "kept_count", "removed_count", "line_numbers_stripped", "base64_blobs_removed"]


def compress(docs: DataFrame, key: str = "doc_id", text: str = "text", level_name: str = "default", force_kind: str | None = None, never_grow: bool = False, model=heuristic_label) -> DataFrame:
    """key, CORE and DETAIL (null where they do not apply) for each row.

    Sizes are bytes, chars_before of the text as given. Nothing makes a result smaller than its input
    by itself; with never_grow a result that is not smaller gives way to the input (source `passthrough`).
    `force_kind` may be plain-text and skips detection. Null texts give null results; repeated keys are rows of
    their own. Every compressor works inside its row: texts of other kinds reach it as null.
    """
    limits = level(level_name)
    if force_kind not in (None, "plain-text"):
        raise ValueError("only plain-text can be forced")
    given = [F.col(text).alias("__text0")] if never_grow else []
    rows = docs.select(F.col(key).alias("__key"), *given, F.octet_length(text).cast("long").alias("__size0"), F.col(text).alias("text"))
    rows = settled(prepass(rows))
    rows = rows.withColumn("kind", F.when(F.col("text").isNotNull(), "PlainText")) if force_kind else detect(rows, "text", model).drop("kind_label")
    rows = settled(rows)
    kind = F.col("kind")
    plain, log, search = kind == "PlainText", kind == "Log", kind == "SearchResults"
    whole = (kind == "Json") | (kind == "Diff")  # a text is carried on where its kernel reads it, and elsewhere only what became of it
    rows = rows.withColumn("__line_text", F.when(plain | log | kind.startswith("Other"), F.col("text"))).withColumn("__search_text", F.when(search, F.col("text"))).withColumn("text", F.when(whole, F.col("text")))
    rows = _renamed(compress_search(rows, "__search_text", "__search"), "__search").drop("__search_text")
    rows = collapse_runs(rows, "__line_text", "__runs").drop("__line_text")
    large = F.octet_length("__runs") > SIZE_GATE
    rows = rows.withColumn("__log_text", F.when(log & large, F.col("__runs")))
    rows = settled(_renamed(compress_logs(rows, limits.log, "__log_text", "__log"), "__log").drop("__log_text"))
    rows = rows.withColumn("__large", large).withColumn("__short", F.when(log & large, F.col("__log")).when(search, F.col("__search")).otherwise(F.col("__runs"))).drop("__log", "__search", "__runs")
    t, large = F.col("text"), F.col("__large")
    rows = rows.withColumn("__json", json_kernel(limits.json)(F.when(kind == "Json", t)))
    rows = rows.withColumn("__diff", diff_kernel(limits.diff)(F.when((kind == "Diff") & (F.octet_length("text") > SIZE_GATE), t)))
    rows = rows.withColumn("__prose", cascade_kernel()(F.when(plain & large, sentences(F.col("__short")))))
    rows = settled(rows)
    json, diff, prose = F.col("__json"), F.col("__diff"), F.col("__prose")
    is_json, is_diff = json["source"].isNotNull(), diff["compressed"].isNotNull()
    source = (
        F.when(is_json, json["source"]).when(kind == "Json", "json-passthrough").when(search, "search")
        .when(is_diff, "diff").when(kind == "Diff", "passthrough").when(log & large, "dedup+log").when(plain & large, "cascade").when(kind.isNotNull(), "dedup")
    )
    compressed = (
        F.when(is_json, json["compressed"]).when(kind == "Json", t)
        .when(is_diff, diff["compressed"]).when(kind == "Diff", t).when(plain & large, prose["compressed"]).otherwise(F.col("__short"))
    )
    rows = rows.withColumn("source", source).withColumn("compressed", compressed)
    if never_grow:
        bigger = F.octet_length("compressed") >= F.col("__size0")
        rows = rows.withColumn("source", F.when(bigger, "passthrough").otherwise(F.col("source"))).withColumn("compressed", F.when(bigger, F.col("__text0")).otherwise(F.col("compressed")))
    blobs = F.col("base64_blobs_removed")
    return rows.select(
        F.col("__key").alias(key), "compressed", "kind", "source",
        F.col("__size0").alias("chars_before"), F.octet_length("compressed").cast("long").alias("chars_after"),
        json["elements_before"].alias("elements_before"), json["elements_after"].alias("elements_after"),
        F.when(search, F.col("__search_before")).otherwise(F.col("__log_before")).alias("lines_before"),
        F.when(search, F.col("__search_after")).otherwise(F.col("__log_after")).alias("lines_after"),
        diff["files_affected"].alias("files_affected"), diff["hunks_removed"].alias("hunks_removed"),
        prose["kept_count"].alias("kept_count"), prose["removed_count"].alias("removed_count"),
        F.when(F.col("line_numbers_stripped"), True).alias("line_numbers_stripped"), F.when(blobs > 0, blobs).cast("long").alias("base64_blobs_removed"),
    )


def _renamed(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumnRenamed("lines_before", f"{name}_before").withColumnRenamed("lines_after", f"{name}_after")


def contract_json(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, json: the output contract as one JSON object a row, details that apply flattened in."""
    fields = [c for c in [*CORE, *DETAIL] if c in results.columns]
    return results.select(key, F.to_json(F.struct(*fields)).alias("json"))
