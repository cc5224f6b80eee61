"""The shape of a text: JSON, search output, diff, log, or what a shape model says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.kernels import text_kernel
from corpusloom.functions.strict_json import parse
from corpusloom.functions.text import let, lines
from corpusloom.operators.shape_model import heuristic_label

SEARCH_LINE = r"(?U)^\S+:\d+:"
LOG_LINE = r"(?iU)\b(error|warn(ing)?|fatal|fail(ed)?)\b"
DIFF_HEADER = r"^diff --(git a/|combined |cc )"
OLD_FILE = r"(?s)^--- (a/.+|/dev/null)\z"
HUNK_MARK = r"(?U)^@@ -\d"
JSON_START = r"(?U)\A\s*[\[{]"


def is_json(text: Column) -> Column:
    """Whether the text, after leading white space, is one JSON array or object."""
    check = text_kernel(lambda t: parse(t.lstrip())[0], "boolean")
    return F.coalesce(check(F.when(text.rlike(JSON_START), F.regexp_replace(text, r"(?U)\A\s+", ""))), F.lit(False))


def detect(docs: DataFrame, text: str = "text", model=heuristic_label) -> DataFrame:
    """Adds kind (Json, SearchResults, Diff, Log, PlainText or Other("label")) and kind_label (the model's label or null).

    The first test that holds decides. Only texts that begin like JSON are parsed; `model` is a function
    of the text column that gives a label or null. A null text has no kind.
    """
    t = F.col(text)
    rows = docs.withColumn("__json", is_json(t))
    label = model(t)

    def by_lines(l):
        searches = F.size(F.filter(l, lambda x: x.rlike(SEARCH_LINE))) * 2 >= F.size(l)
        any_line = lambda pattern: F.exists(l, lambda x: x.rlike(pattern))
        return F.when((F.size(l) > 0) & searches, "SearchResults").when(any_line(DIFF_HEADER) | (any_line(OLD_FILE) & any_line(HUNK_MARK)), "Diff").when(any_line(LOG_LINE), "Log")

    kind = (
        F.when(t.isNull(), F.lit(None))
        .when(F.col("__json"), "Json")
        .when(F.col("__shape").isNotNull(), F.col("__shape"))
        .otherwise(let(label, lambda x: F.when(x.isNull() | (x == "txt"), "PlainText").otherwise(F.concat(F.lit('Other("'), x, F.lit('")')))))
    )
    rows = rows.withColumn("__shape", F.when(~F.col("__json"), let(lines(t), by_lines))).withColumn("kind", kind)
    return rows.withColumn("kind_label", F.when(F.col("kind").startswith("Other"), label)).drop("__json", "__shape")


def kind_histogram(docs: DataFrame, text: str = "text") -> DataFrame:
    return detect(docs, text).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).cast("long").alias("bytes"))
