"""Logs: lines ranked by importance, kept within budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import lines, positions, trim_space
from corpusloom.plans.levels import LogLimits

ERROR = r"(?iU)\b(error|fatal|critical|fail(ed)?)\b"
WARN = r"(?iU)\bwarn(ing)?\b"
SUMMARY = r"(?U)\A\s*(={3,}|-{3,}|\d+ (passed|failed|skipped)|TOTAL|Summary)"


def level_of(line: Column) -> Column:
    return F.when(line.rlike(ERROR), "Error").when(line.rlike(WARN), "Warn").when(trim_space(line) != "", "Info").otherwise("Unknown")


def is_summary(line: Column) -> Column:
    return line.rlike(SUMMARY)


def score_of(level: Column, summary: Column) -> Column:
    base = F.when(level == "Error", 100).when(level == "Warn", 50).when(level == "Info", 10).otherwise(1)
    return base + F.when(summary, 40).otherwise(0)


def classify_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a line: key, line_no (from 0), line, level, is_summary, score."""
    rows = docs.select(key, F.posexplode(lines(F.col(text))).alias("line_no", "line"))
    rows = rows.withColumn("level", level_of(F.col("line"))).withColumn("is_summary", is_summary(F.col("line")))
    return rows.withColumn("score", score_of(F.col("level"), F.col("is_summary")))


def compress_logs(docs: DataFrame, limits: LogLimits = LogLimits(), text: str = "text", out: str = "compressed") -> DataFrame:
    """Errors, warnings and summaries within their limits, with context, within a total; adds lines_before and lines_after.

    Of too many errors (or warnings) the first, the last and then summary-like ones before others stay.
    A text without any of them stays as it is. The marker counts all errors and warnings of the text.
    Works inside each row: arrays of lines, levels and scores; nothing is shuffled.
    """
    rows = docs.withColumn("__lines", lines(F.col(text)))
    marks = F.transform("__lines", lambda l: F.struct(level_of(l).alias("level"), is_summary(l).alias("summary")))
    rows = rows.withColumn("__marks", marks)
    scores = F.transform("__marks", lambda m: score_of(m["level"], m["summary"]))
    m, n = F.col("__marks"), F.size("__lines")
    of = lambda level: F.filter(positions(m), lambda i: F.get(m, i)["level"] == level)
    rows = rows.withColumn("__scores", scores).withColumn("__errors", of("Error")).withColumn("__warns", of("Warn"))
    rows = rows.withColumn("__sums", F.filter(positions(m), lambda i: F.get(m, i)["summary"]))

    def chosen(name: str, most: int) -> Column:
        c = F.col(name)
        ends = F.array_distinct(F.array(F.get(c, F.lit(0)), F.get(c, F.size(c) - 1)))
        rest = F.slice(c, 2, F.greatest(F.size(c) - 2, F.lit(0)))
        ranked = F.concat(F.filter(rest, lambda i: F.get(m, i)["summary"]), F.filter(rest, lambda i: ~F.get(m, i)["summary"]))
        return F.when(F.size(c) <= most, c).otherwise(F.concat(ends, F.slice(ranked, 1, max(most - 2, 0))))

    rows = rows.withColumn("__chosen", F.concat(chosen("__errors", limits.max_errors), chosen("__warns", limits.max_warnings), F.col("__sums")))
    around = lambda i: F.sequence(F.greatest(i - limits.context_lines, F.lit(0)), F.least(i + limits.context_lines, n - 1))
    rows = rows.withColumn("__near", F.array_sort(F.array_distinct(F.flatten(F.transform("__chosen", around)))))
    best = F.slice(F.array_sort(F.transform("__near", lambda i: F.struct((-F.get("__scores", i)).alias("s"), i.alias("i")))), 1, limits.max_total_lines)
    kept = F.when(F.size("__near") > limits.max_total_lines, F.array_sort(F.transform(best, lambda x: x["i"]))).otherwise(F.col("__near"))
    rows = rows.withColumn("__kept", kept)
    l, omitted = F.col("__lines"), n - F.size("__kept")
    marker = F.concat(F.lit("["), omitted.cast("string"), F.lit(" lines omitted: "), F.size("__errors").cast("string"), F.lit(" error, "), F.size("__warns").cast("string"), F.lit(" warn]"))
    shown = F.concat(F.transform("__kept", lambda i: F.get(l, i)), F.when(omitted > 0, F.array(marker)).otherwise(F.array().cast("array<string>")))
    nothing = F.size("__chosen") == 0
    rows = rows.withColumn(out, F.when(nothing | F.col(text).isNull(), F.col(text)).otherwise(F.array_join(shown, "\n")))
    rows = rows.withColumn("lines_before", n.cast("long")).withColumn("lines_after", F.when(nothing, n).otherwise(F.size("__kept")).cast("long"))
    return rows.drop("__lines", "__marks", "__scores", "__errors", "__warns", "__sums", "__chosen", "__near", "__kept")
