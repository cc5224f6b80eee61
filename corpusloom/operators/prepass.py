"""Rewrites before detection: numbered listings lose their numbers, base64 blobs become markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import BRAND, let, lines, matches, positions, replace_sized

MIN_NUMBERED = 5
DATA_URI = r"data:[a-zA-Z0-9/+.-]+;base64,[A-Za-z0-9+/\n]{20,}={0,2}"
STANDALONE = r"[A-Za-z0-9+/]{500,}={0,2}"


def strip_line_numbers(docs: DataFrame, text: str = "text", flag: str = "line_numbers_stripped") -> DataFrame:
    """Drops the prefix `N<tab>` of every line iff all lines have it with N = 1, 2, 3, ..., five lines at least.

    Otherwise the text stays as it is. CRLF becomes LF where numbers are dropped.
    """
    number = lambda l: F.regexp_extract(l, r"^([0-9]+)\t", 1).try_cast("decimal(20,0)")
    fits = lambda ls: F.zip_with(ls, F.transform(positions(ls), lambda i: i + 1), lambda l, i: F.coalesce(number(l) == i, F.lit(False)))
    numbered = F.col(text).isNotNull() & let(lines(F.col(text)), lambda ls: (F.size(ls) >= MIN_NUMBERED) & F.forall(fits(ls), lambda b: b))
    out = docs.withColumn(flag, F.coalesce(numbered, F.lit(False)))
    bare = F.array_join(F.transform(lines(F.col(text)), lambda l: F.regexp_replace(l, r"^[0-9]+\t", "")), "\n")
    bare = F.concat(bare, F.when(F.col(text).endswith("\n"), "\n").otherwise(""))
    return out.withColumn(text, F.when(F.col(flag), bare).otherwise(F.col(text)))


def blob_marker(size: Column) -> Column:
    return F.concat(F.lit(f"[... {BRAND}pruned: base64 blob removed, "), size.cast("string"), F.lit(" chars ...]"))


def strip_blobs(docs: DataFrame, text: str = "text", count: str = "base64_blobs_removed") -> DataFrame:
    """Data URIs first, then standalone runs of 500 or more base64 characters become markers with their size."""
    t = F.col(text)
    # a text without a sign of a blob is not split, and stays as it is
    uri, long = t.contains(";base64,"), t.rlike(STANDALONE)
    first = docs.withColumn(count, F.when(t.isNotNull(), F.when(uri, matches(t, DATA_URI)).otherwise(0))).withColumn(text, F.when(uri, replace_sized(t, DATA_URI, blob_marker)).otherwise(t))
    found = F.when(t.isNotNull(), F.col(count) + F.when(long, matches(t, STANDALONE)).otherwise(0))
    return first.withColumn(count, found).withColumn(text, F.when(long, replace_sized(t, STANDALONE, blob_marker)).otherwise(t))


def prepass(docs: DataFrame, text: str = "text") -> DataFrame:
    return strip_blobs(strip_line_numbers(docs, text), text)
