"""The router over texts that come as lines in rows: a long text need not be one value before it is short."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.functions.kernels import settled
from corpusloom.functions.text import matches, replace_sized
from corpusloom.operators.detect import DIFF_HEADER, HUNK_MARK, JSON_START, OLD_FILE, SEARCH_LINE
from corpusloom.operators.diffs import DIFF_FIELDS, compress_diff
from corpusloom.operators.prepass import DATA_URI, STANDALONE, blob_marker
from corpusloom.operators.search import MATCH, MAX_MATCHES
from corpusloom.operators.shape_model import heuristic_label
from corpusloom.plans.levels import SIZE_GATE, DiffLimits, level
from corpusloom.plans.router import compress

#: A data URI whose payload may go on in the next line.
OPEN_URI = r"data:[a-zA-Z0-9/+.-]+;base64,[A-Za-z0-9+/]*\z"


def compress_lines(rows: DataFrame, key: str = "doc_id", order: list[str] = ["line_no"], line: str = "line", docs: DataFrame | None = None, level_name: str = "default", model=heuristic_label) -> DataFrame:  # noqa: B006
    """What `compress` gives for the lines of each key, joined by LF in the order of `order`, equal ones by line; null lines are left out.

    Lines hold no LF; a text that ends with one has an empty last line. `order` and `line` together are unique in a
    text. Search output is compressed by lines and is one value only as a result; a diff is one value only in its
    kernel. Texts of other kinds, and those with a rewrite that reads more than a line, are joined and go to `compress`
    with `docs`, further texts (key, text). A row for each text is broadcast.
    """
    rows = rows.select(F.col(key).alias("__key"), *order, F.col(line).alias("__raw"))
    about = settled(_about(rows, order))
    there = rows.where(F.col("__raw").isNotNull())
    whole = _of(rows, about, "whole")
    pieces = F.array_sort(F.collect_list(F.when(F.col("__raw").isNotNull(), F.struct(*order, "__raw"))))
    texts = whole.groupBy("__key").agg(F.array_join(F.transform(pieces, lambda s: s["__raw"]), "\n").alias("text")).select(F.col("__key").alias(key), "text")
    routed = compress(texts if docs is None else texts.unionByName(docs.select(key, "text")), key, "text", level_name, model=model)
    search = _search(_of(there, about, "SearchResults"), order)
    diff = _diff(_of(there, about, "Diff"), order, level(level_name).diff)
    for part in (search, diff):
        part = part.withColumn("chars_after", F.octet_length("compressed").cast("long")).join(F.broadcast(about.select(F.col("__key").alias("__k"), "chars_before", "blobs")), F.col("__key").eqNullSafe(F.col("__k")))
        part = part.withColumn("base64_blobs_removed", F.when(F.col("blobs") > 0, F.col("blobs"))).withColumnRenamed("__key", key)
        routed = routed.unionByName(part.select(*[F.col(f.name) if f.name in part.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in routed.schema]))
    return routed


def _of(rows: DataFrame, about: DataFrame, way: str) -> DataFrame:
    """The lines of the texts that go that way."""
    return rows.join(F.broadcast(about.where(F.col("way") == way).select(F.col("__key").alias("__k"), "last")), F.col("__key").eqNullSafe(F.col("__k"))).drop("__k")


def _blobs(line: Column) -> tuple[Column, Column]:
    """The line with markers for blobs, and how many; a line without a sign of one is not searched."""
    first = F.when(line.contains(";base64,"), replace_sized(line, DATA_URI, blob_marker)).otherwise(line)
    uris = F.when(line.contains(";base64,"), matches(line, DATA_URI)).otherwise(0)
    long = F.octet_length(first) >= 500
    return F.when(long, replace_sized(first, STANDALONE, blob_marker)).otherwise(first), uris + F.when(long, matches(first, STANDALONE)).otherwise(0)


def _bare(line: Column) -> Column:
    return F.when(line.endswith("\r"), F.regexp_replace(line, r"\r\z", "")).otherwise(line)


def _about(rows: DataFrame, order: list[str]) -> DataFrame:
    """A row for each text: __key, way (SearchResults, Diff or whole), last (the place of its last line, null if that counts), chars_before, blobs."""
    raw = F.col("__raw")
    clean, blobs = _blobs(raw)
    rows = settled(rows.withColumn("__clean", clean).withColumn("__blobs", blobs))
    l = _bare(F.col("__clean"))
    flags = rows.select(
        "__key", raw.isNotNull().cast("long").alias("n"), F.octet_length(raw).cast("long").alias("size"), F.octet_length("__clean").cast("long").alias("clean"), F.col("__blobs").cast("long").alias("blobs"),
        (raw.contains(";base64,") & raw.rlike(OPEN_URI)).alias("open"), raw.rlike(r"^[0-9]+\t").cast("long").alias("numbered"), l.rlike(SEARCH_LINE).cast("long").alias("searches"),
        (l.startswith("diff --") & l.rlike(DIFF_HEADER)).alias("header"), (l.startswith("--- ") & l.rlike(OLD_FILE)).alias("old"), (l.startswith("@@ -") & l.rlike(HUNK_MARK)).alias("mark"),
        F.when(l.rlike(r"(?U)\S"), F.struct(*order, (~l.rlike(JSON_START)).alias("other"))).alias("first"),
        F.when(raw.isNotNull(), F.struct(F.struct(*order).alias("at"), (raw != "").alias("full"), raw.endswith("\r").alias("cr"))).alias("last"),
    )
    most, total = ("open", "header", "old", "mark", "last"), ("n", "size", "clean", "blobs", "numbered", "searches")
    t = flags.groupBy("__key").agg(*[F.max(c).alias(c) for c in most], *[F.sum(c).alias(c) for c in total], F.min("first").alias("first"))
    n, ends = F.col("n"), ~F.col("last")["full"]  # ends: the text ends with LF
    search = F.col("searches") * 2 >= n - ends.cast("long")
    diff = (F.col("header") | (F.col("old") & F.col("mark"))) & (F.col("clean") + n - 1 > SIZE_GATE)
    odd = (n < 2) | F.col("open") | (F.col("numbered") >= n - 1) | ~F.coalesce(F.col("first")["other"], F.lit(True)) | F.col("last")["cr"]
    way = F.when(odd, "whole").when(search, "SearchResults").when(diff, "Diff").otherwise("whole")
    return t.select("__key", way.alias("way"), F.when(ends, F.col("last")["at"]).alias("last"), (F.col("size") + n - 1).alias("chars_before"), "blobs")


def _search(rows: DataFrame, order: list[str]) -> DataFrame:
    """As `compress_search`: a file's lines meet by a window, and of all lines only those that are shown meet in their text."""
    rows = rows.where(F.col("last").isNull() | (F.col("last") != F.struct(*order))).select("__key", *order, _bare(_blobs(F.col("__raw"))[0]).alias("__line"))
    rows = settled(rows).withColumn("__file", F.regexp_extract("__line", MATCH, 1))
    by_file = Window.partitionBy("__key", "__file").orderBy(*order, "__line")
    all_of = by_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("__r", F.row_number().over(by_file)).withColumn("__n", F.count(F.lit(1)).over(all_of)).withColumn("__first", F.first(F.struct(*order)).over(all_of))
    file, r = F.col("__file"), F.col("__r")
    marker = F.concat(file, F.lit(": "), (F.col("__n") - MAX_MATCHES).cast("string"), F.lit(" more matches omitted"))
    other = file == ""
    shown = F.struct(other.alias("other"), F.when(~other, F.col("__first")).alias("first"), F.concat(file, F.lit(":")).alias("file"), r.alias("r"), F.when(~other & (r > MAX_MATCHES), marker).otherwise(F.col("__line")).alias("line"))
    before = F.when(other | (r <= MAX_MATCHES), 1).otherwise(F.col("__n") - MAX_MATCHES)  # the marker stands for the lines after it
    rows = rows.where(other | (r <= MAX_MATCHES + 1)).select("__key", shown.alias("shown"), before.cast("long").alias("before"))
    found = rows.groupBy("__key").agg(F.array_join(F.transform(F.sort_array(F.collect_list("shown")), lambda s: s["line"]), "\n").alias("compressed"), F.sum("before").alias("lines_before"), F.count(F.lit(1)).alias("lines_after"))
    return found.withColumn("kind", F.lit("SearchResults")).withColumn("source", F.lit("search"))


def _diff(rows: DataFrame, order: list[str], limits: DiffLimits) -> DataFrame:
    """As the router does: each text meets in the kernel of its key."""
    rows = rows.select("__key", *order, F.col("__raw"), _blobs(F.col("__raw"))[0].alias("__clean"))
    fields = T._parse_datatype_string(DIFF_FIELDS)
    schema, names = T.StructType([rows.schema["__key"], *fields]), fields.names

    def one(table: pa.Table) -> pa.Table:
        at = pc.sort_indices(table, [(c, "ascending") for c in [*order, "__raw"]], null_placement="at_start")
        lines = table["__clean"].cast(pa.large_string()).take(at).combine_chunks()
        key = table["__key"].slice(0, 1).combine_chunks()
        del table, at
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(lines)], lines), pa.scalar("\n", pa.large_string()))[0].as_py()
        del lines
        found = compress_diff(text, limits)
        return pa.table({"__key": key, **{name: pa.array([x]) for name, x in zip(names, found, strict=True)}})

    found = rows.groupBy("__key").applyInArrow(one, schema)
    none = F.size(F.lit(None).cast("array<string>")).cast("long")  # as the router counts the lines of texts that are no log
    return found.withColumn("lines_before", none).withColumn("lines_after", none).withColumn("kind", F.lit("Diff")).withColumn("source", F.lit("diff"))
