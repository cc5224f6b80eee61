"""Search output `path:line:text`: at most five matches a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import let, lines, positions

MATCH = r"(?U)^([^:]+):(\d+):"
MAX_MATCHES = 5


def compress_search(docs: DataFrame, text: str = "text", out: str = "compressed", most: int = MAX_MATCHES) -> DataFrame:
    """Files in order of appearance, each with its first five lines and a count of the others; lines of another shape come last.

    Adds lines_before and lines_after (markers included). Works inside each row by one sort of the lines by file.
    """

    def found(l):
        return let(F.transform(l, lambda x: F.regexp_extract(x, MATCH, 1)), lambda f: let(by_file(f), lambda s: shown(l, f, s)))

    def by_file(f):
        return F.array_sort(F.transform(F.filter(positions(f), lambda i: F.get(f, i) != ""), lambda i: F.struct(F.get(f, i).alias("f"), i.alias("i"))))

    def shown(l, f, s):
        begins = F.filter(positions(s), lambda j: (j == 0) | (F.get(s, j)["f"] != F.get(s, F.greatest(j - 1, F.lit(0)))["f"]))
        ends = lambda b: F.concat(F.slice(b, 2, F.greatest(F.size(b), F.lit(1))), F.array(F.size(s)))
        groups = let(begins, lambda b: F.array_sort(F.filter(F.zip_with(b, ends(b), lambda x, y: F.when(x.isNotNull(), group(l, s, x, y))), lambda g: g.isNotNull())))
        others = F.transform(F.filter(positions(l), lambda i: F.get(f, i) == ""), lambda i: F.get(l, i))
        return let(F.concat(F.flatten(F.transform(groups, lambda g: g["shown"])), others), lambda x: F.struct(F.array_join(x, "\n").alias("text"), F.size(l).cast("long").alias("before"), F.size(x).cast("long").alias("after")))

    def group(l, s, a, b):
        few = F.transform(F.slice(s, a + 1, F.least(b - a, F.lit(most))), lambda x: F.get(l, x["i"]))
        marker = F.concat(F.get(s, a)["f"], F.lit(": "), (b - a - most).cast("string"), F.lit(" more matches omitted"))
        return F.struct(F.get(s, a)["i"].alias("first"), F.concat(few, F.when(b - a > most, F.array(marker)).otherwise(F.array().cast("array<string>"))).alias("shown"))

    rows = docs.withColumn("__found", F.when(F.col(text).isNotNull(), let(lines(F.col(text)), found)))
    c = F.col("__found")
    none = F.size(F.lit(None).cast("array<string>")).cast("long")  # as the engine counts an array that is not there
    return rows.withColumn(out, c["text"]).withColumn("lines_before", F.coalesce(c["before"], none)).withColumn("lines_after", F.coalesce(c["after"], none)).drop("__found")
