"""Runs of identical lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import BRAND, let, lines, positions

LONGEST_RUN = 5


def collapse_runs(docs: DataFrame, text: str = "text", out: str = "compressed") -> DataFrame:
    """Runs of more than five identical lines become the line and a marker; every line then ends with LF. A null text stays null.

    Gaps and islands inside each row's array of lines: nothing is shuffled.
    """

    def collapsed(l):
        begins = F.filter(positions(l), lambda i: (i == 0) | (F.get(l, i) != F.get(l, F.greatest(i - 1, F.lit(0)))))
        ends = lambda s: F.concat(F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), F.array(F.size(l)))
        return let(begins, lambda s: F.array_join(F.zip_with(s, ends(s), lambda a, b: F.when(a.isNotNull(), piece(l, a, b)).otherwise("")), ""))

    def piece(l, a, b):
        n = b - a
        marker = F.concat(F.get(l, a), F.lit(f"\n[... {BRAND}pruned: "), (n - 1).cast("string"), F.lit(" identical lines collapsed ...]\n"))
        return F.when(n > LONGEST_RUN, marker).otherwise(F.repeat(F.concat(F.get(l, a), F.lit("\n")), n))

    return docs.withColumn(out, F.when(F.col(text).isNotNull(), let(lines(F.col(text)), collapsed)))
