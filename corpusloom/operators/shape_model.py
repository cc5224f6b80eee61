"""A pluggable shape model: byte features, label post-processing, and a heuristic scorer.

No trained weights come with this library. Features and post-processing are those that a byte-level
file-type model needs; the scorer that stands in for it looks for the cues of common formats.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.kernels import text_kernel

BEGIN, END, BLOCK, PADDING, LEAST = 1024, 1024, 4096, 256, 8
_SPACE = b" \t\n\r\x0b\x0c"

# Labels whose thresholds differ from 0.5, and labels that are replaced.
THRESHOLDS = {
    "markdown": 0.75,
    "crt": 0.9, "handlebars": 0.9, "ocaml": 0.9, "r": 0.9, "rst": 0.9, "sql": 0.9, "tsv": 0.9, "zig": 0.9,
    "ignorefile": 0.95, "latex": 0.95, "pascal": 0.95,
}
OVERWRITES = {"randombytes": "unknown", "randomtxt": "txt"}

#: Cues of the heuristic scorer, the first that fits: label, pattern, score.
CUES = [
    ("html", r"(?is)\A\s*(<!doctype html|<html|<head|<body)", 0.99),
    ("xml", r"(?s)\A\s*<\?xml", 0.99),
    ("svg", r"(?is)\A\s*<svg\b", 0.99),
    ("shell", r"\A#!\s*/\S*\b(ba|z|k|da)?sh\b", 0.99),
    ("python", r"\A#!\s*/\S*\bpython|(?m)^(def \w+\(.*\).*:|class \w+.*:|from \w[\w.]* import |import \w+\s*$)", 0.95),
    ("rust", r"(?m)^\s*(pub )?(fn \w+(<[^>]*>)?\(|impl\b.*\{|struct \w+|enum \w+ \{|use \w+(::\w+)+)", 0.95),
    ("go", r"(?m)^(package \w+\s*$|func (\(\w+ \*?\w+\) )?\w+\()", 0.95),
    ("java", r"(?m)^\s*(public|private|protected) (static |final |abstract )*(class|interface|enum|void|\w+) \w+", 0.95),
    ("c", r"(?m)^#include [<\"]", 0.95),
    ("javascript", r"(?m)^\s*((export )?(default )?(async )?function\b|const \w+ = |let \w+ = |import .* from ['\"])", 0.95),
    ("sql", r"(?im)^\s*(select\b.+\bfrom\b|insert into\b|create (table|view|index)\b|update \w+ set\b)", 0.95),
    ("css", r"(?m)^[.#]?[\w-]+(\s*[,>]\s*[.#]?[\w-]+)*\s*\{\s*$", 0.9),
    ("ini", r"(?m)\A\s*\[[\w .-]+\]\s*$", 0.9),
    ("yaml", r"(?m)\A(---\s*$|[\w-]+:( .*)?$\n([\w-]+:|  ))", 0.9),
    ("markdown", r"(?m)^(#{1,6} \S.*|```\w*)$", 0.9),
    ("tsv", r"\A[^\t\n]+\t[^\n]*\n[^\t\n]+\t", 0.92),
]


def low_confidence_label(label: str, binary: set[str] = frozenset()) -> str:
    """What a label falls back to below its threshold: txt for textual formats, unknown for binary ones."""
    return "unknown" if label in binary else "txt"


def label_table(spark, labels: list[str], binary: set[str] = frozenset()) -> DataFrame:
    """idx, label, threshold, low_confidence_label, overwrite_label for the vocabulary of a model."""
    rows = [(i, x, THRESHOLDS.get(x, 0.5), low_confidence_label(x, binary), OVERWRITES.get(x)) for i, x in enumerate(labels)]
    return spark.createDataFrame(rows, "idx int, label string, threshold double, low_confidence_label string, overwrite_label string")


def final_label(scored: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with an array `scores` get `label`: the greatest score (of equals the last) after thresholds and replacements."""
    best = F.array_max(F.transform("scores", lambda s, i: F.struct(s.alias("s"), i.alias("i"))))
    rows = scored.withColumn("__best", best).withColumn("__idx", F.col("__best")["i"])
    joined = rows.join(F.broadcast(table), F.col("__idx") == F.col("idx"), "left")
    label = F.when(F.col("__best")["s"] < F.col("threshold"), F.col("low_confidence_label")).otherwise(F.coalesce("overwrite_label", "label"))
    return joined.select(*[scored[c] for c in scored.columns], label.alias("final_label"))


def heuristic_label(text: Column) -> Column:
    """A label from the cues after the same thresholds, `txt` without one; null for texts of fewer than 8 bytes without edges."""
    label = F.lit("txt")
    for name, pattern, score in reversed(CUES):
        shown = OVERWRITES.get(name, name) if score >= THRESHOLDS.get(name, 0.5) else low_confidence_label(name)
        label = F.when(text.rlike(pattern), shown).otherwise(label)
    bare = F.regexp_replace(text, r"\A[ \t\n\r\x0B\f]+", "")
    return F.when(F.octet_length(bare) >= LEAST, label)


def byte_features(text: str) -> list[int] | None:
    """The first 1024 bytes (left-aligned) and the last 1024 (right-aligned) without outer white space, padded with 256."""
    raw = text.encode()
    out = np.full(BEGIN + END, PADDING)
    begin = raw[:BLOCK].lstrip(_SPACE)[:BEGIN]
    end = raw[-BLOCK:].rstrip(_SPACE)[-END:]
    out[: len(begin)] = list(begin)
    if end:
        out[-len(end) :] = list(end)
    return None if not raw or out[LEAST - 1] == PADDING else out.tolist()


def features(docs: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
    return docs.withColumn(out, text_kernel(byte_features, "array<int>")(F.col(text)))
