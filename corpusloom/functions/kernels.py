"""Per-text Python kernels as vectorised column functions."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_kernel(function, schema: str):
    """A column function of one text column; `function` takes a text and gives a tuple of the fields of `schema` (or one value).

    Null texts give null. Rows for which the caller passes null cost next to nothing, so a branch
    is selected by nulling the texts of the others.
    """
    kind = T._parse_datatype_string(schema) if hasattr(T, "_parse_datatype_string") else schema
    names = kind.names if isinstance(kind, T.StructType) else None

    def run(texts: pd.Series) -> pd.DataFrame:
        empty = (None,) * len(names)
        return pd.DataFrame([empty if t is None else function(t) for t in texts], columns=names, dtype=object)

    def run_one(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else function(t) for t in texts], dtype=object)

    return F.pandas_udf(run if names else run_one, returnType=kind)


def column_kernel(function, kind: str):
    """A column function of one text column; `function` takes a list of texts and gives as many values. Null texts give null."""

    def run(texts: pd.Series) -> pd.Series:
        there = texts.notna()
        out = pd.Series([None] * len(texts), dtype=object)
        out[there.to_numpy()] = pd.Series(function(texts[there].tolist()), index=np.flatnonzero(there), dtype=object)
        return out

    return F.pandas_udf(run, returnType=T._parse_datatype_string(kind))


def split_lines(text: str) -> list[str]:
    """Lines end at LF or CRLF; a trailing line end adds no line."""
    return [] if text == "" else re.split(r"\r?\n", re.sub(r"\r?\n\Z", "", text))


def settled(rows: DataFrame) -> DataFrame:
    """The same rows behind a generator of one row each.

    The optimizer substitutes expressions through projections, and in a long chain of them that
    refer to each other their text can grow exponentially; it does not look through a generator.
    """
    return rows.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))).alias("row")).select("row.*")
