"""Scalar functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from corpusloom.functions.strict_json import minified, parse
from corpusloom.operators.diffs import compress_diff
from corpusloom.operators.json_rows import compress_json_array
from corpusloom.operators.toon import DecodeError, decode, encode_if_smaller


def _texts(function, kind: str):
    from corpusloom.functions.kernels import text_kernel

    return text_kernel(function, kind)


def _toon_json(text: str) -> str | None:
    try:
        return minified(decode(text))
    except (DecodeError, RecursionError):
        return None


def register(spark: SparkSession, prefix: str = "loom_") -> list[str]:
    """Registers the kernels as SQL functions of one text; returns their names."""
    functions = {
        "is_json": _texts(lambda t: parse(t)[0], "boolean"),
        "compress_json": _texts(lambda t: (compress_json_array(t) or (None,))[0], "string"),
        "compress_diff": _texts(lambda t: compress_diff(t)[0], "string"),
        "toon": _texts(lambda t: (encode_if_smaller(t) or (None,))[0], "string"),
        "toon_json": _texts(_toon_json, "string"),
    }
    for name, function in functions.items():
        spark.udf.register(prefix + name, function)
    return [prefix + name for name in functions]
