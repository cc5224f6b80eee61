"""A catalog of the operators, and row counts of stages as they run."""

from __future__ import annotations

import importlib
import inspect
import pkgutil

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MODULES = ["corpusloom.operators", "corpusloom.plans", "corpusloom.sources", "corpusloom.streaming", "corpusloom.functions"]


def catalog(spark: SparkSession) -> DataFrame:
    """module, name, signature, summary of the public functions."""
    rows = []
    for package in MODULES:
        folder = importlib.import_module(package)
        for info in pkgutil.iter_modules(folder.__path__):
            module = importlib.import_module(f"{package}.{info.name}")
            for name, f in inspect.getmembers(module, inspect.isfunction):
                if f.__module__ == module.__name__ and not name.startswith("_"):
                    rows.append((module.__name__, name, str(inspect.signature(f)), (inspect.getdoc(f) or "").split("\n")[0]))
    return spark.createDataFrame(rows, "module string, name string, signature string, summary string")


def observed(rows: DataFrame, name: str, text: str | None = None) -> tuple[DataFrame, Observation]:
    """`rows`, and an observation that holds the rows (and bytes of `text`) that passed once an action has run."""
    seen = Observation(name)
    measures = [F.count(F.lit(1)).alias("rows")] + ([F.sum(F.octet_length(text).cast("long")).alias("bytes")] if text else [])
    return rows.observe(seen, *measures), seen
