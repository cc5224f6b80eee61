"""Checks of the environment as rows: name, status (pass, warn, fail, skipped), message."""

from __future__ import annotations

import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.kernels import text_kernel


def age_text(seconds: int) -> str:
    """Seconds, minutes, hours or days, whole."""
    for size, unit in ((86400, "d"), (3600, "h"), (60, "m")):
        if seconds >= size:
            return f"{seconds // size}{unit}"
    return f"{seconds}s"


def doctor(spark: SparkSession, sf_dir: str | None = None, quick: bool = False) -> DataFrame:
    """Versions of Spark, Python and Arrow, the workers' Python, and the input tables; `quick` skips what runs a job."""
    checks = [("spark", "pass" if int(spark.version.split(".")[0]) >= 4 else "fail", spark.version), ("python", "pass", sys.version.split()[0])]
    for name in ("pyarrow", "pandas", "numpy"):
        try:
            checks.append((name, "pass", importlib.import_module(name).__version__))
        except ImportError as e:
            checks.append((name, "fail", str(e)))
    zone = spark.conf.get("spark.sql.session.timeZone")
    checks.append(("time_zone", "pass" if zone == "UTC" else "warn", zone))
    if quick:
        checks += [("workers", "skipped", "quick"), ("tables", "skipped", "quick")]
    else:
        try:
            back = spark.range(1).select(text_kernel(lambda t: t[::-1], "string")(F.lit("ab")).alias("x")).first()["x"]
            checks.append(("workers", "pass" if back == "ba" else "fail", "a vectorised function ran"))
        except Exception as e:  # noqa: BLE001
            checks.append(("workers", "fail", str(e)[:200]))
        if sf_dir is None:
            checks.append(("tables", "skipped", "no folder given"))
        else:
            try:
                n = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(1).count()
                checks.append(("tables", "pass" if n else "warn", "documents can be read"))
            except Exception as e:  # noqa: BLE001
                checks.append(("tables", "fail", str(e)[:200]))
    return spark.createDataFrame(checks, "name string, status string, message string")


def exit_code(checks: DataFrame) -> int:
    return int(not checks.where("status = 'fail'").isEmpty())
