"""The batch expressions on streams.

Compressors work inside their row, so a stream of texts goes through the same plan as a table. Counts
of kinds by event time tolerate late rows up to a watermark. Digests are incremental: each batch of new
transcript lines is digested from the line after the last one seen, which the state store keeps by session.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.detect import detect
from corpusloom.operators.sessions import REMINDER, line_turns
from corpusloom.plans.router import compress


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (path), text: each new file of a folder is one document."""
    return spark.readStream.format("text").option("wholetext", True).load(path).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def table_stream(spark: SparkSession, path: str, schema, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def compress_stream(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The router on a stream; append mode, no state."""
    return compress(docs, key, text, **options)


def kind_counts(docs: DataFrame, time: str, text: str = "text", window: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, end, kind, n, bytes of event-time windows (tumbling, or sliding with `slide`); later rows than `late` are dropped."""
    rows = detect(docs.withWatermark(time, late), text)
    frame = F.window(time, window, slide) if slide else F.window(time, window)
    counted = rows.groupBy(frame.alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).cast("long").alias("bytes"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "n", "bytes")


def session_bursts(events: DataFrame, key: str, time: str, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """key, start, end, n of runs of events without a pause longer than `gap`."""
    counted = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


_OUT = "session string, from_line long, next_line long, turn_count long, text string"
_STATE = "next_line long"


def incremental_digests(lines: DataFrame) -> DataFrame:
    """session, from_line, next_line, turn_count, text for each batch of new (session string, line_index long, line string).

    The state of a session is the next line to read; lines before it (sent again) are skipped. The texts
    are what a digest from that line on holds.
    """

    def run(key, frames, state):
        start = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("line_index")
        rows = rows[rows["line_index"] >= start].drop_duplicates("line_index")
        if not len(rows):
            return
        said = []
        for line in rows["line"]:
            for role, text in line_turns(line)[3]:
                cut = text.split(REMINDER, 1)[0].strip()
                if cut:
                    said.append(("USER: " if role == "user" else "ASSISTANT: ") + cut)
        after = int(rows["line_index"].max()) + 1
        state.update((after,))
        yield pd.DataFrame({"session": [key[0]], "from_line": [start], "next_line": [after], "turn_count": [len(said)], "text": ["\n\n".join(said)]})

    typed = lines.select(F.col("session").cast("string").alias("session"), F.col("line_index").cast("long").alias("line_index"), "line")
    return typed.groupBy("session").applyInPandasWithState(run, _OUT, _STATE, "append", "NoTimeout")


def write_batches(rows: DataFrame, path: str, checkpoint: str):
    """Appends each batch as Parquet, exactly once by the checkpoint; processes what is there and stops."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
