"""Digests of sessions: the extracted text through the router, under a header."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.sessions import digest_content, session_text
from corpusloom.plans.router import compress

META = ["session_id", "cwd", "first_ts", "last_ts", "turn_count", "truncated", "raw_bytes", "total_lines"]


def digests(transcripts: DataFrame, max_chars: int = 200_000, start_line: int = 0, level_name: str = "default", session: str = "session") -> DataFrame:
    """session, digest, kind, source, chars_before, chars_after, META, is_error for each session.

    chars_before is the size of the extracted text. A session without turns has a null digest; that is an
    error for a whole transcript and none when reading on from a line.
    """
    said = session_text(transcripts, max_chars, start_line, session)
    routed = compress(said.select(session, "text"), session, "text", level_name).select(F.col(session).alias("__s"), "compressed", "kind", "source", "chars_before", "chars_after")
    joined = said.join(routed, F.col(session).eqNullSafe(F.col("__s")))
    empty = F.col("turn_count") == 0
    digest = F.when(~empty, digest_content(F.col("compressed")))
    return joined.select(session, digest.alias("digest"), "kind", "source", "chars_before", "chars_after", *META, (empty & F.lit(start_line == 0)).alias("is_error"))
