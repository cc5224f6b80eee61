"""Session transcripts: tool activity as a relation, pruning rules as joins and windows, digests and savings.

A transcript is rows (session, line_index, line), one JSON record a line; lines that are no records or of
another shape are skipped. Inputs are never changed: pruning gives a copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.kernels import text_kernel
from corpusloom.functions.strict_json import minified, parse
from corpusloom.functions.text import BRAND, trim_space

MIN_BYTES, RECENT = 2000, 200
LAUNCHED = "running in background with ID:"
REMINDER = "<system-reminder>"
CUT = "\n\n...[truncated — session exceeded per-item cap]...\n\n"
RULES = ["dedupe_latest_read", "supersede_write_by_read", "drop_redundant_errors", "prune_old_large_outputs", "collapse_task_launches"]
CONTRACT = ["compressed", "kind", "source", "chars_before", "chars_after"]


def _get(value, *path):
    for name in path:
        value = value.get(name) if isinstance(value, dict) else None
    return value


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def line_items(line: str) -> list[tuple]:
    """(item_type, id, name, path, content, is_error) of the tool blocks of one record."""
    ok, record = parse(line)
    blocks = _get(record, "message", "content") if ok else None
    out = []
    for b in blocks if isinstance(blocks, list) else []:
        kind = _get(b, "type")
        if kind == "tool_use" and _text(_get(b, "id")) is not None and _text(_get(b, "name")) is not None:
            out.append(("tool_use", b["id"], b["name"], _text(_get(b, "input", "file_path")), None, None))
        elif kind == "tool_result" and _text(_get(b, "tool_use_id")) is not None:
            out.append(("tool_result", b["tool_use_id"], None, None, _text(_get(b, "content")) or "", _get(b, "is_error") is True))
    return out


_ITEMS = "array<struct<item_type:string,id:string,name:string,path:string,content:string,is_error:boolean>>"


def session_items(transcripts: DataFrame, session: str = "session") -> DataFrame:
    """session, line_index, item_no (from 0 in the session), item_type, id, name, path, content, is_error."""
    likely = F.when(F.contains("line", F.lit("tool_")) | F.contains("line", F.lit("\\u")), F.col("line"))  # JSON may escape any character
    rows = transcripts.select(session, "line_index", text_kernel(line_items, _ITEMS)(likely).alias("i"))
    rows = rows.select(session, "line_index", F.posexplode("i").alias("at", "i"))
    number = F.row_number().over(Window.partitionBy(session).orderBy("line_index", "at")) - 1
    return rows.withColumn("item_no", number).select(session, "line_index", "item_no", "i.*")


def _uses(items: DataFrame) -> DataFrame:
    return items.where("item_type = 'tool_use'")


def _results(items: DataFrame) -> DataFrame:
    return items.where("item_type = 'tool_result'")


def _last_by_id(rows: DataFrame, session: str) -> DataFrame:
    latest = Window.partitionBy(session, "id").orderBy(F.col("item_no").desc())
    return rows.withColumn("__r", F.row_number().over(latest)).where("__r = 1").drop("__r")


def _candidates(rows: DataFrame, session: str, rule: str, reason: Column) -> DataFrame:
    return rows.select(session, "line_index", F.col("id").alias("tool_use_id"), F.lit(rule).alias("rule"), reason.alias("reason"), F.octet_length("content").cast("long").alias("bytes"))


def _results_of(uses: DataFrame, items: DataFrame, session: str) -> DataFrame:
    """The last result of each use, with the use's name and path."""
    results = _last_by_id(_results(items), session).select(session, "id", "line_index", "content")
    return uses.select(session, "id", F.col("name"), F.col("path")).join(results, [session, "id"])


def dedupe_latest_read(items: DataFrame, session: str = "session") -> DataFrame:
    """Results of reads of a path that is read again later."""
    reads = _uses(items).where("name = 'Read' and path is not null")
    latest = Window.partitionBy(session, "path").orderBy(F.col("line_index").desc(), F.col("item_no").desc())
    older = reads.withColumn("__r", F.row_number().over(latest)).where("__r > 1")
    reason = F.concat(F.lit("older Read of "), "path", F.lit(" superseded by a later Read of the same path"))
    return _candidates(_results_of(older, items, session), session, RULES[0], reason)


def supersede_write_by_read(items: DataFrame, session: str = "session") -> DataFrame:
    """Results of writes and edits of a path that is read on a later line."""
    last = _uses(items).where("name = 'Read' and path is not null").groupBy(session, "path").agg(F.max("line_index").alias("__last"))
    writes = _uses(items).where("name in ('Write', 'Edit') and path is not null").join(last, [session, "path"]).where("__last > line_index")
    reason = F.concat("name", F.lit(" of "), "path", F.lit(" verified by a later Read"))
    return _candidates(_results_of(writes, items, session), session, RULES[1], reason)


def drop_redundant_errors(items: DataFrame, session: str = "session") -> DataFrame:
    """Errors of the same tool with the same content as an earlier one."""
    tools = _last_by_id(_uses(items), session).select(session, "id", F.col("name").alias("tool"))
    errors = _results(items).where("is_error").join(tools, [session, "id"], "left").withColumn("tool", F.coalesce("tool", F.lit("")))
    first = Window.partitionBy(session, "tool", "content").orderBy("line_index", "item_no")
    again = errors.withColumn("__r", F.row_number().over(first)).where("__r > 1")
    return _candidates(again, session, RULES[2], F.concat(F.lit("identical "), "tool", F.lit(" error already seen earlier in the session")))


def prune_old_large_outputs(items: DataFrame, min_bytes: int = MIN_BYTES, window: int = RECENT, session: str = "session") -> DataFrame:
    """Results over `min_bytes` that are not among the last `window` items."""
    counted = items.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(session)))
    large = counted.where((F.col("item_type") == "tool_result") & (F.octet_length("content") > min_bytes) & (F.col("item_no") + window < F.col("__n")))
    reason = F.concat(F.octet_length("content").cast("string"), F.lit(f" bytes, outside the last {window} items"))
    return _candidates(large, session, RULES[3], reason)


def collapse_task_launches(items: DataFrame, session: str = "session") -> DataFrame:
    """Launch notices of background tasks but the last."""
    launches = _results(items).where(F.contains("content", F.lit(LAUNCHED)))
    latest = Window.partitionBy(session).orderBy(F.col("line_index").desc(), F.col("item_no").desc())
    older = launches.withColumn("__r", F.row_number().over(latest)).where("__r > 1")
    return _candidates(older, session, RULES[4], F.lit("an earlier background-task-launch notice superseded by a later one"))


def prune_candidates(items: DataFrame, include_rule_2: bool = False, min_bytes: int = MIN_BYTES, window: int = RECENT, session: str = "session") -> DataFrame:
    """All candidates; one result may stand under several rules."""
    out = dedupe_latest_read(items, session)
    if include_rule_2:
        out = out.unionByName(supersede_write_by_read(items, session))
    out = out.unionByName(drop_redundant_errors(items, session)).unionByName(prune_old_large_outputs(items, min_bytes, window, session))
    return out.unionByName(collapse_task_launches(items, session))


def prune_report(candidates: DataFrame) -> DataFrame:
    """rule, n, bytes, and a total (rule null); a result under two rules counts twice."""
    return candidates.rollup("rule").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def prune_line(line: str, markers: dict[str, str]) -> str:
    """The line with the content of the pruned results replaced; as it is if there are none."""
    ok, record = parse(line)
    blocks = _get(record, "message", "content") if ok else None
    changed = False
    for b in blocks if isinstance(blocks, list) else []:
        if _get(b, "type") == "tool_result" and (marker := markers.get(_text(_get(b, "tool_use_id")) or "\0")) is not None:
            b["content"] = marker
            changed = True
    return minified(record) if changed else line


def apply_pruning(transcripts: DataFrame, candidates: DataFrame, items: DataFrame, session: str = "session") -> DataFrame:
    """session, line_index, line, changed: a copy with pruned contents replaced by markers; other lines as they are.

    Of several rules for a result the last in rule order names the marker.
    """
    order = F.array_position(F.array(*map(F.lit, RULES)), F.col("rule"))
    best = Window.partitionBy(session, "tool_use_id").orderBy(order.desc(), F.col("line_index").desc(), F.col("bytes").desc())
    named = candidates.withColumn("__r", F.row_number().over(best)).where("__r = 1")
    marker = F.concat(F.lit(f"[... {BRAND}session_prune: "), "rule", F.lit(" removed, "), F.col("bytes").cast("string"), F.lit(" bytes ...]"))
    named = named.select(session, F.col("tool_use_id").alias("id"), marker.alias("marker"))
    on_line = _results(items).select(session, "line_index", "id").distinct().join(named, [session, "id"])
    on_line = on_line.groupBy(session, "line_index").agg(F.map_from_entries(F.collect_list(F.struct("id", "marker"))).alias("markers"))
    joined = transcripts.select(session, "line_index", "line").join(on_line, [session, "line_index"], "left")
    kernel = _rewrite()
    fresh = kernel(F.when(F.col("markers").isNotNull(), F.struct("line", "markers")))
    return joined.select(session, "line_index", F.coalesce(fresh, "line").alias("line"), F.col("markers").isNotNull().alias("changed"))


def _rewrite():
    import pandas as pd

    def run(rows):
        out = []
        for line, markers in zip(rows["line"], rows["markers"], strict=True):
            out.append(None if line is None or markers is None else prune_line(line, dict(markers)))
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
    return F.pandas_udf(run, "string")


def line_turns(line: str) -> tuple:
    """session_id, cwd, timestamp and the labelled texts of one record."""
    ok, record = parse(line.strip())
    if not ok or not isinstance(record, dict):
        return None, None, None, []
    role, content, texts = record.get("type"), _get(record, "message", "content"), []
    if role in ("user", "assistant"):
        if isinstance(content, str):
            texts = [content]
        elif isinstance(content, list):
            texts = [b["text"] for b in content if _get(b, "type") == "text" and _text(_get(b, "text"))]
    return _text(record.get("sessionId")), _text(record.get("cwd")), _text(record.get("timestamp")), [(role, t) for t in texts]


_TURNS = "session_id string, cwd string, ts string, texts array<struct<role:string,text:string>>"


def session_text(transcripts: DataFrame, max_chars: int = 200_000, start_line: int = 0, session: str = "session") -> DataFrame:
    """session, text, session_id, cwd, first_ts, last_ts, turn_count, truncated, raw_bytes, total_lines.

    Said by user and assistant alone, without what follows a system reminder; lines before `start_line` count
    only in raw_bytes and total_lines. Texts over `max_chars` characters keep their head and tail. Reading
    on from total_lines gives what is new.
    """
    fresh = F.col("line_index") >= start_line
    rows = transcripts.select(session, "line_index", "line", text_kernel(line_turns, _TURNS)(F.when(fresh, F.col("line"))).alias("t"))
    rows = rows.select(session, "line_index", "line", "t.*")
    cut = lambda x: trim_space(F.substring_index(x["text"], REMINDER, 1))
    label = lambda x: F.when(x["role"] == "user", "USER: ").otherwise("ASSISTANT: ")
    said = F.transform(F.filter(F.coalesce("texts", F.array().cast("array<struct<role:string,text:string>>")), lambda x: cut(x) != ""), lambda x: F.concat(label(x), cut(x)))
    rows = rows.withColumn("said", said)
    of = lambda pick, c: pick(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("line_index")))
    whole = rows.groupBy(session).agg(
        of(F.max_by, "session_id").alias("session_id"), of(F.max_by, "cwd").alias("cwd"), of(F.min_by, "ts").alias("first_ts"), of(F.max_by, "ts").alias("last_ts"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("said") > 0, F.struct("line_index", "said")))), lambda x: x["said"])).alias("said"),
        F.sum(F.octet_length("line") + 1).cast("long").alias("raw_bytes"),
        (F.max("line_index") + 1).cast("long").alias("total_lines"),
    )
    whole = whole.withColumn("whole", F.array_join("said", "\n\n"))
    half, size = max_chars // 2, F.length("whole")
    head, tail = F.substring("whole", 1, half), F.when(F.lit(half) > 0, F.substr(F.col("whole"), size - half + 1)).otherwise("")
    text = F.when(size > max_chars, F.concat(head, F.lit(CUT), tail)).otherwise(F.col("whole"))
    return whole.select(session, text.alias("text"), "session_id", "cwd", "first_ts", "last_ts", F.size("said").cast("long").alias("turn_count"), (size > max_chars).alias("truncated"), "raw_bytes", "total_lines")


def digest_content(compressed: Column) -> Column:
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat(
        F.lit("SESSION DIGEST "), blank("session_id"), F.lit("\n\n---\ntype: session-digest\nsession_id: "), blank("session_id"), F.lit("\ncwd: "), blank("cwd"),
        F.lit("\nfirst_ts: "), blank("first_ts"), F.lit("\nlast_ts: "), blank("last_ts"), F.lit("\nturn_count: "), F.col("turn_count").cast("string"), F.lit("\n---\n\n"), compressed,
    )


def line_savings(content: str) -> tuple:
    ok, record = parse(content.strip())
    if not ok or not isinstance(record, dict) or not all(k in record for k in CONTRACT):
        return None, None, None
    kind, before, after = record["kind"], record["chars_before"], record["chars_after"]
    count = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 0
    return (kind, str(before), str(after)) if isinstance(kind, str) and count(before) and count(after) else (None, None, None)


def session_stats(items: DataFrame, session: str = "session") -> DataFrame:
    """session, kind (null: all kinds), calls, chars_before, chars_after, chars_saved, pct_saved of results under the output contract."""
    named = F.contains("content", F.lit("chars_before")) | F.contains("content", F.lit("\\u"))
    likely = F.when((F.col("item_type") == "tool_result") & named, F.col("content"))
    rows = items.select(session, text_kernel(line_savings, "kind string, chars_before string, chars_after string")(likely).alias("s")).select(session, "s.*")
    sums = rows.where("kind is not null").rollup(session, "kind").agg(
        F.grouping_id().alias("__g"), F.count(F.lit(1)).alias("calls"), F.sum(F.col("chars_before").cast("decimal(20,0)")).cast("long").alias("chars_before"), F.sum(F.col("chars_after").cast("decimal(20,0)")).cast("long").alias("chars_after")
    )
    saved = F.greatest(F.col("chars_before") - F.col("chars_after"), F.lit(0))
    pct = F.when(F.col("chars_before") == 0, 0.0).otherwise(F.round(saved / F.col("chars_before") * 100, 6))
    return sums.where("__g < 3").select(session, "kind", "calls", "chars_before", "chars_after", saved.cast("long").alias("chars_saved"), pct.alias("pct_saved"))
