"""Deterministic inputs of every shape, derived from the driver's tables; and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, core_bytes: int = 32 << 20) -> DataFrame:
    """The rows dealt over all cores where the input is small: a file's splits may then hold no row group; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size >= core_bytes * cores else df.repartition(cores)


def joined(df: DataFrame, key: str, order: list[str], piece: Column, sep: str, begin: str = "", end: str = "") -> DataFrame:
    """doc_id, text: the pieces of each key in order."""
    rows = df.select(F.col(key).alias("doc_id"), F.struct(*order, piece.alias("piece")).alias("s"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["piece"]), sep)
    return rows.groupBy("doc_id").agg(F.concat(F.lit(begin), text, F.lit(end)).alias("text"))


def _cents() -> Column:
    return F.round(F.col("value") * 100).cast("long")


def _text(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def documents(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def log_docs(spark, sf_dir) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO")
    piece = F.concat(level, F.lit(": event "), _text("event_id"), F.lit(" "), "event_type", F.lit(" value="), _text(_cents()))
    return joined(table(spark, sf_dir, "events"), "user_id", ["event_id"], piece, "\n")


def _json_piece(nested: bool, uniform: bool = False) -> Column:
    note = F.when(F.col("event_id") % 17 == 0, ',"note":"checked"').otherwise("")
    status = F.when(F.col("event_id") % 13 == 0, "denied").otherwise("ok")
    tags = F.concat(F.lit(',"tags":['), _text(F.col("event_id") % 3), F.lit("]")) if nested else F.lit("")
    return F.concat(
        F.lit('{"cents":'), _text(_cents()), F.lit(',"event_id":'), _text("event_id"), F.lit("") if uniform else note,
        F.lit(',"status":"'), status, F.lit('"'), tags, F.lit(',"type":"'), "event_type", F.lit('"}'),
    )


def json_docs(spark, sf_dir) -> DataFrame:
    return spread(joined(table(spark, sf_dir, "events"), "user_id", ["event_id"], _json_piece(False), ",", "[", "]"))


def json_docs_nested(spark, sf_dir) -> DataFrame:
    return spread(joined(table(spark, sf_dir, "events"), "user_id", ["event_id"], _json_piece(True), ",", "[", "]"))


def json_docs_uniform(spark, sf_dir) -> DataFrame:
    return spread(joined(table(spark, sf_dir, "events"), "user_id", ["event_id"], _json_piece(False, True), ",", "[", "]"))


def json_docs_repeated(spark, sf_dir) -> DataFrame:
    piece = F.concat(F.lit('{"kind":"'), "event_type", F.lit('","third":'), _text(F.col("event_id") % 3), F.lit("}"))
    return spread(joined(table(spark, sf_dir, "events"), "user_id", ["event_id"], piece, ",", "[", "]"))


def document_lines(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def search_lines(spark, sf_dir) -> DataFrame:
    """folder, line_no, doc_id, line: the lines of `search_docs`, before they are joined."""
    piece = F.concat(F.lit("docs/"), _text("doc_id"), F.lit(".txt:"), _text(F.col("line_no") + 1), F.lit(":"), "line")
    return document_lines(spark, sf_dir).select((F.col("doc_id") % 20).alias("folder"), "line_no", "doc_id", piece.alias("line"))


def search_docs(spark, sf_dir) -> DataFrame:
    return joined(search_lines(spark, sf_dir), "folder", ["line_no", "doc_id"], F.col("line"), "\n")


def numbered_docs(spark, sf_dir) -> DataFrame:
    n = F.col("line_no") + 1 + F.when((F.col("doc_id") % 3 == 0) & (F.col("line_no") >= 2), 1).otherwise(0)
    return joined(document_lines(spark, sf_dir), "doc_id", ["line_no"], F.concat(_text(n), F.lit("\t"), "line"), "\n")


def blob_docs(spark, sf_dir) -> DataFrame:
    uri = F.when(F.col("doc_id") % 5 == 0, "data:image/png;base64," + "QUJD" * 6 + "==").otherwise("")
    text = F.concat("text", F.lit(" "), F.repeat(F.lit("QUJD"), (100 + F.col("doc_id") % 100).cast("int")), F.lit("= "), uri, F.lit(" end"))
    return documents(spark, sf_dir).select("doc_id", text.alias("text"))


def run_docs(spark, sf_dir) -> DataFrame:
    rows = document_lines(spark, sf_dir).withColumn("again", F.explode(F.sequence(F.lit(1), F.col("line_no") % 9 + 1)))
    return joined(rows, "doc_id", ["line_no", "again"], F.col("line"), "\n")


def _parts(spark, sf_dir) -> DataFrame:
    """d, f, p_partkey, h: a hunk for each part."""
    k = F.col("p_partkey")
    head = F.concat(F.lit("@@ -"), _text(k), F.lit(",4 +"), _text(k), F.lit(",4 @@\n ctx a\n ctx b\n-"))
    hunk = F.concat(head, "p_name", F.lit("\n+"), "p_type", F.when(k % 7 == 0, " fixme").otherwise(""), F.lit("\n ctx c"))
    return table(spark, sf_dir, "part").select((k % 4).alias("d"), (F.col("p_size") % 30).alias("f"), "p_partkey", hunk.alias("h"))


def _file_head() -> Column:
    f = _text("f")
    return F.concat(F.lit("diff --git a/f"), f, F.lit(" b/f"), f, F.lit("\n--- a/f"), f, F.lit("\n+++ b/f"), f)


def diff_docs(spark, sf_dir) -> DataFrame:
    one = _parts(spark, sf_dir).groupBy("d", "f").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "h"))), lambda s: s["h"]), "\n").alias("h"))
    return joined(one, "d", ["f"], F.concat(_file_head(), F.lit("\n"), "h"), "\n")


def diff_lines(spark, sf_dir) -> DataFrame:
    """d, f, hunk_no (0: the file's head), line_no, line: the lines of `diff_docs`; null lines are in no text."""
    from pyspark.sql.window import Window

    rows = _parts(spark, sf_dir)
    number = F.row_number().over(Window.partitionBy("d", "f").orderBy("p_partkey", "h"))
    hunks = rows.where(F.col("h").isNotNull()).select("d", "f", number.alias("hunk_no"), F.when(F.col("f").isNotNull(), F.col("h")).alias("h"))
    heads = rows.groupBy("d", "f").agg(F.count("h").alias("n")).select("d", "f", F.lit(0).alias("hunk_no"), F.concat(_file_head(), F.when(F.col("n") == 0, "\n").otherwise("")).alias("h"))
    return hunks.unionByName(heads).select("d", "f", "hunk_no", F.posexplode_outer(F.split("h", "\n", -1)).alias("line_no", "line"))


def transcripts(spark, sf_dir) -> DataFrame:
    """session, line_index, line."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv, turn = _text("conv_id"), _text("turn")
    said = F.to_json(F.struct(
        F.col("role").alias("type"), F.concat(F.lit("s"), conv).alias("sessionId"), F.concat(F.lit("/repo/"), _text(F.col("conv_id") % 3)).alias("cwd"), F.concat(F.lit("t"), turn).alias("timestamp"),
        F.struct(F.col("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content")).alias("message"),
    ))
    use_id = F.concat(F.lit("toolu_"), conv, F.lit("_"), turn)
    name = F.when(F.col("turn") % 4 == 1, "Write").when(F.col("turn") % 4 == 3, "Bash").otherwise("Read")
    path = F.when(F.col("turn") % 4 != 3, F.concat(F.lit("/f"), _text((F.col("conv_id") + F.floor(F.col("turn") / 2)) % 2), F.lit(".txt")))
    use = F.struct(F.lit("tool_use").alias("type"), use_id.alias("id"), name.alias("name"), F.struct(path.alias("file_path")).alias("input"))
    used = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.lit("assistant").alias("role"), F.array(use).alias("content")).alias("message")))
    failed = (F.col("turn") % 2 == 0) & (F.col("turn") >= 2)
    content = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("Command running in background with ID: "), turn)).when(failed, "same error").otherwise(F.repeat(F.lit("x"), (F.col("turn") * 400).cast("int")))
    result = F.struct(F.lit("tool_result").alias("type"), use_id.alias("tool_use_id"), content.alias("content"), F.when(failed, True).alias("is_error"))
    got = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(F.lit("user").alias("role"), F.array(result).alias("content")).alias("message")))
    each = F.explode(F.array(*[F.struct((F.col("turn") * 4 + i).alias("k"), line.alias("line")) for i, line in enumerate((said, used, got))])).alias("r")
    rows = c.select("conv_id", each).select("conv_id", "r.*").unionByName(c.select("conv_id").distinct().select("conv_id", F.lit(1 << 40).alias("k"), F.lit("not json").alias("line")))
    from pyspark.sql.window import Window

    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("k", "line")) - 1
    return rows.select(F.col("conv_id").alias("session"), number.alias("line_index"), "line")


def savings_transcripts(spark, sf_dir) -> DataFrame:
    """Transcripts of results under the output contract, some without a key or with a negative count."""
    e = table(spark, sf_dir, "events")
    after = F.when(F.col("event_id") % 11 == 0, -1).otherwise(F.floor(_cents() / 2))
    contract = F.to_json(F.struct(
        F.lit("x").alias("compressed"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 7 != 0, "json").alias("source"), _cents().alias("chars_before"), after.alias("chars_after"),
    ))
    block = F.struct(F.lit("tool_result").alias("type"), _text("event_id").alias("tool_use_id"), contract.alias("content"))
    line = F.to_json(F.struct(F.struct(F.array(block).alias("content")).alias("message")))
    return e.select((F.col("user_id") % 10).alias("session"), F.col("event_id").alias("line_index"), line.alias("line"))


def every_view(spark, sf_dir, without: tuple[str, ...] = ()) -> DataFrame:
    """view, doc_id, text of all shapes, or of those that are not named."""
    named = {"log": log_docs, "json": json_docs, "search": search_docs, "numbered": numbered_docs, "run": run_docs, "diff": diff_docs, "document": documents}
    out = None
    for name, view in ((n, v) for n, v in named.items() if n not in without):
        rows = view(spark, sf_dir).select(F.lit(name).alias("view"), "doc_id", "text")
        out = rows if out is None else out.unionByName(rows)
    talk = table(spark, sf_dir, "conversations").select(F.lit("talk").alias("view"), (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return spread(out.unionByName(talk))


def long_view_lines(spark, sf_dir) -> DataFrame:
    """view, doc_id, a, b, c, line: the views whose texts grow with the tables, as lines in the order of a, b, c."""
    search = search_lines(spark, sf_dir).select(F.lit("search").alias("view"), F.col("folder").alias("doc_id"), F.col("line_no").cast("long").alias("a"), F.col("doc_id").alias("b"), F.lit(0).alias("c"), "line")
    return search.unionByName(diff_lines(spark, sf_dir).select(F.lit("diff").alias("view"), F.col("d").alias("doc_id"), F.col("f").cast("long").alias("a"), F.col("hunk_no").cast("long").alias("b"), F.col("line_no").alias("c"), "line"))


def view_lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(lines(F.col("text"))).alias("line_no", "line"))


_CENTS = "CAST(round(value * 100) AS BIGINT)"
_JSON = """'{"cents":' || CENTS || ',"event_id":' || event_id || NOTE || ',"status":"' || CASE WHEN event_id % 13 = 0 THEN 'denied' ELSE 'ok' END || '"' || TAGS || ',"type":"' || event_type || '"}'"""
_NOTE = """CASE WHEN event_id % 17 = 0 THEN ',"note":"checked"' ELSE '' END"""
_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents"


def _array(piece: str) -> str:
    return f"SELECT user_id AS doc_id, '[' || string_agg({piece}, ',' ORDER BY event_id) || ']' AS text FROM events GROUP BY user_id"


def _json(note: str, tags: str) -> str:
    return _array(_JSON.replace("CENTS", _CENTS).replace("NOTE", note).replace("TAGS", tags))


#: The views as SQL, for the oracle.
SQL = {
    "log_docs": f"""SELECT user_id AS doc_id, string_agg(CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END || ': event ' || event_id || ' ' || event_type || ' value=' || {_CENTS}, chr(10) ORDER BY event_id) AS text FROM events GROUP BY user_id""",
    "json_docs": _json(_NOTE, "''"),
    "json_docs_nested": _json(_NOTE, """',"tags":[' || (event_id % 3) || ']'"""),
    "json_docs_uniform": _json("''", "''"),
    "json_docs_repeated": _array("""'{"kind":"' || event_type || '","third":' || (event_id % 3) || '}'"""),
    "search_docs": f"""SELECT doc_id % 20 AS doc_id, string_agg('docs/' || doc_id || '.txt:' || (line_no + 1) || ':' || line, chr(10) ORDER BY line_no, doc_id) AS text FROM ({_LINES}) GROUP BY doc_id % 20""",
    "numbered_docs": f"""SELECT doc_id, string_agg((line_no + 1 + CASE WHEN doc_id % 3 = 0 AND line_no >= 2 THEN 1 ELSE 0 END) || chr(9) || line, chr(10) ORDER BY line_no) AS text FROM ({_LINES}) GROUP BY doc_id""",
    "blob_docs": """SELECT doc_id, text || ' ' || repeat('QUJD', CAST(100 + doc_id % 100 AS INT)) || '= ' || CASE WHEN doc_id % 5 = 0 THEN 'data:image/png;base64,' || repeat('QUJD', 6) || '==' ELSE '' END || ' end' AS text FROM documents""",
    "run_docs": f"""SELECT doc_id, string_agg(rtrim(repeat(line || chr(10), CAST(line_no % 9 + 1 AS INT)), chr(10)) || CASE WHEN line = '' THEN repeat(chr(10), CAST(line_no % 9 AS INT)) ELSE '' END, chr(10) ORDER BY line_no) AS text FROM ({_LINES}) GROUP BY doc_id""",
    "diff_docs": """SELECT d AS doc_id, string_agg('diff --git a/f' || f || ' b/f' || f || chr(10) || '--- a/f' || f || chr(10) || '+++ b/f' || f || chr(10) || h, chr(10) ORDER BY f) AS text FROM (
      SELECT p_partkey % 4 AS d, p_size % 30 AS f, string_agg('@@ -' || p_partkey || ',4 +' || p_partkey || ',4 @@' || chr(10) || ' ctx a' || chr(10) || ' ctx b' || chr(10) || '-' || p_name || chr(10) || '+' || p_type || CASE WHEN p_partkey % 7 = 0 THEN ' fixme' ELSE '' END || chr(10) || ' ctx c', chr(10) ORDER BY p_partkey) AS h
      FROM part GROUP BY 1, 2) GROUP BY d""",
    "talk": "SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations",
}


def sql_lines(view: str) -> str:
    """Lines (doc_id, line_no, line) of a view, as SQL."""
    body = "CASE WHEN text = '' THEN [] WHEN right(text, 1) = chr(10) THEN string_split(left(text, length(text) - 1), chr(10)) ELSE string_split(text, chr(10)) END"
    return f"SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS line_no FROM (SELECT doc_id, {body} AS a FROM {view})"
