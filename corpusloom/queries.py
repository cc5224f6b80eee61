"""The queries of the library, by name, and the same results as SQL for an independent check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import word_windows
from corpusloom.operators import json_rows as J
from corpusloom.operators import pixel, prose, semantic, sessions, shape_model, toon
from corpusloom.operators.detect import detect, kind_histogram
from corpusloom.operators.diffs import compress_diffs, diff_hunks
from corpusloom.operators.doctor import doctor
from corpusloom.operators.line_runs import collapse_runs
from corpusloom.operators.logs import classify_lines, compress_logs
from corpusloom.operators.prepass import strip_blobs, strip_line_numbers
from corpusloom.operators.search import compress_search
from corpusloom.plans.catalog import catalog
from corpusloom.plans.digest import digests
from corpusloom.plans.levels import LEVELS
from corpusloom.plans.line_router import compress_lines
from corpusloom.plans.router import compress
from corpusloom.sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, **views: str):
    """Registers a query by its function's name; `sql` may use the views of V.SQL that the keywords name."""

    def keep(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return keep


def with_views(sql: str, *names: str, **more: str) -> str:
    """`sql` after WITH clauses for the named views, and for more ones given as SQL."""
    parts = [f"{n} AS ({V.SQL[n]})" for n in names] + [f"{n} AS ({s})" for n, s in more.items()]
    return f"WITH {', '.join(parts)} {sql}"


_W = r"[^\p{L}\p{M}\p{N}_]"


def _word(words: str) -> str:
    """A whole-word pattern whose borders are Unicode's in an engine whose own are not."""
    return rf"(?i)(^|{_W})({words})($|{_W})"


_RUNS = """
SELECT doc_id, string_agg(CASE WHEN n > 5 THEN line || chr(10) || '[... pruned: ' || (n - 1) || ' identical lines collapsed ...]' || chr(10) ELSE repeat(line || chr(10), CAST(n AS INT)) END, '' ORDER BY p) AS compressed
FROM (SELECT doc_id, run, min(line_no) AS p, any_value(line) AS line, count(*) AS n
      FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no) AS run
            FROM (SELECT *, CASE WHEN line_no = 0 OR line <> lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) THEN 1 ELSE 0 END AS fresh FROM l))
      GROUP BY doc_id, run)
GROUP BY doc_id"""


@query(with_views("SELECT r.doc_id, coalesce(c.compressed, '') AS compressed, strlen(r.text) AS chars_before, strlen(coalesce(c.compressed, '')) AS chars_after FROM run_docs r LEFT JOIN c USING (doc_id)", "run_docs", l=V.sql_lines("run_docs"), c=_RUNS))
def line_run_dedup(spark, sf_dir):
    rows = collapse_runs(V.run_docs(spark, sf_dir))
    return rows.select("doc_id", "compressed", F.octet_length("text").cast("long").alias("chars_before"), F.octet_length("compressed").cast("long").alias("chars_after"))


@query(with_views("SELECT doc_id, coalesce(compressed, '') AS compressed FROM documents LEFT JOIN c USING (doc_id)", l=V.sql_lines("documents"), c=_RUNS))
def line_run_dedup_documents(spark, sf_dir):
    return collapse_runs(V.documents(spark, sf_dir)).select("doc_id", "compressed")


@query(with_views(
    """SELECT n.doc_id, coalesce(ok, false) AS line_numbers_stripped, CASE WHEN ok THEN bare || CASE WHEN right(text, 1) = chr(10) THEN chr(10) ELSE '' END ELSE text END AS text
    FROM numbered_docs n LEFT JOIN (
      SELECT doc_id, count(*) >= 5 AND bool_and(coalesce(TRY_CAST(regexp_extract(line, '^([0-9]+)\t', 1) AS BIGINT) = line_no + 1, false)) AS ok, string_agg(regexp_replace(line, '^[0-9]+\t', ''), chr(10) ORDER BY line_no) AS bare FROM l GROUP BY doc_id) USING (doc_id)""",
    "numbered_docs", l=V.sql_lines("numbered_docs")))
def line_number_strip(spark, sf_dir):
    return strip_line_numbers(V.numbered_docs(spark, sf_dir)).select("doc_id", "line_numbers_stripped", "text")


def _sql_blobs(source: str, pattern: str) -> str:
    return f"""SELECT doc_id, n + len(m) AS n, array_to_string(list_transform(p, lambda x, i: x || CASE WHEN i <= len(m) THEN '[... pruned: base64 blob removed, ' || strlen(m[i]) || ' chars ...]' ELSE '' END), '') AS text
    FROM (SELECT doc_id, n, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m FROM {source})"""


@query(with_views("SELECT doc_id, CAST(n AS BIGINT) AS base64_blobs_removed, text FROM b", "blob_docs", z="SELECT doc_id, 0 AS n, text FROM blob_docs", a=_sql_blobs("z", "data:[a-zA-Z0-9/+.-]+;base64,[A-Za-z0-9+/\n]{20,}={0,2}"), b=_sql_blobs("a", "[A-Za-z0-9+/]{500,}={0,2}")))
def base64_strip(spark, sf_dir):
    return strip_blobs(V.blob_docs(spark, sf_dir)).select("doc_id", F.col("base64_blobs_removed").cast("long").alias("base64_blobs_removed"), "text")


_EVERY = " UNION ALL ".join(f"SELECT '{name}' AS view, doc_id, text FROM {view}" for name, view in {"log": "log_docs", "json": "json_docs", "search": "search_docs", "numbered": "numbered_docs", "run": "run_docs", "diff": "diff_docs", "document": "documents", "talk": "talk"}.items())
_KINDS = f"""SELECT view, doc_id, strlen(text) AS bytes, CASE
  WHEN regexp_matches(text, '^\\s*[\\[{{]') AND json_valid(text) THEN 'Json'
  WHEN len(a) > 0 AND len(list_filter(a, lambda x: regexp_matches(x, '^\\S+:\\d+:'))) * 2 >= len(a) THEN 'SearchResults'
  WHEN len(list_filter(a, lambda x: regexp_matches(x, '^diff --(git a/|combined |cc )'))) > 0
    OR (len(list_filter(a, lambda x: regexp_matches(x, '^--- (a/.+|/dev/null)$'))) > 0 AND len(list_filter(a, lambda x: regexp_matches(x, '^@@ -\\d'))) > 0) THEN 'Diff'
  WHEN len(list_filter(a, lambda x: regexp_matches(x, '{_word("error|warn(ing)?|fatal|fail(ed)?")}'))) > 0 THEN 'Log'
  ELSE 'PlainText' END AS kind
  FROM (SELECT *, CASE WHEN text = '' THEN [] WHEN right(text, 1) = chr(10) THEN string_split(left(text, length(text) - 1), chr(10)) ELSE string_split(text, chr(10)) END AS a FROM every)"""
_ALL_VIEWS = ["log_docs", "json_docs", "search_docs", "numbered_docs", "run_docs", "diff_docs", "talk"]


def _no_model(text):
    return F.lit(None).cast("string")


@query(with_views("SELECT view, doc_id, kind FROM k", *_ALL_VIEWS, every=_EVERY, k=_KINDS))
def detect_kind(spark, sf_dir):
    return detect(V.every_view(spark, sf_dir), model=_no_model).select("view", "doc_id", "kind")


@query(with_views("SELECT kind, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM k GROUP BY kind", *_ALL_VIEWS, every=_EVERY, k=_KINDS))
def kind_counts(spark, sf_dir):
    rows = detect(V.every_view(spark, sf_dir), model=_no_model)
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@query()
def kind_counts_with_model(spark, sf_dir):
    pages = V.table(spark, sf_dir, "pages").select(F.col("html").alias("text"))
    return kind_histogram(pages.unionByName(V.documents(spark, sf_dir).select("text")))


_CLASSES = f"""SELECT *, CASE level WHEN 'Error' THEN 100 WHEN 'Warn' THEN 50 WHEN 'Info' THEN 10 ELSE 1 END + CASE WHEN is_summary THEN 40 ELSE 0 END AS score FROM (
  SELECT *, CASE WHEN regexp_matches(line, '{_word("error|fatal|critical|fail(ed)?")}') THEN 'Error' WHEN regexp_matches(line, '{_word("warn(ing)?")}') THEN 'Warn'
    WHEN regexp_matches(line, '\\S') THEN 'Info' ELSE 'Unknown' END AS level,
    regexp_matches(line, '^\\s*(={{3,}}|-{{3,}}|\\d+ (passed|failed|skipped)|TOTAL|Summary)') AS is_summary FROM l)"""


@query(with_views("SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, level, is_summary, CAST(score AS INTEGER) AS score FROM c", "log_docs", l=V.sql_lines("log_docs"), c=_CLASSES))
def log_classify(spark, sf_dir):
    return classify_lines(V.log_docs(spark, sf_dir)).select("doc_id", "line_no", "level", "is_summary", "score")


def _sql_log(errors: int, warnings: int, context: int, total: int, tail: str = "") -> dict[str, str]:
    """Clauses that end in out{tail}(doc_id, compressed, lines_before, lines_after) over c."""
    ranked = f"""SELECT *, count(*) OVER (PARTITION BY doc_id, level) AS n_level, row_number() OVER (PARTITION BY doc_id, level ORDER BY
        CASE WHEN line_no = first_no THEN 0 WHEN line_no = last_no THEN 1 ELSE 2 END, score DESC, line_no) AS r
      FROM (SELECT *, min(line_no) OVER (PARTITION BY doc_id, level) AS first_no, max(line_no) OVER (PARTITION BY doc_id, level) AS last_no FROM c)"""
    picked = f"SELECT *, is_summary OR (level = 'Error' AND (n_level <= {errors} OR r <= greatest(2, {errors}))) OR (level = 'Warn' AND (n_level <= {warnings} OR r <= greatest(least(2, n_level), {warnings}))) AS picked FROM ranked{tail}"
    near = f"SELECT *, max(CAST(picked AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN {context} PRECEDING AND {context} FOLLOWING) = 1 AS near, max(CAST(picked AS INT)) OVER (PARTITION BY doc_id) AS any_picked FROM picked{tail}"
    kept = f"SELECT *, near AND row_number() OVER (PARTITION BY doc_id, near ORDER BY score DESC, line_no) <= {total} AS kept FROM near{tail}"
    out = f"""SELECT doc_id, CASE WHEN max(any_picked) = 0 THEN NULL ELSE string_agg(line, chr(10) ORDER BY line_no) FILTER (kept) || CASE WHEN count(*) FILTER (NOT kept) > 0 THEN
        chr(10) || '[' || count(*) FILTER (NOT kept) || ' lines omitted: ' || count(*) FILTER (level = 'Error') || ' error, ' || count(*) FILTER (level = 'Warn') || ' warn]' ELSE '' END END AS compressed,
        count(*) AS lines_before, CASE WHEN max(any_picked) = 0 THEN count(*) ELSE count(*) FILTER (kept) END AS lines_after FROM kept{tail} GROUP BY doc_id"""
    return {f"{n}{tail}": s for n, s in (("ranked", ranked), ("picked", picked), ("near", near), ("kept", kept), ("outp", out))}


@query(with_views("SELECT d.doc_id, coalesce(compressed, text) AS compressed, lines_before, lines_after FROM log_docs d JOIN outp USING (doc_id)", "log_docs", l=V.sql_lines("log_docs"), c=_CLASSES, **_sql_log(10, 5, 2, 100)))
def log_compress(spark, sf_dir):
    return compress_logs(V.log_docs(spark, sf_dir)).select("doc_id", "compressed", "lines_before", "lines_after")


_LEVEL_PARTS: dict[str, str] = {}
for _name, _l in LEVELS.items():
    _LEVEL_PARTS |= _sql_log(_l.log.max_errors, _l.log.max_warnings, _l.log.context_lines, _l.log.max_total_lines, f"_{_name}")


@query(with_views(" UNION ALL ".join(f"SELECT '{n}' AS level, doc_id, lines_before, lines_after, strlen(compressed) AS chars_after FROM outp_{n}" for n in LEVELS), "log_docs", l=V.sql_lines("log_docs"), c=_CLASSES, **_LEVEL_PARTS))
def level_matrix(spark, sf_dir):
    docs, out = V.log_docs(spark, sf_dir), None
    for name, limits in LEVELS.items():
        rows = compress_logs(docs, limits.log).select(F.lit(name).alias("level"), "doc_id", "lines_before", "lines_after", F.octet_length("compressed").cast("long").alias("chars_after"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(with_views(
    """SELECT doc_id, string_agg(shown, chr(10) ORDER BY part, first_no, line_no) AS compressed, (SELECT count(*) FROM l WHERE l.doc_id = s.doc_id) AS lines_before, count(*) AS lines_after FROM (
      SELECT doc_id, 0 AS part, first_no, line_no, line AS shown FROM f WHERE file <> '' AND r <= 5
      UNION ALL SELECT doc_id, 0, first_no, 1000000000 + first_no, file || ': ' || (n - 5) || ' more matches omitted' FROM f WHERE file <> '' AND r = 1 AND n > 5
      UNION ALL SELECT doc_id, 1, 0, line_no, line FROM f WHERE file = '') s GROUP BY doc_id""",
    "search_docs", l=V.sql_lines("search_docs"),
    f="""SELECT *, row_number() OVER (PARTITION BY doc_id, file ORDER BY line_no) AS r, count(*) OVER (PARTITION BY doc_id, file) AS n, min(line_no) OVER (PARTITION BY doc_id, file) AS first_no
      FROM (SELECT *, regexp_extract(line, '^([^:]+):(\\d+):', 1) AS file FROM l)"""))  # fmt: skip
def search_compress(spark, sf_dir):
    return compress_search(V.search_docs(spark, sf_dir)).select("doc_id", "compressed", "lines_before", "lines_after")


_DIFF = {
    "f0": "SELECT *, sum(CASE WHEN regexp_matches(line, '^diff --(git a/.+ b/.+|combined .+|cc .+)$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS file_no FROM l",
    "f1": """SELECT *, CASE WHEN regexp_matches(line, '^diff --(git a/.+ b/.+|combined .+|cc .+)$') THEN 'file' WHEN regexp_matches(line, '^--- (a/.+|/dev/null)$') THEN 'old' WHEN regexp_matches(line, '^\\+\\+\\+ (b/.+|/dev/null)$') THEN 'new'
      WHEN regexp_matches(line, '^@@ -\\d+(,\\d+)? \\+\\d+(,\\d+)? @@') THEN 'hunk' ELSE 'line' END AS role FROM f0 WHERE file_no > 0""",
    "f2": "SELECT *, sum(CASE WHEN role = 'hunk' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, file_no ORDER BY line_no) AS hunk_no, role = 'line' AND regexp_matches(line, '^[+-]') AS changed FROM f1",
    "h": f"""SELECT doc_id, file_no, hunk_no, max(line) FILTER (role = 'hunk') AS hunk_header, count(*) FILTER (role = 'line') AS n_lines, count(*) FILTER (changed) AS changed,
      bool_or(role = 'line' AND (regexp_matches(lower(line), '{_word("error|exception|fail(ed|ure)?|fatal|critical|crash|panic")}') OR regexp_matches(lower(line), '{_word("important|note|todo|fixme|hack|xxx|bug|fix")}')
        OR regexp_matches(lower(line), '{_word("security|auth|password|secret|token")}'))) AS priority FROM f2 WHERE hunk_no > 0 GROUP BY ALL""",
    "hs": "SELECT *, round(least(1.0::DOUBLE, least(changed * 0.03::DOUBLE, 0.3::DOUBLE) + CASE WHEN priority THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END), 6) AS score FROM h",
}


@query(with_views("SELECT doc_id, CAST(file_no AS BIGINT) AS file_no, CAST(hunk_no AS BIGINT) AS hunk_no, file_header, hunk_header, n_lines, changed, priority, score FROM hs JOIN (SELECT doc_id, file_no, line AS file_header FROM f1 WHERE role = 'file') USING (doc_id, file_no)", "diff_docs", l=V.sql_lines("diff_docs"), **_DIFF))
def diff_hunk_scores(spark, sf_dir):
    return diff_hunks(V.diff_docs(spark, sf_dir))


@query(with_views(
    """SELECT doc_id, string_agg(line, chr(10) ORDER BY place, hunk_place, line_no) || chr(10) || '[' || any_value(n_files) || ' files changed' || CASE WHEN any_value(gone) > 0 THEN ', ' || any_value(gone) || ' hunks omitted' ELSE '' END || ']' AS compressed,
      any_value(n_files) AS files_affected, any_value(gone) AS hunks_removed FROM shown JOIN totals USING (doc_id) GROUP BY doc_id""",
    "diff_docs", l=V.sql_lines("diff_docs"), **_DIFF,
    files="""SELECT doc_id, file_no, row_number() OVER (PARTITION BY doc_id ORDER BY sum(changed) DESC, file_no) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM hs GROUP BY doc_id, file_no""",
    kept_files="SELECT doc_id, file_no, CASE WHEN n > 20 THEN r ELSE file_no END AS place, least(n, 20) AS n_files FROM files WHERE r <= 20",
    hr="""SELECT *, CASE WHEN hunk_no = 1 THEN 0 WHEN hunk_no = n THEN 2 ELSE 1 END AS part, row_number() OVER (PARTITION BY doc_id, file_no ORDER BY CASE WHEN hunk_no = 1 OR hunk_no = n THEN 0 ELSE 1 END, score DESC, hunk_no) AS r
      FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, file_no) AS n FROM hs JOIN kept_files USING (doc_id, file_no))""",
    kept_hunks="SELECT *, CASE WHEN n > 10 THEN CAST(regexp_extract(hunk_header, '\\+(\\d+)', 1) AS BIGINT) ELSE hunk_no END AS hunk_place FROM hr WHERE n <= 10 OR r <= 10",
    totals="SELECT doc_id, any_value(n_files) AS n_files, (SELECT count(*) FROM hr x WHERE x.doc_id = k.doc_id) - count(*) AS gone FROM kept_hunks k GROUP BY doc_id",
    near="SELECT *, max(CAST(changed AS INT)) OVER (PARTITION BY doc_id, file_no, hunk_no, role = 'line' ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS near FROM f2",
    shown="""SELECT doc_id, place, -1 AS hunk_place, line_no, line FROM near JOIN kept_files USING (doc_id, file_no) WHERE role IN ('file', 'old', 'new')
      UNION ALL SELECT doc_id, place, hunk_place, line_no, line FROM near JOIN kept_hunks USING (doc_id, file_no, hunk_no) WHERE role = 'hunk' OR (role = 'line' AND near)"""))  # fmt: skip
def diff_compress(spark, sf_dir):
    return compress_diffs(V.diff_docs(spark, sf_dir)).select("doc_id", "compressed", "files_affected", "hunks_removed")


_EVENTS = f"""SELECT user_id AS doc_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS item, count(*) OVER (PARTITION BY user_id) AS n, {V._CENTS} AS cents,
  CASE WHEN event_id % 17 = 0 THEN 'checked' END AS note, CASE WHEN event_id % 13 = 0 THEN 'denied' ELSE 'ok' END AS status, event_id % 3 AS third, event_type AS type FROM events"""
_FIELDS = " UNION ALL ".join(f"SELECT doc_id, item, n, '{name}' AS name, {value} AS value FROM e{where}" for name, value, where in (("cents", "CAST(cents AS VARCHAR)", ""), ("event_id", "CAST(event_id AS VARCHAR)", ""), ("note", "note", " WHERE note IS NOT NULL"), ("status", "status", ""), ("tags", "'[' || third || ']'", ""), ("type", "type", "")))
_RARE_FIELDS = "SELECT doc_id, name, count(*) AS present, any_value(n) AS n FROM f WHERE n >= 5 GROUP BY doc_id, name HAVING count(*) < any_value(n) * 0.2"
_RARE_VALUES = """SELECT doc_id, name, value, present FROM (
  SELECT *, sum(CAST(top AS INT)) OVER (PARTITION BY doc_id, name) AS n_top FROM (
    SELECT *, through - present < ceil(total * 0.8::DOUBLE) AS top FROM (
      SELECT *, sum(present) OVER (PARTITION BY doc_id, name) AS total, count(*) OVER (PARTITION BY doc_id, name) AS kinds,
        sum(present) OVER (PARTITION BY doc_id, name ORDER BY present DESC, value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through
      FROM (SELECT doc_id, name, value, count(*) AS present, any_value(n) AS n FROM f WHERE n >= 5 GROUP BY doc_id, name, value))))
  WHERE total >= n * 0.8 AND kinds BETWEEN 2 AND 50 AND n_top <= 5 AND NOT top"""
_KEPT = """SELECT *, edge OR (tier IS NOT NULL AND claim <= 10) AS kept FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN edge OR tier IS NULL THEN 1 ELSE 0 END, tier, item) AS claim FROM (
    SELECT e.*, item < 5 OR item >= n - 5 OR n <= 10 AS edge, CASE WHEN regexp_matches(type || status || coalesce(note, ''), 'error|exception|failed|failure|critical|fatal|crash|panic|abort|timeout|denied|rejected') THEN 0
      WHEN EXISTS (SELECT 1 FROM f JOIN rare_fields r USING (doc_id, name) WHERE f.doc_id = e.doc_id AND f.item = e.item) OR EXISTS (SELECT 1 FROM f JOIN rare_values r USING (doc_id, name, value) WHERE f.doc_id = e.doc_id AND f.item = e.item) THEN 1 END AS tier
    FROM e))"""
_ITEMS = {"e": _EVENTS, "f": _FIELDS, "rare_fields": _RARE_FIELDS, "rare_values": _RARE_VALUES, "kept_items": _KEPT}


def _nested_items(spark, sf_dir):
    return J.distinct_elements(J.json_elements(V.json_docs_nested(spark, sf_dir)))


@query(with_views("SELECT doc_id, CAST(min(pos) AS INTEGER) AS pos, json, count(*) AS n_equal FROM x GROUP BY doc_id, json", x="""SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, '{"kind":"' || event_type || '","third":' || (event_id % 3) || '}' AS json FROM events"""))
def json_dedup_elements(spark, sf_dir):
    return J.distinct_elements(J.json_elements(V.json_docs_repeated(spark, sf_dir))).select("doc_id", "pos", "json", "n_equal")


@query(with_views(
    """SELECT doc_id, source, CASE WHEN source = 'json-csv-schema' THEN csv ELSE text END AS compressed, n AS elements_before FROM (
      SELECT doc_id, text, n, csv, CASE WHEN n >= 2 AND 1.0 - strlen(csv)::DOUBLE / strlen(text) >= 0.3 THEN 'json-csv-schema' ELSE 'json' END AS source FROM json_docs JOIN (
        SELECT doc_id, count(*) AS n, '[' || count(*) || ']{cents:int,event_id:int,' || CASE WHEN count(note) = count(*) THEN 'note:string,' ELSE '' END || 'status:string,type:string' || CASE WHEN count(note) BETWEEN 1 AND count(*) - 1 THEN ',note:string?' ELSE '' END || '}' || chr(10)
          || string_agg(cents || ',' || event_id || ',' || CASE WHEN whole_notes THEN coalesce(note, '') || ',' ELSE '' END || status || ',' || type || CASE WHEN some_notes AND NOT whole_notes THEN ',' || coalesce(note, '') ELSE '' END || chr(10), '' ORDER BY event_id) AS csv
        FROM (SELECT *, count(note) OVER (PARTITION BY doc_id) > 0 AS some_notes, count(note) OVER (PARTITION BY doc_id) = n AS whole_notes FROM e) GROUP BY doc_id) USING (doc_id))""",
    "json_docs", e=_EVENTS))
def json_csv_schema(spark, sf_dir):
    return J.compress_json(V.json_docs(spark, sf_dir)).select("doc_id", "source", "compressed", "elements_before")


@query(with_views("SELECT doc_id, name, present, n FROM rare_fields", e=_EVENTS, f=_FIELDS, rare_fields=_RARE_FIELDS))
def json_rare_fields(spark, sf_dir):
    return J.rare_fields(_nested_items(spark, sf_dir)).select("doc_id", "name", "present", "n")


@query(with_views("SELECT doc_id, name, value, CAST(present AS BIGINT) AS present FROM rare_values", e=_EVENTS, f=_FIELDS, rare_values=_RARE_VALUES))
def json_rare_status(spark, sf_dir):
    return J.rare_status(_nested_items(spark, sf_dir)).select("doc_id", "name", "value", "present")


@query(with_views("SELECT doc_id, CAST(item AS INTEGER) AS item FROM e WHERE regexp_matches(type || status, 'error|exception|failed|failure|critical|fatal|crash|panic|abort|timeout|denied|rejected')", e=_EVENTS))
def json_error_rows(spark, sf_dir):
    return J.outlier_items(_nested_items(spark, sf_dir)).where("tier = 0").select("doc_id", "item")


@query(with_views("SELECT doc_id, CAST(item AS INTEGER) AS item, kept FROM kept_items", **_ITEMS))
def json_row_selection(spark, sf_dir):
    return J.row_selection(_nested_items(spark, sf_dir)).select("doc_id", "item", "kept")


_DROPPED = "SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY g) AS run FROM (SELECT *, item - row_number() OVER (PARTITION BY doc_id ORDER BY item) AS g FROM kept_items WHERE NOT kept)"


@query(with_views("SELECT doc_id, CAST(run AS INTEGER) AS run, CAST(min(item) AS INTEGER) AS first_item, CAST(max(item) AS INTEGER) AS last_item, count(*) AS n FROM dropped GROUP BY doc_id, run", **_ITEMS, dropped=_DROPPED))
def json_drop_runs(spark, sf_dir):
    runs = J.dropped_runs(J.row_selection(_nested_items(spark, sf_dir)))
    return runs.groupBy("doc_id", "run").agg(F.min("item").alias("first_item"), F.max("item").alias("last_item"), F.count(F.lit(1)).alias("n"))


@query(with_views(
    """SELECT doc_id, CAST(run AS INTEGER) AS run, name, kind, CASE kind WHEN 'constant' THEN name || '=' || low WHEN 'range' THEN 'range ' || name || '=' || least_value || '..' || most_value
      WHEN 'coverage' THEN name || ': ' || kinds || ' distinct, ' || low || '..' || high ELSE name || ': ' || counts || CASE WHEN units > present THEN ' absent×' || (units - present) ELSE '' END END AS fact FROM (
      SELECT *, CASE WHEN units = present AND kinds = 1 THEN 'constant' WHEN numeric THEN 'range' WHEN kinds = present AND present > 5 AND strlen(low) < 24 AND strlen(high) < 24 THEN 'coverage' WHEN kinds <= 5 AND NOT long THEN 'enumeration' END AS kind FROM (
        SELECT doc_id, run, name, CAST(sum(c) AS BIGINT) AS present, count(*) AS kinds, min(value) AS low, max(value) AS high, bool_and(num IS NOT NULL) AS numeric, bool_or(strlen(value) >= 24 OR contains(value, ' ')) AS long,
          arg_min(value, num) AS least_value, arg_max(value, num) AS most_value, string_agg(value || '×' || c, ' ' ORDER BY first_item) AS counts
        FROM (SELECT doc_id, run, name, value, count(*) AS c, min(item) AS first_item, TRY_CAST(value AS DOUBLE) AS num FROM dropped JOIN f USING (doc_id, item) GROUP BY doc_id, run, name, value) GROUP BY doc_id, run, name)
      JOIN (SELECT doc_id, run, count(*) AS units FROM dropped GROUP BY doc_id, run) USING (doc_id, run)) WHERE kind IS NOT NULL""",
    **_ITEMS, dropped=_DROPPED))
def invariant_facts(spark, sf_dir):
    return J.invariant_facts(J.dropped_runs(J.row_selection(_nested_items(spark, sf_dir))))


@query()
def json_compress(spark, sf_dir):
    return J.compress_json(V.json_docs_nested(spark, sf_dir)).select("doc_id", "source", "compressed", "elements_before", "elements_after")


_TABLE = """SELECT doc_id, '[' || count(*) || ']{cents,event_id,status,type}:' || string_agg(chr(10) || '  ' || cents || ',' || event_id || ',' || status || ',' || type, '' ORDER BY event_id) AS compressed FROM e GROUP BY doc_id HAVING count(*) >= 2"""


@query(with_views("SELECT * FROM t", e=_EVENTS, t=_TABLE))
def toon_tabular(spark, sf_dir):
    return toon.toon_tables(J.json_elements(V.json_docs_uniform(spark, sf_dir)))


@query(with_views("SELECT doc_id, CASE WHEN strlen(t.compressed) < strlen(text) THEN t.compressed ELSE text END AS compressed, CASE WHEN strlen(t.compressed) < strlen(text) THEN 'toon' ELSE 'toon-not-smaller' END AS source, strlen(text) AS chars_before FROM json_docs_uniform JOIN t USING (doc_id)", "json_docs_uniform", e=_EVENTS, t=_TABLE))
def toon_encode(spark, sf_dir):
    rows = toon.to_toon(V.json_docs_uniform(spark, sf_dir)).where("compressed like '[%]{%' or source <> 'toon'")
    return rows.select("doc_id", "compressed", "source", "chars_before")


@query(with_views("SELECT doc_id, text AS json FROM json_docs_nested", "json_docs_nested"))
def toon_roundtrip(spark, sf_dir):
    rows = toon.to_toon(V.json_docs_nested(spark, sf_dir)).withColumn("encoded", F.when(F.col("source") == "toon", F.col("compressed")))
    rows = toon.from_toon(rows, "encoded")
    return rows.select("doc_id", F.coalesce("json", "text").alias("json"))


_SENTENCES = """SELECT doc_id, generate_subscripts(a, 1) - 1 AS sent_no, unnest(a) AS sentence FROM (
  SELECT doc_id, CASE WHEN words > 0 AND marks * 100 < words THEN regexp_extract_all(text, '(?:\\S+\\s+){0,19}\\S+') ELSE
    list_filter(list_transform(string_split(regexp_replace(text, '([.!?])(\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') END AS a
  FROM (SELECT doc_id, text, len(regexp_extract_all(text, '\\S+')) AS words, len(regexp_extract_all(text, '[.!?]')) AS marks FROM documents))"""


@query(with_views("SELECT doc_id, CAST(sent_no AS INTEGER) AS sent_no, sentence, len(regexp_extract_all(sentence, '\\S+')) AS n_words FROM s", s=_SENTENCES))
def sentence_split(spark, sf_dir):
    return prose.sentence_rows(V.documents(spark, sf_dir)).select("doc_id", "sent_no", "sentence", "n_words")


@query("SELECT doc_id, generate_subscripts(a, 1) - 1 AS window_no, unnest(a) AS words FROM (SELECT doc_id, regexp_extract_all(text, '(?:\\S+\\s+){0,19}\\S+') AS a FROM documents)")
def word_window_rows(spark, sf_dir):
    rows = V.documents(spark, sf_dir).select("doc_id", F.posexplode(word_windows(F.col("text"))).alias("window_no", "words"))
    return rows.select("doc_id", F.col("window_no").cast("long").alias("window_no"), "words")


@query(f"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{_word("I had|I remember|I once|I worked with|I saw|I met|there was a|there was an|she said|he said|they said|told me|my (client|patient|daughter|son|friend|colleague)|years ago|one day|a client of mine")}') THEN 'Narrative' ELSE 'Concept' END AS shape FROM conversations""")
def sentence_shape(spark, sf_dir):
    rows = V.table(spark, sf_dir, "conversations").withColumn("sentence", F.col("text"))
    return prose.sentence_shapes(rows).select("conv_id", "turn", "shape")


@query(with_views(
    """SELECT doc_id, count(*) AS n_shingles, count(DISTINCT shingle) AS n_distinct FROM (
      SELECT doc_id, sent_no, unnest(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle
      FROM (SELECT doc_id, sent_no, regexp_extract_all(sentence, '\\S+') AS w FROM s) WHERE len(w) BETWEEN 8 AND 40) GROUP BY doc_id""", s=_SENTENCES))  # fmt: skip
def shingle_counts(spark, sf_dir):
    rows = prose.sentence_shingles(prose.sentence_rows(V.documents(spark, sf_dir)))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_shingles"), F.count_distinct("shingle").alias("n_distinct"))


@query()
def minhash_signature(spark, sf_dir):
    return prose.minhash_signatures(prose.sentence_rows(V.documents(spark, sf_dir)))


@query()
def cascade_dedup(spark, sf_dir):
    return prose.cascade_dedup(V.documents(spark, sf_dir))


_COSINE = "list_reduce(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * p[2]), lambda x, y: x + y)"
_LENGTHS = f"SELECT vec_id, label, embedding AS v, sqrt({_COSINE.format(a='embedding', b='embedding')}) AS l FROM embeddings"


@query(with_views(
    """SELECT label, vec_id, round(centrality, 6) AS centrality FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(centrality, 9) DESC, vec_id) AS place FROM (
      SELECT a.label, a.vec_id, any_value(a.n) AS n, avg(""" + _COSINE.format(a="a.v", b="b.v") + """ / (a.l * b.l)) AS centrality FROM r a JOIN r b ON a.label = b.label AND a.k <> b.k AND b.k % b.stride = 0 WHERE a.n >= 4 GROUP BY a.label, a.vec_id))
    WHERE place <= greatest(3, least(CAST(round(n * 0.2) AS INT), least(10, n)))""",
    e=_LENGTHS, r="SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n, CAST(ceil(count(*) OVER (PARTITION BY label) / 500) AS INT) AS stride FROM e"))
def embedding_summary(spark, sf_dir):
    return semantic.extractive_summary(V.table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


@query(with_views("SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(" + _COSINE.format(a="a.v", b="b.v") + " / (a.l * b.l), 6) AS similarity FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round(" + _COSINE.format(a="a.v", b="b.v") + " / (a.l * b.l), 9) >= 0.3", e=_LENGTHS))
def embedding_pairs_over_threshold(spark, sf_dir):
    return semantic.pairs_over(V.table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.3)


@query()
def semantic_dedup_greedy(spark, sf_dir):
    return semantic.greedy_dedup(V.table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.3)


_TALK = "SELECT conv_id AS session, turn, role, text, 'toolu_' || conv_id || '_' || turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS t, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations"
_TOOL = """SELECT session, 3 * t + 1 AS line_index, 2 * t AS item_no, 'tool_use' AS item_type, id, CASE turn % 4 WHEN 1 THEN 'Write' WHEN 3 THEN 'Bash' ELSE 'Read' END AS name, CASE WHEN turn % 4 <> 3 THEN '/f' || ((session + turn // 2) % 2) || '.txt' END AS path, NULL AS content, NULL AS is_error FROM talk
  UNION ALL SELECT session, 3 * t + 2, 2 * t + 1, 'tool_result', id, NULL, NULL, CASE WHEN turn % 4 = 3 THEN 'Command running in background with ID: ' || turn WHEN turn % 2 = 0 AND turn >= 2 THEN 'same error' ELSE repeat('x', CAST(turn * 400 AS INT)) END, turn % 2 = 0 AND turn >= 2 FROM talk"""
_RULE = {
    "dedupe_latest_read": "SELECT r.session, r.line_index, r.id, 'dedupe_latest_read' AS rule, strlen(r.content) AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY session, path ORDER BY line_index DESC) AS k FROM i WHERE name = 'Read') u JOIN i r ON r.session = u.session AND r.id = u.id AND r.item_type = 'tool_result' WHERE u.k > 1",
    "supersede_write_by_read": "SELECT r.session, r.line_index, r.id, 'supersede_write_by_read' AS rule, strlen(r.content) AS bytes FROM i u JOIN i r ON r.session = u.session AND r.id = u.id AND r.item_type = 'tool_result' WHERE u.name IN ('Write', 'Edit') AND EXISTS (SELECT 1 FROM i x WHERE x.name = 'Read' AND x.session = u.session AND x.path = u.path AND x.line_index > u.line_index)",
    "drop_redundant_errors": "SELECT session, line_index, id, 'drop_redundant_errors' AS rule, strlen(content) AS bytes FROM (SELECT r.*, row_number() OVER (PARTITION BY r.session, u.name, r.content ORDER BY r.line_index) AS k FROM i r JOIN i u ON r.session = u.session AND r.id = u.id AND u.item_type = 'tool_use' WHERE r.is_error) WHERE k > 1",
    "prune_old_large_outputs": "SELECT session, line_index, id, 'prune_old_large_outputs' AS rule, strlen(content) AS bytes FROM (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM i) WHERE item_type = 'tool_result' AND strlen(content) > 500 AND item_no + 4 < n",
    "collapse_task_launches": "SELECT session, line_index, id, 'collapse_task_launches' AS rule, strlen(content) AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY line_index DESC) AS k FROM i WHERE contains(content, 'running in background with ID:')) WHERE k > 1",
}
_RULE_COLUMNS = "SELECT session, CAST(line_index AS INTEGER) AS line_index, id AS tool_use_id, rule, bytes"


def _items(spark, sf_dir):
    return sessions.session_items(V.transcripts(spark, sf_dir))


@query(with_views("SELECT session, CAST(line_index AS INTEGER) AS line_index, CAST(item_no AS INTEGER) AS item_no, item_type, id, name, path, content, is_error FROM i", talk=_TALK, i=_TOOL))
def session_items(spark, sf_dir):
    return _items(spark, sf_dir)


def _rule_query(name: str, function) -> None:
    def run(spark, sf_dir):
        return function(_items(spark, sf_dir)).select("session", "line_index", "tool_use_id", "rule", "bytes")

    run.__name__ = f"prune_rule{sessions.RULES.index(name) + 1}"
    query(with_views(f"{_RULE_COLUMNS} FROM c", talk=_TALK, i=_TOOL, c=_RULE[name]))(run)


_rule_query("dedupe_latest_read", sessions.dedupe_latest_read)
_rule_query("supersede_write_by_read", sessions.supersede_write_by_read)
_rule_query("drop_redundant_errors", sessions.drop_redundant_errors)
_rule_query("prune_old_large_outputs", lambda items: sessions.prune_old_large_outputs(items, 500, 4))
_rule_query("collapse_task_launches", sessions.collapse_task_launches)
_EVERY_RULE = " UNION ALL ".join(f"({s})" for s in _RULE.values())


def _pruned(spark, sf_dir):
    items = _items(spark, sf_dir)
    return items, sessions.prune_candidates(items, True, 500, 4)


@query(with_views("SELECT rule, count(*) AS n, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM c GROUP BY ROLLUP (rule)", talk=_TALK, i=_TOOL, c=_EVERY_RULE))
def prune_report(spark, sf_dir):
    return sessions.prune_report(_pruned(spark, sf_dir)[1])


@query(with_views(
    """SELECT session, CAST(line_index AS INTEGER) AS line_index, '{"message":{"content":[{"content":"[... session_prune: ' || rule || ' removed, ' || bytes || ' bytes ...]"' || CASE WHEN is_error THEN ',"is_error":true' ELSE '' END || ',"tool_use_id":"' || id || '","type":"tool_result"}],"role":"user"},"type":"user"}' AS line FROM (
      SELECT c.*, x.is_error, row_number() OVER (PARTITION BY c.session, c.id ORDER BY list_position(['dedupe_latest_read', 'supersede_write_by_read', 'drop_redundant_errors', 'prune_old_large_outputs', 'collapse_task_launches'], rule) DESC) AS k
      FROM c JOIN i x ON x.session = c.session AND x.id = c.id AND x.item_type = 'tool_result') WHERE k = 1""",
    talk=_TALK, i=_TOOL, c=_EVERY_RULE))
def prune_apply(spark, sf_dir):
    items, candidates = _pruned(spark, sf_dir)
    return sessions.apply_pruning(V.transcripts(spark, sf_dir), candidates, items).where("changed").select("session", "line_index", "line")


def _sql_digest(start: int) -> str:
    return f"""SELECT session, coalesce(string_agg(CASE role WHEN 'user' THEN 'USER: ' ELSE 'ASSISTANT: ' END || cut, chr(10) || chr(10) ORDER BY turn) FILTER (role IN ('user', 'assistant') AND cut <> '' AND 3 * t >= {start}), '') AS text,
      count(*) FILTER (role IN ('user', 'assistant') AND cut <> '' AND 3 * t >= {start}) AS turn_count, max('t' || turn) FILTER (t = lo) AS first_ts, max('t' || turn) FILTER (t = turns - 1 AND 3 * t >= {start}) AS last_ts, 3 * any_value(turns) + 1 AS total_lines
      FROM (SELECT *, regexp_replace(string_split(text, '<system-reminder>')[1], '^\\s+|\\s+$', '', 'g') AS cut, CAST(ceil({start} / 3) AS INT) AS lo FROM talk) GROUP BY session"""


_DIGEST = ("session", "text", "turn_count", "first_ts", "last_ts", "total_lines")


@query(with_views("SELECT session, text, turn_count, first_ts, last_ts, total_lines FROM d", talk=_TALK, d=_sql_digest(0)))
def session_digest(spark, sf_dir):
    return sessions.session_text(V.transcripts(spark, sf_dir)).select(*_DIGEST)


@query(with_views("SELECT session, text, turn_count, first_ts, last_ts, total_lines FROM d", talk=_TALK, d=_sql_digest(6)))
def digest_incremental(spark, sf_dir):
    return sessions.session_text(V.transcripts(spark, sf_dir), start_line=6).select(*_DIGEST)


@query(with_views(
    """SELECT session, 'SESSION DIGEST s' || session || E'\\n\\n---\\ntype: session-digest\\nsession_id: s' || session || E'\\ncwd: /repo/' || (session % 3) || E'\\nfirst_ts: ' || first_ts || E'\\nlast_ts: ' || last_ts || E'\\nturn_count: ' || turn_count || E'\\n---\\n\\n'
      || CASE WHEN length(text) > 400 THEN left(text, 200) || E'\\n\\n...[truncated — session exceeded per-item cap]...\\n\\n' || right(text, 200) ELSE text END AS digest, length(text) > 400 AS truncated FROM d""",
    talk=_TALK, d=_sql_digest(0)))
def digest_content(spark, sf_dir):
    rows = sessions.session_text(V.transcripts(spark, sf_dir), 400)
    return rows.select("session", sessions.digest_content(F.col("text")).alias("digest"), "truncated")


@query(with_views(
    """SELECT session, kind, calls, chars_before, chars_after, greatest(chars_before - chars_after, 0) AS chars_saved, CASE WHEN chars_before = 0 THEN 0 ELSE round(greatest(chars_before - chars_after, 0) / chars_before * 100, 6) END AS pct_saved FROM (
      SELECT session, kind, count(*) AS calls, CAST(sum(b) AS BIGINT) AS chars_before, CAST(sum(a) AS BIGINT) AS chars_after FROM s GROUP BY GROUPING SETS ((session, kind), (session)))""",
    s=f"SELECT user_id % 10 AS session, event_type AS kind, {V._CENTS} AS b, CAST(floor({V._CENTS} / 2) AS BIGINT) AS a FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND {V._CENTS} >= 0"))
def session_stats(spark, sf_dir):
    return sessions.session_stats(sessions.session_items(V.savings_transcripts(spark, sf_dir)))


@query("SELECT doc_id, CASE WHEN text = '' THEN 'inf'::DOUBLE ELSE round(length(text) / greatest(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]')), 1), 6) END AS chars_per_token, text <> '' AND length(text) / greatest(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]')), 1) <= 2.5 AS profitable FROM documents")
def pixel_density(spark, sf_dir):
    t = F.col("text")
    return V.documents(spark, sf_dir).select("doc_id", F.round(pixel.chars_per_token(t), 6).alias("chars_per_token"), pixel.profitable(t).alias("profitable"))


@query("SELECT doc_id, rows, greatest(CAST(ceil(rows / 91) AS BIGINT), 1) AS pages, CAST(1568 AS INTEGER) AS width, greatest(CAST(ceil(rows / 91) AS BIGINT), 1) * 728 AS height FROM (SELECT doc_id, CAST(list_sum(list_transform(string_split(text, chr(10)), lambda x: greatest(ceil(length(x) / 312), 1))) AS BIGINT) AS rows FROM documents)")
def pixel_pages(spark, sf_dir):
    return pixel.pages(V.documents(spark, sf_dir)).select("doc_id", "rows", "pages", "width", "height")


@query()
def pixel_images(spark, sf_dir):
    rows = detect(V.json_docs(spark, sf_dir), model=_no_model)
    return pixel.render_dense(rows).select("doc_id", F.octet_length("png").alias("png_bytes"), F.md5("png").alias("png_md5"))


@query(
    """SELECT doc_id, array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 1 OR (doc_id + 5 * (i - 2)) % 6 IN (1, 3) THEN CASE WHEN left(x, 1) = 'ß' THEN 'SS' ELSE upper(left(x, 1)) END || substr(x, 2) ELSE x END || ['', '.', ',', '?', '-', ':'][(doc_id + 5 * (i - 1)) % 6 + 1]), ' ') AS restored
    FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents)""")  # fmt: skip
def punct_reconstruct(spark, sf_dir):
    count = F.regexp_count("text", F.lit(r"(?U)\S+"))
    labels = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: ((F.col("doc_id") + i * 5) % 6).cast("int"))
    return prose.restore_punctuation(V.documents(spark, sf_dir).withColumn("labels", labels)).select("doc_id", "restored")


@query()
def shape_features(spark, sf_dir):
    rows = shape_model.features(V.documents(spark, sf_dir))
    return rows.select("doc_id", F.size("features").alias("n"), F.xxhash64("features").alias("digest"))


@query()
def shape_labels(spark, sf_dir):
    pages = V.table(spark, sf_dir, "pages")
    return pages.select("page_id", shape_model.heuristic_label(F.col("html")).alias("label"))


@query()
def route_documents(spark, sf_dir):
    return compress(V.documents(spark, sf_dir))


@query()
def route_views(spark, sf_dir):
    key = F.struct("view", "doc_id").alias("key")
    rows, lines = V.every_view(spark, sf_dir, without=("search", "diff")).select(key, "text"), V.long_view_lines(spark, sf_dir).select(key, "a", "b", "c", "line")
    routed = compress_lines(lines, "key", ["a", "b", "c"], "line", rows)
    return routed.withColumn("key", F.concat("key.view", F.lit(":"), F.col("key.doc_id").cast("string")))


@query(with_views(
    "SELECT doc_id, compressed, 'SearchResults' AS kind, 'search' AS source, strlen(text) AS chars_before FROM search_docs JOIN (" + ORACLES["search_compress"].split(") SELECT doc_id, string_agg(shown", 1)[0].replace("WITH search_docs AS", "WITH ignored AS", 0) + ") SELECT doc_id, string_agg(shown" + ORACLES["search_compress"].split(") SELECT doc_id, string_agg(shown", 1)[1] + ") o USING (doc_id)", "search_docs"))
def route_search(spark, sf_dir):
    rows = V.search_lines(spark, sf_dir)
    return compress_lines(rows, "folder", ["line_no", "doc_id"]).select(F.col("folder").alias("doc_id"), "compressed", "kind", "source", "chars_before")


@query()
def session_digests(spark, sf_dir):
    return digests(V.transcripts(spark, sf_dir)).select("session", "digest", "kind", "source", "chars_before", "chars_after", "turn_count", "is_error")


@query()
def kept_sentences(spark, sf_dir):
    return prose.kept_sentences(V.documents(spark, sf_dir), include_embedding=True).select("doc_id", "place", "sent_no", "sentence", "shape", F.size("embedding").alias("dims"))


@query(
    """SELECT doc_id, generate_subscripts(c, 1) - 1 AS chunk, len(unnest(c)) AS n_words FROM (
      SELECT doc_id, list_transform(range(0, CAST(ceil(len(w) / 300) AS BIGINT)), lambda i: w[i * 300 + 1:i * 300 + 300]) AS c FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents) WHERE len(w) > 0)""")  # fmt: skip
def word_chunks(spark, sf_dir):
    rows = prose.word_chunks(V.documents(spark, sf_dir))
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("words").cast("long").alias("n_words"))


@query()
def operator_catalog(spark, sf_dir):
    return catalog(spark)


@query()
def environment_checks(spark, sf_dir):
    return doctor(spark, sf_dir).select("name", "status")
