"""JSON, notation, sessions, vectors, the router, streams and sources on small known inputs; kernels against relations."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import strict_json as S
from corpusloom.functions.register import register
from corpusloom.operators import json_rows as J
from corpusloom.operators import prose, semantic, sessions, shape_model, toon
from corpusloom.operators.doctor import age_text, doctor, exit_code
from corpusloom.plans.catalog import catalog, observed
from corpusloom.plans.digest import digests
from corpusloom.plans.levels import FactLimits, JsonLimits, level
from corpusloom.plans.line_router import compress_lines
from corpusloom.plans.router import compress, contract_json
from corpusloom.sources import io
from corpusloom.sources import views as V
from corpusloom.streaming import streams

# ---- strict JSON


@pytest.mark.parametrize("text", ["[NaN]", "[1,2,]", '{"a":1} x', "[Infinity]", '["\\ud800"]', "[1e999]", "", "[", "[01]", "['a']", "[" * 200 + "]" * 200, '["a\nb"]', "﻿[]"])
def test_not_json(text):
    assert S.parse(text) == (False, None)


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ('{"b":1,"a":2,"b":3}', '{"a":2,"b":3}'), ("[1.0,5.00,1e2,1e16,1e-5,1e-6,1e-7,1.5e300,-0.0,0.1]", "[1.0,5.0,100.0,1e16,0.00001,1e-6,1e-7,1.5e300,-0.0,0.1]"),
        ("[18446744073709551615,18446744073709551616]", "[18446744073709551615,1.8446744073709552e19]"), ('["\\u00e9\\n\\u0001/\\/"]', '["é\\n\\u0001//"]'), (" [ true , null ] ", "[true,null]"), ("[1234567890123456.7,123456789012345680.0]", "[1234567890123456.8,1.2345678901234568e17]"),
    ],
)
def test_minified(text, plain):
    assert S.minified(S.loads(text)) == plain


def test_identity():
    same = lambda a, b: S.identity(S.loads(a)) == S.identity(S.loads(b))
    assert same('{"a":1,"b":[2]}', '{"b":[2],"a":1}') and same("[0.0]", "[-0.0]") and not same("[1]", "[1.0]") and not same("[true]", "[1]") and not same('["1"]', "[1]")


def test_raw_slices_keep_number_text():
    assert S.raw_slices('[{"a": 5.00, "b":"x\\"y", "c": [1, {"z":2}] }, 7, "s", {"a":1,"a":2}]') == [[("a", "5.00"), ("b", 'x"y'), ("c", '[1, {"z":2}]')], None, None, [("a", "2")]]
    assert S.raw_slices("[]") == []


# ---- arrays


def test_csv_schema():
    assert J.csv_schema([{"id": 1, "s": "a,b"}, {"id": 2, "s": 'q"'}]) == '[2]{id:int,s:string}\n1,"a,b"\n2,"q"""\n'
    assert J.csv_schema([{"a": 1, "z": None}, {"a": 1.5, "b": True}, {"a": "x"}]) == "[3]{a:json,b:bool?,z:string?}\n1,,\n1.5,true,\nx,,\n"
    assert J.csv_schema([{"a": 1}]) is None and J.csv_schema([{"a": 1}, 2]) is None and J.csv_schema([{"a": [1]}, {"a": 2}]) is None


def test_compress_array():
    assert J.compress_json_array('[{"a":1},{"a":1},{"a":2}]')[2:] == (3, 2)
    rows = [{"id": i, "status": "ok"} for i in range(50)]
    out, source, before, after = J.compress_json_array(json.dumps(rows))
    assert source == "json-csv-schema" and out.startswith("[50]{id:int,status:string}\n0,ok\n") and (before, after) == (50, 50)
    assert J.compress_json_array('{"a":1}') is None and J.compress_json_array("nope") is None and J.compress_json_array("[]") == ("[]", "json", 0, 0)


def test_facts_in_markers():
    rows = [{"id": i, "kind": "widget", "status": ["a", "b", "c"][i % 3], "amount": f"{i}.50", "session_token": [i]} for i in range(20)]
    out = json.loads(J.compress_json_array(json.dumps(rows))[0])
    assert len(out) == 11 and out[5] == "...10 more elements omitted (kind=widget range amount=5.50..14.50 range id=5..14 status: c×4 a×3 b×3)..."
    rows[15] = {"status": "error", "msg": "request failed", "session_token": [1]}
    out = json.loads(J.compress_json_array(json.dumps(rows + [{"id": 99, "status": "a", "session_token": [9]}] * 1))[0])
    assert any(isinstance(x, dict) and x.get("msg") == "request failed" for x in out)


def test_error_row_splits_the_run():
    rows = [{"id": i, "data": [i], "msg": "fine"} for i in range(30)]
    rows[15] = {"id": 15, "data": [15], "msg": "request failed"}
    out = json.loads(J.compress_json_array(json.dumps(rows))[0])
    marks = [x for x in out if isinstance(x, str)]
    assert len(marks) == 2 and marks[0].startswith("...10 more") and marks[1].startswith("...9 more")


def test_describe():
    units = lambda name, values: [[(name, v)] if v is not None else [] for v in values]
    assert J.describe(units("k", ["x"] * 3)) == "k=x"
    assert J.describe(units("k", ["x", None, "x"])) == "k: x×2 absent×1"
    assert J.describe(units("p", ["5.00", "199.99", "42.50"])) == "range p=5.00..199.99"
    assert J.describe(units("id", [f"wh-{i}" for i in range(5000, 5060)])) == "id: wh-5000..wh-5059 all 60 present"
    assert J.describe(units("id", [f"wh-{i}" for i in range(50, 60) if i != 53])) == "id: 9 distinct, wh-50..wh-59"
    assert J.describe(units("api_key", ["1", "2"])) is None and J.describe(units("author", ["1"])) is None and J.describe([]) is None
    assert J.describe(units("t", ["some words", "x"])) is None and J.describe(units("t", [f"v{i} w" for i in range(9)])) is None
    assert J.describe([[("a", "x"), ("b", "y" * 30)]] * 2, FactLimits(max_marker_bytes=10)) == "a=x"
    assert J.fact_of("n", ["inf", "1", "-2"], 3, FactLimits()) == (1, "range n=-2..inf")


def test_outliers():
    rows = [{"status": "ok"}] * 95 + [{"status": f"e{i}"} for i in range(5)]
    assert J.structural_outliers(rows) == list(range(95, 100))
    levels = [{"l": "INFO"}] * 60 + [{"l": "WARN"}] * 25 + [{"l": f"x{i}"} for i in range(15)]
    assert J.structural_outliers(levels) == list(range(85, 100))
    assert J.structural_outliers([{"v": i} for i in range(50)]) == [] and J.structural_outliers([{"v": 1}, {"v": 2}]) == []
    assert J.structural_outliers([{"a": 1}] * 9 + [{"a": 1, "b": 2}]) == [9]
    assert J.structural_outliers([{"s": None}] * 9 + [{"s": "x"}]) == [] and J.structural_outliers([{"s": None}] * 8 + [{"s": "x"}, {"s": "y"}]) == [8, 9]
    assert J.error_positions([{"a": "Timeout"}, "error", {"failed": 1}, {"ok": 1}]) == [0, 2]


def random_array(rng):
    item = lambda i: rng.choice([{"id": i, "s": rng.choice("aaaab"), "t": [i % 2]}, {"id": i, "s": "a", "t": [0]}, {"id": i, "s": "a", "t": [1], "note": "n"}, {"id": i % 4, "m": rng.choice(["denied", "x", None])}, 5, "error", {"f": 1.5}])
    return [item(i) for i in range(rng.randint(0, 60))]


def test_relations_match_the_kernel(spark):
    rng = random.Random(4)
    arrays = [random_array(rng) for _ in range(40)]
    docs = io.literal(spark, *map(json.dumps, arrays))
    items = J.distinct_elements(J.json_elements(docs))
    picked = J.row_selection(items).select("doc_id", "item", "kept").collect()
    facts = J.invariant_facts(J.dropped_runs(J.row_selection(items)), FactLimits(max_marker_bytes=10**6)).collect()
    for d, array in enumerate(arrays):
        at = J.unique_elements(array)
        unique = [array[i] for i in at]
        want = J.kept_positions(unique, 5) if len(unique) > 10 else list(range(len(unique)))
        assert sorted(r["item"] for r in picked if r.doc_id == d and r.kept) == want
        dropped, run, raw = [i for i in range(len(unique)) if i not in want], 0, S.raw_slices(json.dumps(array))
        for i in dropped:
            if i - 1 in dropped:
                continue
            run += 1
            members = [i]
            while members[-1] + 1 in dropped:
                members.append(members[-1] + 1)
            text = J.describe([raw[at[m]] for m in members if raw[at[m]] is not None], FactLimits(max_marker_bytes=10**6))
            got = sorted((("constant", "range", "coverage", "enumeration").index(r.kind), r.fact) for r in facts if r.doc_id == d and r["run"] == run)
            assert sorted(f for _, f in got) == sorted(_split(text, [f for _, f in got])), (text, got)


def _split(text, parts):
    """The facts of a joined text, given what they should be."""
    left = text or ""
    for p in parts:
        assert p in left, (p, left)
        left = left.replace(p, "", 1)
    assert left.strip() == ""
    return parts


# ---- notation

VALUES = [
    {}, [], {"a": {}}, {"a": []}, [{"a": {}}], [{"a": []}], [[]], [[], [1]], [1, "x", True, None], {"a": {"b": {"c": [1, 2]}}}, [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}],
    [{"a": 1}, {"b": 2}], {"x": [{"a": [1, 2]}, {"b": {"c": 3}}]}, [{"k": [1, {"z": 2}], "l": 5}], {"s": "a: b", "t": "", "u": " x", "v": "-1", "w": "true", "y": "#c", "z": "1e5"}, ["a:b", "c,d", 'q"r', "back\\slash", "line\nbreak", "\x01"],
    [{"k": [{"p": 1, "q": "x,y"}, {"p": 2, "q": "null"}], "r": None}], {"n": [1.5, -2.25, 0, 18446744073709551615]}, ["x"], [[1, 2], [3]], [{"a": {"b": 1}, "c": 2}, {"a": {"b": 2}, "c": 3}], "plain", 5, None, True, "a:b",
]


@pytest.mark.parametrize("value", VALUES, ids=lambda v: json.dumps(v)[:30])
def test_notation_round_trip(value):
    assert toon.decode(toon.encode(value)) == value


def test_notation_forms():
    assert toon.encode([{"a": 1, "b": "x"}, {"a": 2, "b": "y,z"}]) == '[2]{a,b}:\n  1,x\n  2,"y,z"'
    assert toon.encode({"k": [1, 2], "o": {"p": "q"}}) == "k[2]: 1,2\no:\n  p: q"
    assert toon.encode([{"a": 1}, 2]) == "[2]:\n  - a: 1\n  - 2"
    assert [toon.number(x) for x in (1.0, -0.0, 1e21, 1e-7, 0.1, 123456789.125, 1.23456789e-6)] == ["1", "0", "1000000000000000000000", "0.0000001", "0.1", "123456789.125", "0.000001234568"]
    with pytest.raises(toon.DecodeError):
        toon.decode("[2]{a}:\n  1")


def test_notation_random_round_trip():
    rng = random.Random(6)

    def value(depth=0):
        k = rng.random()
        if depth < 3 and k < 0.25:
            return {rng.choice("abcde") + str(i): value(depth + 1) for i in range(rng.randint(0, 3))}
        if depth < 3 and k < 0.5:
            return [value(depth + 1) for _ in range(rng.randint(0, 4))]
        return rng.choice([1, -5, True, None, "x", "a b", "a:b", "", "-", '"', "\\", "1.0", "[x]", "{", "é", 2.5, "- a", "a[1]: 2"])

    for _ in range(500):
        v = value()
        assert toon.decode(toon.encode(v)) == v, toon.encode(v)


# ---- sessions


def use(i, name, path=None):
    return json.dumps({"type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": i, "name": name, "input": {"file_path": path} if path else {}}]}})


def result(i, content, error=None):
    block = {"type": "tool_result", "tool_use_id": i, "content": content}
    return json.dumps({"type": "user", "message": {"role": "user", "content": [block | ({"is_error": True} if error else {})]}})


def transcript(spark, *rows):
    return spark.createDataFrame([("s", i, r) for i, r in enumerate(rows)], "session string, line_index int, line string")


def rules(df):
    return sorted((r["rule"], r.tool_use_id, r.bytes) for r in df.collect())


def test_items_skip_what_they_do_not_know(spark):
    odd = [use("a", "Read", "/f"), "not json", "", '{"message":{"content":"tool_use"}}', '{"message":{"content":[{"type":"tool_use","id":5,"name":"x"},{"type":"tool_result"},7]}}', result("a", [1, 2]), result("a", "x", True)]
    got = sessions.session_items(transcript(spark, *odd)).orderBy("item_no").collect()
    assert [(r.item_no, r.line_index, r.item_type, r.id, r.path, r.content, r.is_error) for r in got] == [(0, 0, "tool_use", "a", "/f", None, None), (1, 5, "tool_result", "a", None, "", False), (2, 6, "tool_result", "a", None, "x", True)]


def test_prune_rules(spark):
    rows = [use("w", "Write", "/f"), result("w", "wrote"), use("r1", "Read", "/f"), result("r1", "old text"), use("r2", "Read", "/f"), result("r2", "new"), use("b1", "Bash"), result("b1", "boom", True), use("b2", "Bash"), result("b2", "boom", True), use("l1", "Bash"), result("l1", "Command running in background with ID: 1"), use("l2", "Bash"), result("l2", "Command running in background with ID: 2"), use("big", "Bash"), result("big", "x" * 3000), use("z", "Read", "/other"), result("z", "y" * 3000)]
    t = transcript(spark, *rows)
    items = sessions.session_items(t)
    assert rules(sessions.dedupe_latest_read(items)) == [("dedupe_latest_read", "r1", 8)]
    assert rules(sessions.supersede_write_by_read(items)) == [("supersede_write_by_read", "w", 5)]
    assert rules(sessions.drop_redundant_errors(items)) == [("drop_redundant_errors", "b2", 4)]
    assert rules(sessions.prune_old_large_outputs(items, 2000, 2)) == [("prune_old_large_outputs", "big", 3000)]
    assert rules(sessions.prune_old_large_outputs(items, 3000, 0)) == [] and rules(sessions.prune_old_large_outputs(items)) == []
    assert rules(sessions.collapse_task_launches(items)) == [("collapse_task_launches", "l1", 40)]
    found = sessions.prune_candidates(items, min_bytes=2000, window=2)
    assert {r["rule"]: (r.n, r.bytes) for r in sessions.prune_report(found).collect()}[None] == (4, 3052)
    pruned = {r.line_index: r for r in sessions.apply_pruning(t, found, items).collect()}
    assert [i for i, r in pruned.items() if r.changed] and all(pruned[i].line == rows[i] for i in range(len(rows)) if not pruned[i].changed)
    assert pruned[3].line == '{"message":{"content":[{"content":"[... session_prune: dedupe_latest_read removed, 8 bytes ...]","tool_use_id":"r1","type":"tool_result"}],"role":"user"},"type":"user"}'


def test_digest(spark):
    say = lambda role, text, **more: json.dumps({"type": role, "message": {"role": role, "content": text}} | more)
    rows = [say("user", "hello <system-reminder>no</system-reminder>", sessionId="s1", cwd="/a", timestamp="t1"), "bad", say("assistant", [{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "x", "name": "y"}, {"type": "text", "text": ""}], timestamp="t2"), say("system", "skip"), say("user", "<system-reminder>all"), say("user", "é" * 30, sessionId="s2")]
    t = transcript(spark, *rows)
    r = sessions.session_text(t).first()
    assert r.text == f"USER: hello\n\nASSISTANT: hi\n\nUSER: {'é' * 30}" and (r.session_id, r.cwd, r.first_ts, r.last_ts, r.turn_count, r.truncated, r.total_lines) == ("s2", "/a", "t1", "t2", 3, False, 6)
    assert r.raw_bytes == sum(len(x.encode()) + 1 for x in rows)
    later = sessions.session_text(t, start_line=2).first()
    assert later.text == r.text.split("\n\n", 1)[1] and later.total_lines == 6
    cut = sessions.session_text(t, 10).first()
    assert cut.text == "USER:" + sessions.CUT + "é" * 5 and cut.truncated
    shown = sessions.session_text(t).select(sessions.digest_content(F.lit("BODY")).alias("d")).first().d
    assert shown == "SESSION DIGEST s2\n\n---\ntype: session-digest\nsession_id: s2\ncwd: /a\nfirst_ts: t1\nlast_ts: t2\nturn_count: 3\n---\n\nBODY"


def test_stats(spark):
    call = lambda **more: json.dumps({"compressed": "x", "kind": "Log", "source": "s", "chars_before": 100, "chars_after": 40} | more)
    broken = [call(chars_before=-1), call(chars_before=1.5), call(kind=3), json.dumps({"kind": "Log"}), "text chars_before", call(chars_after=True)]
    rows = [result("a", call()), result("b", call(chars_before=0, chars_after=9, kind="Json")), *[result("c", x) for x in broken], result("d", call(chars_before=1, chars_after=50))]
    got = {r["kind"]: (r.calls, r.chars_before, r.chars_after, r.chars_saved, r.pct_saved) for r in sessions.session_stats(sessions.session_items(transcript(spark, *rows))).collect()}
    assert got == {"Log": (2, 101, 90, 11, pytest.approx(10.891089)), "Json": (1, 0, 9, 0, 0.0), None: (3, 101, 99, 2, pytest.approx(1.980198))}


# ---- vectors


def test_greedy_and_summary(spark):
    rows = [(0, 0, [1.0, 0.0]), (0, 1, [0.99, 0.1]), (0, 2, [0.0, 1.0]), (0, 3, [0.98, 0.12]), (1, 0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "g int, i int, v array<float>")
    got = {(r.g, r.i): (r.kept, r.kept_order) for r in semantic.greedy_dedup(df, "g", "i", "v", 0.9).collect()}
    assert got == {(0, 0): (True, None), (0, 1): (False, 0), (0, 2): (True, None), (0, 3): (False, 0), (1, 0): (True, None)}
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3)) + [4, 0, 0]
    x[7] = [-4, 0, 0]
    df = spark.createDataFrame([(0, i, r.tolist()) for i, r in enumerate(x)] + [(1, i, [1.0, 2.0, 3.0]) for i in range(3)], "g int, i int, v array<double>")
    best = [r.i for r in semantic.extractive_summary(df, "g", "i", "v").orderBy("i").collect()]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    mean = ((u @ u.T).sum(1) - 1) / 39
    assert best == sorted(np.argsort(-mean)[:8].tolist())


def test_mean_pool(spark):
    rows = [(0, [[3.0, 0.0], [9.0, 9.0], [3.0, 8.0]], [1, 0, 1]), (1, [[1.0, 1.0]], [0])]
    got = spark.createDataFrame(rows, "n int, t array<array<double>>, m array<int>").select("n", semantic.mean_pool(F.col("t"), F.col("m")).alias("v")).orderBy("n").collect()
    assert got[0].v == pytest.approx([0.6, 0.8]) and got[1].v == [0.0, 0.0]


def test_digests_and_kept_sentences(spark):
    a = "The committee reviewed the annual budget in great detail on monday morning."
    say = json.dumps({"type": "user", "sessionId": "q", "message": {"content": f"{a} Tiny. {a}"}})
    t = spark.createDataFrame([("s", 0, say), ("e", 0, "junk")], "session string, line_index int, line string")
    got = {r.session: r for r in digests(t).collect()}
    assert got["s"].digest.startswith("SESSION DIGEST q\n") and got["s"].digest.endswith(f"USER: {a} Tiny. {a}\n") and not got["s"].is_error and got["s"].source == "dedup"
    assert got["e"].digest is None and got["e"].is_error and not [r for r in digests(t, start_line=1).collect() if r.is_error]
    kept = prose.kept_sentences(io.literal(spark, f"{a} Tiny. {a} I remember that."), include_embedding=True).orderBy("place").collect()
    assert [(r.sent_no, r["shape"], r.embedding and len(r.embedding)) for r in kept] == [(0, "Concept", 384), (1, "Concept", None), (3, "Narrative", None)]


def test_kept_sentences_come_in_bounded_batches(spark):
    texts = [" ".join(f"Entry {d} {i} names {i * 7919 % 9973} {i * 104729 % 9967} {i * 31 % 9949} w{i} x{i * 3} y{i * 5}." for i in range(40)) for d in range(5)]
    batch = pa.record_batch([pa.array(["a", "b", None, "c", "d"]), pa.array([t.split("  ") if i == 3 else [s + "." for s in t[:-1].split(". ")] for i, t in enumerate(texts)])], ["key", "s"])
    got = list(prose.kept_batches([batch], True, most=7))
    assert max(b.num_rows for b in got) == 7
    rows = [r for b in got for r in b.to_pylist()]
    want = []
    for key, pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        kept, others, _ = prose.cascade(pieces)
        want += [(key, place, i, pieces[i], prose.byte_vector(pieces[i]).tolist() if i in kept else None) for place, i in enumerate(kept + others)]
    assert [(r["key"], r["place"], r["sent_no"], r["sentence"]) for r in rows] == [w[:4] for w in want] and len(want) > 15
    for r, w in zip(rows, want, strict=True):
        assert (r["embedding"] is None) == (w[4] is None) and (w[4] is None or np.allclose(r["embedding"], w[4], atol=1e-6))
    df = spark.createDataFrame([("a", texts[0]), (None, "One two. Three."), ("n", None), ("e", "")], "id string, text string")
    assert prose.kept_sentences(df, "id", include_embedding=True).where("id is null").count() == 2 and prose.kept_sentences(df, "id").where("id in ('n', 'e') or embedding is not null").count() == 0


@pytest.mark.parametrize("block", [7, 2048])
def test_pairs_over_in_blocks(spark, monkeypatch, block):
    """All pairs of a group, as compared one by one in the engine; no join of rows with rows."""
    monkeypatch.setattr(semantic, "BLOCK", block)
    rng = random.Random(4)
    rows = [(rng.choice(["x", "y", None]), rng.randrange(100), [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)]) for _ in range(120)]
    rows += [("x", 200, None), ("x", 201, [1.0, None, 0.0, 0.0]), ("x", 202, [1.0, 0.0]), ("x", 203, [2.0, 0.0]), ("x", 204, [0.0] * 4), ("y", 205, [float("nan"), 1.0, 0.0, 0.0]), ("y", None, [1.0] * 4), ("y", 206, [])]
    df = spark.createDataFrame(rows, "g string, o int, v array<float>")
    made = semantic.pairs_over(df, "g", "o", "v", 0.3)
    assert made.columns == ["g", "a", "b", "similarity"]
    left, right = (df.select(F.col("g").alias(f"g{n}"), F.col("o").alias(n), semantic.unit(F.col("v")).alias(f"v{n}")) for n in "ab")
    each = left.join(right, F.expr("ga = gb and a < b")).withColumn("s", semantic._dot(F.col("va"), F.col("vb"))).where(F.round("s", 9) >= 0.3)
    want = each.select("ga", "a", "b", F.round("s", 6)).collect()
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, map(tuple, want))) and len(want) > 300
    assert "zip_with" not in made._jdf.queryExecution().optimizedPlan().toString()  # products row by row took most of the time


def test_catalog_and_observation(spark):
    assert {r.name for r in catalog(spark).collect()} >= {"compress", "collapse_runs", "row_selection", "session_items"}
    rows, seen = observed(io.literal(spark, "ab", "c"), "stage", "text")
    assert rows.count() == 2 and seen.get == {"rows": 2, "bytes": 3}


# ---- shapes, router, sources, streams


def test_byte_features():
    assert shape_model.byte_features("") is None and shape_model.byte_features(" " * 50 + "short") is None
    f = shape_model.byte_features("  hello world  ")
    assert f[:13] == list(b"hello world  ") and f[13] == 256 and f[-13:] == list(b"  hello world") and len(f) == 2048
    assert shape_model.byte_features("x" * 9000)[1023:1025] == [120, 120]


def test_label_rules(spark):
    table = shape_model.label_table(spark, ["txt", "markdown", "randomtxt", "rust", "zip"], {"zip"})
    scored = spark.createDataFrame([(0, [0.1, 0.7, 0.0, 0.0, 0.2]), (1, [0.1, 0.8, 0.0, 0.0, 0.1]), (2, [0.0, 0.0, 0.9, 0.0, 0.0]), (3, [0.0, 0.0, 0.0, 0.5, 0.5]), (4, [0.1, 0.2, 0.1, 0.2, 0.4])], "n int, scores array<double>")
    assert [r.final_label for r in shape_model.final_label(scored, table).orderBy("n").collect()] == ["txt", "markdown", "txt", "zip", "unknown"]


def test_router(spark):
    log = "\n".join(f"line {i} of the build is fine and long enough" for i in range(80)) + "\nERROR: broke"
    prose = "The committee reviewed the annual budget in great detail on monday morning. " * 40
    texts = {"json": json.dumps([{"id": i, "s": "ok"} for i in range(30)]), "object": '{"a":1}', "search": "a:1: x\nb:2: y", "log": log, "short_log": "ERROR x", "diff": "diff --git a/x b/x\n" + "@@ -1 +1 @@\n-a\n+b\n" * 200, "short_diff": "diff --git a/x b/x\n@@ -1 +1 @@\n-a", "prose": prose, "short": "hello there", "html": "<html><body>\nx\nx\n</body></html>", "null": None, "empty": "", "numbered": "\n".join(f"{i}\tERROR {i}" for i in range(1, 9))}
    got = {r.name: r for r in compress(spark.createDataFrame(list(texts.items()), "name string, text string"), "name").collect()}
    assert {n: (r.kind, r.source) for n, r in got.items()} == {
        "json": ("Json", "json-csv-schema"), "object": ("Json", "json-passthrough"), "search": ("SearchResults", "search"), "log": ("Log", "dedup+log"), "short_log": ("Log", "dedup"), "diff": ("Diff", "diff"), "short_diff": ("Diff", "passthrough"),
        "prose": ("PlainText", "cascade"), "short": ("PlainText", "dedup"), "html": ('Other("html")', "dedup"), "null": (None, None), "empty": ("PlainText", "dedup"), "numbered": ("Log", "dedup"),
    }
    assert got["prose"].compressed == "The committee reviewed the annual budget in great detail on monday morning." and (got["prose"].kept_count, got["prose"].removed_count) == (1, 39)
    assert got["numbered"].line_numbers_stripped and got["numbered"].compressed == "".join(f"ERROR {i}\n" for i in range(1, 9)) and got["short"].line_numbers_stripped is None
    assert got["json"].elements_before == 30 and got["diff"].hunks_removed == 190 and got["log"].lines_after == 3 and got["short"].chars_before == 11 and got["short"].chars_after == 12
    small = {r.name: r for r in compress(spark.createDataFrame([("a", "hello"), ("b", prose)], "name string, text string"), "name", never_grow=True).collect()}
    assert small["a"].compressed == "hello" and small["a"].source == "passthrough" and small["b"].source == "cascade"
    forced = compress(spark.createDataFrame([("a", '[{"a":1}]')], "name string, text string"), "name", force_kind="plain-text").first()
    assert forced.kind == "PlainText"
    out = json.loads(contract_json(compress(spark.createDataFrame([("q", 'say "x"\t\n')], "name string, text string"), "name"), "name").first().json)
    assert out["compressed"] == 'say "x"\t\n' and set(out) == {"compressed", "kind", "source", "chars_before", "chars_after"}
    with pytest.raises(ValueError):
        compress(spark.createDataFrame([("a", "")], "name string, text string"), "name", level_name="wild")




def _as_lines(spark, texts: dict):
    """name, n, line: the texts' lines out of order, and a null line that is in no text."""
    rows = [(name, n, line) for name, t in texts.items() for n, line in enumerate(t.split("\n"))]
    return spark.createDataFrame([*rows[::-1], ("search", 3, None)], "name string, n int, line string")


def test_lines_in_rows_are_routed_as_their_text(spark):
    hits = [f"src/{'abc'[i % 3]}.py:{i}:say {i}" for i in range(30)]
    blob, uri = "QUJD" * 150, "data:image/png;base64," + "QUJD" * 9
    hunks = [f"@@ -{i},4 +{i},4 @@\n ctx a\n ctx b\n-old {i}\n+new {i}{' fixme' if i % 7 == 0 else ''}\n ctx c" for i in range(90)]
    patch = "diff --git a/f b/f\n--- a/f\n+++ b/f\n" + "\n".join(hunks)
    texts = {
        "search": "\n".join(hits), "ends": "\n".join([*hits, ""]), "two ends": "\n".join([*hits, "", ""]), "crlf": "\r\n".join([*hits, ""]), "last cr": "\n".join(hits) + "\r", "mixed": "\n".join([*hits[:9], "", "no match", "a b:1: no match", *hits[9:]]),
        "blob": "\n".join([*hits, "src/d.py:1:" + blob, "src/d.py:2:" + uri + "== end"]), "over lines": "\n".join([*hits, "src/d.py:3:" + uri, "AAAA/x.py:1:more", *hits]), "begins with blob": "\n".join([uri + "=", *hits]),
        "bracket": "\n".join(["", "[x:1:y", *hits]), "half": "a:1:b\nc", "less": "a:1:b\nc\nd", "json": '\n [1,\n2]', "numbered": "\n".join(f"{i + 1}\tsrc/a.py:{i}:x" for i in range(9)), "numbered end": "".join(f"{i + 1}\tx\n" for i in range(9)),
        "diff": patch, "diff ends": patch.replace("\n", "\r\n") + "\r\n", "small diff": patch[:300], "marks": "\n".join(["--- a/x", "@@ -1 +1", *(["-a", "+b"] * 900)]), "blob diff": "\n".join([patch, "+" + blob]),
        "log": "\n".join(f"{'ERROR' if i % 50 == 0 else 'INFO'}: line {i}" for i in range(300)), "prose": "One thing is said. " * 200, "one": "a:1:b", "empty": "", "blank": "\n \n",
    }
    want = compress(spark.createDataFrame(list(texts.items()), "name string, text string"), "name")
    got = compress_lines(_as_lines(spark, texts), "name", ["n"], "line", spark.createDataFrame([("more", hits[0])], "name string, text string"))
    assert got.dtypes == want.dtypes
    got, want = ({r["name"]: r.asDict() for r in rows.collect()} for rows in (got, want))
    more = got.pop("more")
    assert (more["compressed"], more["kind"]) == (hits[0], "SearchResults") and sorted(got) == sorted(want)
    for name, row in want.items():
        assert got[name] == row, name
    assert {want[n]["kind"] for n in ("search", "crlf", "mixed", "blob", "over lines", "half")} == {"SearchResults"} and want["over lines"]["base64_blobs_removed"] == 1
    keyless = spark.createDataFrame([(None, 1, None), ("k", None, "x:2:b"), ("k", 1, "x:1:a")], "name string, n int, line string")
    assert sorted((r["name"] or "", r.compressed) for r in compress_lines(keyless, "name", ["n"]).collect()) == [("", ""), ("k", "x:2:b\nx:1:a")]

def test_long_views_as_lines_are_their_texts(spark, tmp_path):
    parts = [(i, None if i % 11 == 0 else f"name {i}\nx" if i % 13 == 0 else f"name {i}", "TYPE", None if i == 7 else i % 3 + 30 * (i % 2)) for i in range(60)]
    parts += [(6, "b", "TYPE", 5), (6, "a", "TYPE", 5), (10, None, "TYPE", 8), (None, "c", "TYPE", 2)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, None if i == 3 else f"one {i}\n\ntwo\r\nthree") for i in range(25)] + [(None, "lost")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for view, docs, lines, key, order in (("diff", V.diff_docs, V.diff_lines, "d", ["f", "hunk_no", "line_no"]), ("search", V.search_docs, V.search_lines, "folder", ["line_no", "doc_id"])):
        want = {r.doc_id: r.text for r in docs(spark, str(tmp_path)).collect()}
        assert {r.doc_id: r.text for r in V.joined(lines(spark, str(tmp_path)), key, order, F.col("line"), "\n").collect()} == want
        got = V.long_view_lines(spark, str(tmp_path)).where(F.col("view") == view)
        assert {r.doc_id: r.text for r in V.joined(got, "doc_id", ["a", "b", "c"], F.col("line"), "\n").collect()} == want and None in want


def test_escaped_names_of_items_are_read(spark):
    use = json.dumps({"type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "a", "name": "Read", "input": {"file_path": "f"}}]}})
    rows = [("s", 0, use), ("s", 1, use.replace("tool_use", "tool\\u005fuse").replace('"a"', '"b"'))]
    got = sessions.session_items(spark.createDataFrame(rows, "session string, line_index int, line string")).orderBy("item_no").collect()
    assert [r.id for r in got] == ["a", "b"]


def test_package_surface():
    import corpusloom

    assert all(callable(getattr(corpusloom, n)) or n == "LEVELS" for n in corpusloom.__all__)
    with pytest.raises(AttributeError):
        corpusloom.nothing


def test_levels():
    assert level("conservative").diff.max_files == 40 and level("aggressive").log.max_total_lines == 50 and level("default").json == JsonLimits()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"id": "x", "text": "hello", "include_embedding": True}, {"id": "y", "text": "there", "restore_punctuation": 1}]))
    assert [tuple(r) for r in io.batch(spark, str(tmp_path / "b.json")).orderBy("item").collect()] == [(0, "x", "hello", True, True), (1, "y", "there", True, False)]
    (tmp_path / "bad.json").write_text('[{"id":"x","text":"t"},{"id":"y"}]')
    with pytest.raises(io.InputError, match="item 1"):
        io.batch(spark, str(tmp_path / "bad.json"))
    (tmp_path / "none.json").write_text('{"id":"x"}')
    with pytest.raises(io.InputError):
        io.batch(spark, str(tmp_path / "none.json"))
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "s.jsonl").write_text("one\ntwo\n\nthree\n")
    assert [(r.line_index, r.line) for r in io.transcripts(spark, str(tmp_path / "t")).orderBy("line_index").collect()] == [(0, "one"), (1, "two"), (2, ""), (3, "three")]
    results = compress(io.literal(spark, "a\nb"))
    io.write_texts(results, str(tmp_path / "out"))
    io.write_contract(results, str(tmp_path / "contract"))
    assert json.loads(spark.read.text(str(tmp_path / "contract")).first().value)["compressed"] == "a\nb\n"
    named = compress(spark.createDataFrame([('x"}', "a\nb"), (None, "c")], "id string, text string"), "id", "text")
    io.write_batch(named, str(tmp_path / "batch"))
    said = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "batch")).collect()]
    assert {(r.get("id"), r["compressed"]) for r in said} == {('x"}', "a\nb\n"), (None, "c\n")} and all(r["kind"] for r in said)
    io.write_transcript(spark.createDataFrame([("s", 1, "b"), ("s", 0, "a")], "session string, line_index int, line string"), str(tmp_path / "copy"))
    assert "a\nb\n" in [p.read_text() for p in (tmp_path / "copy" / "session=s").glob("*.txt")]


def test_streams(spark, tmp_path):
    schema = "session string, line_index long, line string"
    say = lambda t: json.dumps({"type": "user", "message": {"content": t}})
    folder, out = str(tmp_path / "lines"), str(tmp_path / "out")
    for batch in ([("s", 0, say("one")), ("s", 1, "bad")], [("s", 1, "bad"), ("s", 2, say("two")), ("q", 0, say("three"))]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        streams.write_batches(streams.incremental_digests(streams.table_stream(spark, folder, schema, 10)), out, str(tmp_path / "check")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == [("q", 0, 1, 1, "USER: three"), ("s", 0, 2, 1, "USER: one"), ("s", 2, 3, 1, "USER: two")]
    rows = [(f"2024-01-01 00:0{m}:00", t) for m, t in ((1, "ERROR x"), (2, "plain"), (9, "[1]"))] + [("2024-01-01 00:59:00", "late end"), ("2024-01-01 02:00:00", "flush")]
    events = spark.createDataFrame(rows, "ts string, text string").select(F.col("ts").cast("timestamp").alias("ts"), "text")
    for i, m in enumerate(rows):
        events.where(F.col("text") == m[1]).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = streams.kind_counts(streams.table_stream(spark, str(tmp_path / "events"), events.schema, 10), "ts")
    streams.write_batches(stream, str(tmp_path / "kinds"), str(tmp_path / "check2")).awaitTermination()
    kinds = {(str(r.start)[11:16], r.kind): r.n for r in spark.read.parquet(str(tmp_path / "kinds")).collect()}
    assert kinds.get(("00:00", "Log")) == 1 and kinds.get(("00:00", "Json")) == 1
    docs = streams.compress_stream(streams.table_stream(spark, str(tmp_path / "events"), events.schema, 10).withColumn("doc_id", F.col("text")))
    streams.write_batches(docs, str(tmp_path / "routed"), str(tmp_path / "check3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "routed")).count() == 5


def test_sql_functions(spark):
    register(spark)
    assert tuple(spark.sql("select loom_is_json('[1]'), loom_is_json('x'), loom_toon('[{\"a\":1},{\"a\":2},{\"a\":3},{\"a\":4}]'), loom_toon_json('a: 1')").first()) == (True, False, "[4]{a}:\n  1\n  2\n  3\n  4", '{"a":1}')


def test_doctor(spark, sf):
    checks = {r.name: r.status for r in doctor(spark, sf).collect()}
    assert checks["workers"] == checks["tables"] == checks["spark"] == "pass" and exit_code(doctor(spark, quick=True)) == 0
    assert {r.name: r.status for r in doctor(spark, "/nowhere").collect()}["tables"] == "fail"
    assert [age_text(s) for s in (5, 65, 7300, 200000)] == ["5s", "1m", "2h", "2d"]


# ---- queries


def test_every_query_runs_and_oracles_agree(spark, sf):
    import duckdb

    from corpusloom import queries

    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings", "conversations", "events", "part"):
        con.sql(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    for name, function in queries.QUERIES.items():
        df = function(spark, sf)
        columns = sorted(df.columns)
        rows = df.select(*columns).collect()
        if name in queries.ORACLES:
            want = con.sql(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
            assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want)), name
        else:
            assert rows, name


def test_results_do_not_depend_on_partitions(spark, sf):
    from corpusloom import queries

    names = ["log_compress", "search_compress", "json_row_selection", "prune_report", "session_digest", "embedding_summary"]
    def run():
        return {n: sorted(map(repr, queries.QUERIES[n](spark, sf).collect())) for n in names}

    first, before = run(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert run() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
