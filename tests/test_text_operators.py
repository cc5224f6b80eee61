"""Line, log, search, diff and prose operators on small known inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.kernels import split_lines
from corpusloom.operators import detect, diffs, line_runs, logs, pixel, prepass, prose, search
from corpusloom.plans import router
from corpusloom.plans.levels import DiffLimits, LogLimits
from corpusloom.sources.io import literal


def one(spark, operator, text, *columns):
    row = operator(literal(spark, text)).first()
    return row[columns[0]] if len(columns) == 1 else tuple(row[c] for c in columns)


TEXTS = ["", "\n", "\r\n", "a", "a\n", "a\r\n", "a\r", "a\n\nb\r\nc\r", "é x\u0085y", "  a. b!c ? d?  ", "...", "1.5 is. ok", "x" * 50, "a b " * 45, "w " * 150 + "end.", "\x1cq\x1d. z"]


def test_lines_match_the_kernel(spark):
    got = literal(spark, *TEXTS).select("doc_id", X.lines(F.col("text")).alias("l")).collect()
    for r in got:
        assert r.l == split_lines(TEXTS[r.doc_id])


def scalar_sentences(text):
    words = prose.split_words(text)
    if words and 100 * len(re.findall("[.!?]", text)) < len(words):
        return [re.sub(r"^\s+|\s+$", "", m) for m in re.findall(r"(?:\S+\s+){0,19}\S+", text)]
    out, start = [], 0
    for i in range(len(text) - 1):
        if text[i] in ".!?" and (text[i + 1].isspace() and text[i + 1] not in "\x1c\x1d\x1e\x1f"):
            out.append(text[start : i + 1])
            start = i + 1
    trim = lambda s: s.strip("".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in "\x1c\x1d\x1e\x1f"))
    return [s for s in map(trim, [*out, text[start:]]) if s]


def test_sentences_match_a_scan(spark):
    rng = random.Random(0)
    texts = TEXTS + ["".join(rng.choice("ab.!? \n é") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    for r in literal(spark, *texts).select("doc_id", X.sentences(F.col("text")).alias("s")).collect():
        assert r.s == scalar_sentences(texts[r.doc_id]), texts[r.doc_id]


def scalar_runs(text):
    out, rows = [], split_lines(text)
    i = 0
    while i < len(rows):
        n = 1
        while i + n < len(rows) and rows[i + n] == rows[i]:
            n += 1
        out += [rows[i] + "\n", f"[... pruned: {n - 1} identical lines collapsed ...]\n"] if n > 5 else [rows[i] + "\n"] * n
        i += n
    return "".join(out)


def test_runs_collapse_over_five(spark):
    assert one(spark, line_runs.collapse_runs, "x\n" * 5, "compressed") == "x\n" * 5
    assert one(spark, line_runs.collapse_runs, "x\n" * 6 + "y", "compressed") == "x\n[... pruned: 5 identical lines collapsed ...]\ny\n"
    rng = random.Random(1)
    texts = TEXTS + ["\n".join(rng.choice(["a", "a", "", "b"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    for r in line_runs.collapse_runs(literal(spark, *texts)).collect():
        assert r.compressed == scalar_runs(r.text)


def test_null_texts(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert line_runs.collapse_runs(df).first().compressed is None
    assert logs.compress_logs(df).first().compressed is None
    assert search.compress_search(df).first().compressed is None
    assert prepass.prepass(df).first().text is None
    assert detect.detect(df).first().kind is None


def test_line_numbers(spark):
    numbered = "\n".join(f"{i}\tline {i}" for i in range(1, 8))
    assert one(spark, prepass.strip_line_numbers, numbered + "\n", "text", "line_numbers_stripped") == ("\n".join(f"line {i}" for i in range(1, 8)) + "\n", True)
    for text in ("1\ta\n2\tb", numbered.replace("3\t", "9\t"), numbered + "\nplain", "", "2\ta\n3\tb\n4\tc\n5\td\n6\te"):
        assert one(spark, prepass.strip_line_numbers, text, "text", "line_numbers_stripped") == (text, False)
    assert one(spark, prepass.strip_line_numbers, "01\ta\r\n2\tb\r\n3\tc\r\n4\td\r\n5\te", "text") == "a\nb\nc\nd\ne"


def test_blobs(spark):
    uri = "data:image/png;base64," + "A" * 30 + "=="
    token = "e" * 203 + "." + "f" * 100
    text = f"a {uri} b {'Q' * 500}= c {token} {'Q' * 499}"
    got, n = one(spark, prepass.strip_blobs, text, "text", "base64_blobs_removed")
    assert got == f"a [... pruned: base64 blob removed, {len(uri)} chars ...] b [... pruned: base64 blob removed, 501 chars ...] c {token} {'Q' * 499}" and n == 2


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ('[1,{"a":2}]', "Json"), ('  {"a":1}\n', "Json"), ('{"a":1} x', "PlainText"), ("[NaN]", "PlainText"), ("[1,2,]", "PlainText"), ('{"a":1,"a":2}', "Json"),
        ("src/a.rs:1: x\nsrc/b.rs:2: y\nother", "SearchResults"), ("diff --git a/x b/x\nerror", "Diff"), ("--- a/x\n+++ b/x\n@@ -1 +1 @@\n-fail\n+ok", "Diff"),
        ("all fine\nERROR: no", "Log"), ("a Warning here", "Log"), ("critical only", "PlainText"), ("éerror", "PlainText"), ("short", "PlainText"), ("", "PlainText"),
        ("<html><body>x</body></html>", 'Other("html")'), ("fn main() {\n    println!();\n}\n", 'Other("rust")'), ("just some words in a line here", "PlainText"),
    ],
)
def test_detection(spark, text, kind):
    assert one(spark, detect.detect, text, "kind") == kind


def test_logs(spark):
    text = "\n".join([f"ERROR: failure number {i}" for i in range(50)] + ["=== 50 failed, 0 passed ==="])
    got, before, after = one(spark, lambda d: logs.compress_logs(d, LogLimits(context_lines=0)), text, "compressed", "lines_before", "lines_after")
    assert before == 51 and after == 10 and got.endswith("[41 lines omitted: 51 error, 0 warn]")
    assert got.split("\n")[:3] == ["ERROR: failure number 0", "ERROR: failure number 1", "ERROR: failure number 2"] and "=== 50 failed" in got
    assert one(spark, logs.compress_logs, "nothing\nhere\n", "compressed") == "nothing\nhere\n"
    context = "\n".join(["a"] * 5 + ["error x"] + ["b"] * 5)
    assert one(spark, logs.compress_logs, context, "compressed") == "a\na\nerror x\nb\nb\n[6 lines omitted: 1 error, 0 warn]"


def scalar_log(text, c):
    rows = split_lines(text)
    level = lambda l: 3 if re.search(r"(?i)\b(error|fatal|critical|fail(ed)?)\b", l) else 2 if re.search(r"(?i)\bwarn(ing)?\b", l) else 1 if l.strip() else 0
    lv, sm = [level(l) for l in rows], [bool(re.match(r"\s*(={3,}|-{3,}|\d+ (passed|failed|skipped)|TOTAL|Summary)", l)) for l in rows]
    score = [(1, 10, 50, 100)[a] + 40 * b for a, b in zip(lv, sm, strict=True)]

    def pick(which, most):
        at = [i for i, x in enumerate(lv) if x == which]
        if len(at) <= most:
            return at
        ends = list(dict.fromkeys([at[0], at[-1]]))
        return ends + sorted((i for i in at if i not in ends), key=lambda i: -score[i])[: max(most - len(ends), 0)]

    chosen = pick(3, c.max_errors) + pick(2, c.max_warnings) + [i for i, s in enumerate(sm) if s]
    if not chosen:
        return text
    near = sorted({j for i in chosen for j in range(max(i - c.context_lines, 0), min(i + c.context_lines + 1, len(rows)))})
    kept = sorted(sorted(near, key=lambda i: -score[i])[: c.max_total_lines])
    out = [rows[i] for i in kept]
    if len(kept) < len(rows):
        out.append(f"[{len(rows) - len(kept)} lines omitted: {lv.count(3)} error, {lv.count(2)} warn]")
    return "\n".join(out)


@pytest.mark.parametrize("limits", [LogLimits(), LogLimits(3, 2, 1, 9), LogLimits(20, 10, 4, 200)])
def test_logs_match_a_scan(spark, limits):
    rng = random.Random(2)
    pool = ["ERROR one", "warn two", "info", "", "=== 3 failed", "Summary", "5 passed", "x", "y", "z", "--- warning"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(50)] + TEXTS
    for r in logs.compress_logs(literal(spark, *texts), limits).collect():
        assert r.compressed == scalar_log(r.text, limits), r.text


def test_no_copies_of_long_texts_are_carried(spark):
    """Lines stay inside one expression, and the router keeps a text given to it only where it may have to give it back."""
    df = spark.createDataFrame([(1, "a:1:x\nb:2:y\na:3:z")], "doc_id long, text string")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    for made in (search.compress_search(df), line_runs.collapse_runs(df), prepass.strip_line_numbers(df), detect.detect(df)):
        assert "AS __lines" not in plan(made) and "AS __begins" not in plan(made)
    assert "__text0" not in plan(router.compress(df)) and "__text0" in plan(router.compress(df, never_grow=True))
    got = router.compress(df).first()
    assert (got.kind, got.compressed, got.chars_before, got.lines_before, got.lines_after) == ("SearchResults", "a:1:x\na:3:z\nb:2:y", 17, 3, 3)


def test_search(spark):
    text = "\n".join(f"a.rs:{i}: hit" for i in range(8)) + "\nnot a match\nb.rs:1: x\na.rs:99: y"
    got = one(spark, search.compress_search, text, "compressed", "lines_before", "lines_after")
    assert got == ("\n".join(f"a.rs:{i}: hit" for i in range(5)) + "\na.rs: 4 more matches omitted\nb.rs:1: x\nnot a match", 11, 8)
    assert one(spark, search.compress_search, "plain\n\ntext", "compressed") == "plain\n\ntext"


def make_diff(files, hunks, body=(" a", "-old", "+new", " b")):
    out = []
    for f in range(files):
        out += [f"diff --git a/f{f} b/f{f}", "index 1..2", f"--- a/f{f}", f"+++ b/f{f}"]
        for h in range(hunks):
            out += [f"@@ -{h * 10 + 1},3 +{h * 10 + 1},3 @@", *body]
    return "\n".join(out)


def test_diffs():
    shown, files, gone, before, after = diffs.compress_diff(make_diff(1, 15))
    assert files == 1 and gone == 5 and shown.count("@@ -") == 10 and shown.endswith("[1 files changed, 5 hunks omitted]") and "index" not in shown
    assert [int(x) for x in re.findall(r"@@ -(\d+)", shown)] == [*range(1, 91, 10), 141]
    shown, files, *_ = diffs.compress_diff(make_diff(25, 1))
    assert files == 20 and shown.endswith("[20 files changed]")
    assert diffs.compress_diff("no diff\nat all") == ("no diff\nat all", 0, 0, 2, 2)
    assert diffs.compress_diff("--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a")[1] == 0
    far = "\n".join(["commit 1", "diff --git a/x b/y", "similarity index 90%", "rename from x", "rename to y", "new file mode 100755", "--- a/x", "+++ b/y", "@@ -1,9 +1,9 @@", *[f" c{i}" for i in range(6)], "-z", "\\ No newline at end of file", *[f" d{i}" for i in range(6)]])
    assert diffs.compress_diff(far)[0].split("\n") == ["commit 1", "diff --git a/x b/y", "similarity index 90%", "rename from x", "rename to y", "new file mode 100644", "--- a/x", "+++ b/y", "@@ -1,9 +1,9 @@", " c4", " c5", "-z", "\\ No newline at end of file", " d0", "[1 files changed]"]
    binary = "diff --git a/i b/i\ndeleted file mode 100644\nBinary files a/i and b/i differ"
    assert diffs.compress_diff(binary)[0] == "diff --git a/i b/i\ndeleted file mode 100644\nBinary files differ\n[1 files changed]"


def test_diff_scores_keep_priority_hunks(spark):
    text = make_diff(1, 12).replace("+new", "+new", 1)
    marked = text.replace("@@ -61,3 +61,3 @@\n a\n-old\n+new", "@@ -61,3 +61,3 @@\n a\n-old\n+new fixme")
    shown = diffs.compress_diff(marked, DiffLimits(max_hunks_per_file=3))[0]
    assert re.findall(r"@@ -(\d+)", shown) == ["1", "61", "111"]
    rows = diffs.diff_hunks(literal(spark, marked)).orderBy("hunk_no").collect()
    assert [r.score for r in rows] == [0.36 if r.hunk_no == 7 else 0.06 for r in rows] and rows[0].n_lines == 4 and rows[0].changed == 2
    words = diffs.compress_diff(text.replace("-old", "-rare", 6).replace("-rare", "-old", 5), DiffLimits(max_hunks_per_file=3), "the rare one")[0]
    assert re.findall(r"@@ -(\d+)", words) == ["1", "51", "111"]


def scalar_minhash(text, n=128):
    best, w = [1 << 64] * n, text.split()
    for s in ([" ".join(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [text]):
        for i in range(n):
            h = i
            for b in s.encode():
                h = (h * 31 + b) % (1 << 64)
            best[i] = min(best[i], h)
    return best


def test_minhash_and_byte_vectors():
    for text in ("the quick brown fox jumps over the lazy dog again", "a b", "é ü ß ö ä x y z"):
        assert prose.minhash(text).tolist() == scalar_minhash(text)
        v, w = [0.0] * 384, text.split()
        for word in w:
            for i, b in enumerate(word.encode()):
                v[(b * 31 + i) % 384] += 1 / len(w)
        norm = sum(x * x for x in v) ** 0.5
        assert prose.byte_vector(text).tolist() == pytest.approx([x / norm for x in v], abs=1e-6)


def test_cascade(spark):
    a = "the committee reviewed the annual budget in detail on monday"
    far = "zyx qwv jkp mnb fgh ddd rrr ttt uuu"
    kept, others, gone = prose.cascade([a, "short one", a, far, a + " again"])
    assert kept == [0, 3] and others == [1] and gone == [2, 4]
    assert prose.cascade([]) == ([], [], [])
    text = f"{a}. Tiny. {a}. {far}."
    row = prose.cascade_dedup(literal(spark, text)).first()
    assert row.compressed == f"{a}. {far}. Tiny." and row.kept_in_order == f"{a}. Tiny. {far}." and (row.kept_count, row.removed_count) == (3, 1)


def test_narrative_shapes(spark):
    rows = [(0, "I remember the day."), (1, "Then she said no."), (2, "My CLIENT left."), (3, "Mine is here."), (4, "Reliability is a concept.")]
    got = prose.sentence_shapes(spark.createDataFrame(rows, "n int, sentence string")).orderBy("n").collect()
    assert [r["shape"] for r in got] == ["Narrative"] * 3 + ["Concept"] * 2


def test_punctuation(spark):
    df = spark.createDataFrame([(0, "hello there how are you fine", [2, 1, 0, 0, 3, 9]), (1, "one two", []), (2, "", [1]), (3, "été ou été", [1, 5, 4])], "n int, text string, labels array<int>")
    got = [r.restored for r in prose.restore_punctuation(df).orderBy("n").collect()]
    assert got == ["Hello, there. How are you? Fine", "One two", "", "Été. Ou: été-"]


def test_pages(spark):
    texts = ["", "a", "x" * 313, "\n" * 200, "ab\n" * 90 + "c" * 624]
    for r in pixel.pages(literal(spark, *texts)).collect():
        rows = pixel.wrap_text(r.text)
        assert r.rows == len(rows) and r.pages == max(1, -(-len(rows) // 91)) and r.height == 728 * r.pages
    shown = literal(spark, texts[2]).select(pixel.display_rows(F.col("text")).alias("r")).first().r
    assert shown == pixel.wrap_text(texts[2])
    image = pixel.render("ab\n\ncd")
    assert image[:8] == b"\x89PNG\r\n\x1a\n" and int.from_bytes(image[16:20], "big") == 1568 and int.from_bytes(image[20:24], "big") == 728


def test_density(spark):
    texts = ['{"a":1,"b":[2,3]}', "long words everywhere continue", "", "a  b"]
    got = literal(spark, *texts).select("doc_id", pixel.chars_per_token(F.col("text")).alias("d"), pixel.profitable(F.col("text")).alias("p")).orderBy("doc_id").collect()
    assert got[0].d == pytest.approx(17 / 17) and got[0].p and not got[1].p and got[2].d == float("inf") and not got[2].p and got[3].d == 2.0
