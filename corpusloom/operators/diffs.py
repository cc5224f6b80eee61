"""Unified diffs: files and hunks within limits, context trimmed around the changes.

One text is one row, so a diff is compressed inside its row by a kernel; `diff_hunks` gives the hunks as a
relation by running counts over the lines.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.kernels import split_lines, text_kernel
from corpusloom.functions.text import lines
from corpusloom.plans.levels import DiffLimits

_AT = r"-\d+(?:,\d+)? "
_NEW = r"\+\d+(?:,\d+)? "
HEADER = r"^diff --(?:git a/.+ b/.+|combined .+|cc .+)$"
HUNK = rf"^(?:@@ {_AT}{_NEW}@@|@@@ {_AT}{_AT}{_NEW}@@@|@@@@ {_AT}{_AT}{_AT}{_NEW}@@@@)"
OLD, NEW = r"^--- (?:a/.+|/dev/null)$", r"^\+\+\+ (?:b/.+|/dev/null)$"
BINARY = r"^Binary files .+ differ$"
# Words that make a hunk a priority.
PRIORITY = [
    r"(?i)\b(error|exception|fail(?:ed|ure)?|fatal|critical|crash|panic)\b",
    r"(?i)\b(important|note|todo|fixme|hack|xxx|bug|fix)\b",
    r"(?i)\b(security|auth|password|secret|token)\b",
]
DENSITY, DENSITY_CAP, CONTEXT_WORD, PRIORITY_BOOST, CAP = 0.03, 0.3, 0.2, 0.3, 1.0
_header, _hunk, _old, _new, _binary = (re.compile(p) for p in (HEADER, HUNK, OLD, NEW, BINARY))
_priority = [re.compile(p) for p in PRIORITY]


@dataclass
class Hunk:
    header: str
    lines: list[str] = field(default_factory=list)
    score: float = 0.0

    def changes(self) -> int:
        return sum(x[:1] in ("+", "-") for x in self.lines)

    def first_line(self) -> int:
        found = re.search(r"\+(\d+)", self.header)
        return int(found[1]) if found else 0


@dataclass
class File:
    header: str
    old: str = ""
    new: str = ""
    hunks: list[Hunk] = field(default_factory=list)
    renames: list[str] = field(default_factory=list)
    flags: set[str] = field(default_factory=set)


def parse_diff(text: str) -> tuple[list[str], list[File]]:
    """Lines before the first file, and the files. Flags and renames count inside hunks too, where their lines also stay."""
    before: list[str] = []
    files: list[File] = []
    for line in split_lines(text):
        if _header.match(line):
            files.append(File(line))
            continue
        if not files:
            before.append(line)
            continue
        f = files[-1]
        if line.startswith("new file mode"):
            f.flags.add("new")
        elif line.startswith("deleted file mode"):
            f.flags.add("deleted")
        elif line.startswith(("rename ", "similarity ", "copy ", "dissimilarity ")):
            f.renames.append(line)
        elif _binary.match(line):
            f.flags.add("binary")
        if _old.match(line):
            f.old = line
        elif _new.match(line):
            f.new = line
        elif _hunk.match(line):
            f.hunks.append(Hunk(line))
        elif f.hunks:
            f.hunks[-1].lines.append(line)
    return before, files


def score_hunk(hunk: Hunk, context_words: list[str]) -> float:
    body = "\n".join(hunk.lines).lower()
    score = min(hunk.changes() * DENSITY, DENSITY_CAP)
    score += sum(CONTEXT_WORD for w in context_words if len(w.encode()) > 2 and w in body)
    return min(score + (PRIORITY_BOOST if any(p.search(body) for p in _priority) else 0.0), CAP)


def select_hunks(hunks: list[Hunk], most: int) -> tuple[list[Hunk], int]:
    """The first, the last and the best of the others, by their place in the new file; and how many went."""
    if len(hunks) <= most:
        return hunks, 0
    first, middle, last = hunks[0], hunks[1:-1], hunks[-1:] if len(hunks) > 1 else []
    room = max(most - 1 - len(last), 0)
    kept = sorted(middle, key=lambda h: -h.score)[:room]
    return sorted([first, *kept, *last], key=Hunk.first_line), len(middle) - len(kept)


def trim_context(hunk: Hunk, context: int) -> list[str]:
    changed = [i for i, x in enumerate(hunk.lines) if x[:1] in ("+", "-")]
    if not changed:
        return hunk.lines[:context]
    keep = {j for i in changed for j in range(max(i - context, 0), min(i + context + 1, len(hunk.lines)))}
    keep |= {i for i, x in enumerate(hunk.lines) if x.startswith("\\")}
    return [hunk.lines[i] for i in sorted(keep)]


def compress_diff(text: str, limits: DiffLimits = DiffLimits(), context: str = "") -> tuple[str, int, int, int, int]:
    """compressed, files_affected, hunks_removed, lines_before, lines_after. A text without a file header stays as it is.

    Of too many files the most changed stay, in that order; files that go are not reported.
    """
    count = len(split_lines(text))
    before, files = parse_diff(text)
    if not files:
        return text, 0, 0, count, count
    words = context.lower().split()
    for f in files:
        for h in f.hunks:
            h.score = score_hunk(h, words)
    if len(files) > limits.max_files:
        files = sorted(files, key=lambda f: -sum(h.changes() for h in f.hunks))[: limits.max_files]
    out, removed = list(before), 0
    for f in files:
        kept, gone = select_hunks(f.hunks, limits.max_hunks_per_file)
        removed += gone
        out += [f.header, *f.renames]
        out += ["new file mode 100644"] if "new" in f.flags else ["deleted file mode 100644"] if "deleted" in f.flags else []
        if "binary" in f.flags:
            out.append("Binary files differ")
            continue
        out += [x for x in (f.old, f.new) if x]
        for h in kept:
            out += [h.header, *trim_context(h, limits.max_context_lines)]
    out.append(f"[{len(files)} files changed" + (f", {removed} hunks omitted" if removed else "") + "]")
    shown = "\n".join(out)
    return shown, len(files), removed, count, len(split_lines(shown))


DIFF_FIELDS = "compressed string, files_affected long, hunks_removed long, lines_before long, lines_after long"


def diff_kernel(limits: DiffLimits = DiffLimits(), context: str = ""):
    return text_kernel(lambda t: compress_diff(t, limits, context), DIFF_FIELDS)


def compress_diffs(docs: DataFrame, limits: DiffLimits = DiffLimits(), context: str = "", text: str = "text") -> DataFrame:
    return docs.withColumn("__d", diff_kernel(limits, context)(F.col(text))).select(*docs.columns, "__d.*")


def diff_hunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a hunk: key, file_no, hunk_no (both from 1), file_header, hunk_header, n_lines, changed, priority, score."""
    rows = docs.select(key, F.posexplode(lines(F.col(text))).alias("line_no", "line"))
    l = F.col("line")
    java = lambda p: "(?s)" + p.replace("$", r"\z")
    head = l.rlike(java(HEADER))
    rows = rows.withColumn("is_file", head.cast("int"))
    by_doc = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("file_no", F.sum("is_file").over(by_doc)).where("file_no > 0")
    role = F.when(F.col("is_file") == 1, "file").when(l.rlike(java(OLD)), "old").when(l.rlike(java(NEW)), "new").when(l.rlike("(?U)" + HUNK), "hunk").otherwise("line")
    rows = rows.withColumn("role", role)
    by_file = Window.partitionBy(key, "file_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hunk_no", F.sum((F.col("role") == "hunk").cast("int")).over(by_file))
    rows = rows.withColumn("file_header", F.first(F.when(F.col("role") == "file", l), ignorenulls=True).over(by_file)).where("hunk_no > 0")
    is_line = F.col("role") == "line"
    low = F.lower(l)
    # a priority word never spans lines, so lines can be tested one by one
    priority = is_line & F.greatest(*[low.rlike(p.replace("(?i)", "(?iU)")) for p in PRIORITY])
    hunks = rows.groupBy(key, "file_no", "hunk_no").agg(
        F.first("file_header").alias("file_header"),
        F.max(F.when(F.col("role") == "hunk", l)).alias("hunk_header"),
        F.sum(is_line.cast("long")).alias("n_lines"),
        F.sum((is_line & l.rlike(r"^[+-]")).cast("long")).alias("changed"),
        F.max(priority).alias("priority"),
    )
    score = F.least(F.lit(CAP), F.least(F.col("changed") * DENSITY, F.lit(DENSITY_CAP)) + F.when(F.col("priority"), PRIORITY_BOOST).otherwise(0.0))
    return hunks.withColumn("score", F.round(score, 6))
