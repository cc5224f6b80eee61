"""License scans: Aho-Corasick over identifier tags and notice phrases, shunting-yard over expressions.

A text is lower-cased (A-Z only) and cut into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`; one automaton
finds every place where the words of a phrase stand consecutively, overlapping places included.
Where it finds the words of the tag `SPDX-License-Identifier`, the expression that follows on that line
is parsed: `with` binds tighter than `and`, `and` than `or`.

The score says how freely the text may be used: 0 without any licence, else the least permissive of
its notices and expressions, where `or` takes the better and `and` the worse side, and `with` an exception
moves halfway towards 1. That all rights are reserved counts only in a text that names no licence, as many licences say so too.

What notices and identifiers there are is a table (licenses.csv, or one of the caller's).
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from importlib.resources import files

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

# The phrases and labels that the contract of the query names.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
UNKNOWN = 0.1
_TAG = "spdx license identifier"
_EXPRESSION = re.compile(rb"spdx-license-identifier\s*:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\s*([()]|[a-z0-9][a-z0-9.+\-]*)", re.I)
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_BINDS = {"or": 1, "and": 2, "with": 3}


@dataclass(frozen=True)
class Rules:
    """Notices (words of a phrase: label), reservations (likewise), identifier families (beginning: label) and how freely a label's text may be used."""

    notices: dict[str, str] = field(default_factory=dict)
    reserves: dict[str, str] = field(default_factory=dict)
    families: dict[str, str] = field(default_factory=dict)
    permissive: dict[str, float] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: Iterable[tuple[str, str, str | None, float | str | None]]) -> Rules:
        """From rows (kind, key, label, permissive) of the kinds notice, reserve, identifier and label."""
        out = cls()
        kinds = {"notice": out.notices, "reserve": out.reserves, "identifier": out.families}
        for kind, key, label, permissive in rows:
            if kind == "label":
                out.permissive[key] = float(permissive)
            elif kind == "identifier":
                out.families[key.lower()] = label
            else:
                kinds[kind][" ".join(key.encode().translate(_KEEP).decode("latin-1").split())] = label
        return out

    def label(self, identifier: str) -> str:
        """The family label of an identifier, by its beginning; the longest that fits counts, an unknown one is its own label."""
        name = identifier.lower()
        fits = [name[:n] for n in range(1, len(name) + 1) if (n == len(name) or name[n] in "-.+") and name[:n] in self.families]
        return self.families[fits[-1]] if fits else name

    def score(self, label: str) -> float:
        return self.permissive.get(label, UNKNOWN)


def _own_rules() -> Rules:
    lines = files(__package__).joinpath("licenses.csv").read_text(encoding="utf-8").splitlines()
    return Rules.of(tuple(r.values()) for r in csv.DictReader(lines))


RULES = _own_rules()
#: Rows of a caller's table of rules, which goes to the driver and into every task.
MOST_RULES = 100_000


def rules_of(table: DataFrame) -> Rules:
    """Rules from a table (kind, key, label, permissive); one of more than MOST_RULES rows is refused."""
    rows = table.select("kind", "key", "label", "permissive").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return Rules.of(tuple(r) for r in rows)


def tokens_of(expression: str) -> list[str]:
    """Parentheses and words up to the first character that is part of neither."""
    out, at = [], 0
    while found := _TOKEN.match(expression, at):
        out.append(found[1])
        at = found.end()
    return out


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: the identifiers and operators of a licence expression in postfix order; stops at the first misfit."""
    out: list[str] = []
    waiting: list[str] = []
    operand = True  # whether an operand comes next
    for token in tokens_of(expression):
        low = token.lower()
        if operand:
            if token == "(":
                waiting.append(token)
            elif token == ")" or low in _BINDS:
                break
            else:
                out.append(token)
                operand = False
        elif low in _BINDS:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand = True
        elif token == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                break
            waiting.pop()
        else:
            break
    if operand and waiting and waiting[-1] in _BINDS:
        waiting.pop()
    return out + [w for w in reversed(waiting) if w != "("]


def evaluate(expression: str, rules: Rules = RULES) -> tuple[list[str], float | None]:
    """Labels of a licence expression and how freely it may be used; (none, None) if it names no licence."""
    stack: list[tuple[list[str], float]] = []
    for token in to_postfix(expression):
        if token not in _BINDS:
            label = rules.label(token)
            stack.append(([label], rules.score(label)))
            continue
        right = stack.pop()
        left = stack.pop() if stack else ([], 1.0)
        if token == "with":  # the right side names an exception, not a licence
            stack.append((left[0], (left[1] + 1) / 2))
        else:
            stack.append((left[0] + right[0], (max if token == "or" else min)(left[1], right[1])))
    if not stack:
        return [], None
    return [x for labels, _ in stack for x in labels], min(s for _, s in stack)


class Scanner:
    """One automaton for the phrases of the contract, the rules' notices and reservations, and the tag."""

    def __init__(self, rules: Rules = RULES):
        self.rules = rules
        self.found = ahocorasick.Automaton()
        for phrase in {**rules.notices, **rules.reserves, **BASE_PHRASES, _TAG: ""}:
            self.found.add_word(f" {phrase} ", (phrase, phrase.count(" ") + 1))
        self.found.make_automaton()

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score of one text, in time linear in its length."""
        rules = self.rules
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.translate(_KEEP).split()
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        base, named, reserved, starts, tagged = set(), set(), set(), [], False
        spaces = at = 0
        for end, (phrase, n) in self.found.iter(line):
            spaces, at = spaces + line.count(" ", at, end), end  # words up to the phrase's last
            if phrase == _TAG:
                tagged = True
            elif phrase in BASE_PHRASES:
                base.add(BASE_PHRASES[phrase])
                starts.append(spaces - n)
            elif phrase in rules.notices:
                named.add(rules.notices[phrase])
            else:
                reserved.add(rules.reserves[phrase])
        labels = base | named
        scores = [rules.score(x) for x in labels]
        if tagged:
            for found in _EXPRESSION.findall(raw):
                stated, score = evaluate(found.decode("utf-8", "replace"), rules)
                labels.update(stated)
                if score is not None:
                    scores.append(score)
        if not labels:
            labels, scores = reserved, [rules.score(x) for x in reserved]
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(scores, default=0.0)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan(docs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of `docs` (doc_id, text).

    A null or empty text has no words, empty labels and score 0; a null doc_id stays null; repeated rows give repeated
    rows. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """

    def run(batches):
        scanner = Scanner(rules)
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*found, strict=True)) if found else [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(_SCHEMA)[1:], strict=True))], schema=_SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
