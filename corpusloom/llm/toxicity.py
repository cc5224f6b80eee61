"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Channel: a writer hides letters as look-alike digits and signs, spaces or dots letters apart, and
repeats letters. A hidden word is a lattice of what each of its characters may stand for; Viterbi
decoding under a character trigram model picks its likeliest reading. A plain word with doubled letters is read as it is and as
decoded, where a pair may stand for one letter. Four or more characters apart are a run of any
length, read both as one word and with the likeliest word breaks. The model counts the trigrams
of all words of the corpus. Plain words read as themselves and skip the lattice.

Score: of the restored words, those whose beginning or whole is far commoner in toxic documents are
evidence, weighted by log odds. A logistic regression turns the strongest, the sum and the number of them into a
probability; it is fitted on evidence that the other half of the training rows supplied.

The classifier learns from at most `TRAIN_ROWS` labelled documents, the first in MD5 order of doc_id; the character
model counts everything. The evidence that the driver gathers is bounded by those documents' words.
"""

from __future__ import annotations

import math
import os
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import materialize, partitions, release

TRAIN_ROWS = 8000
PREFIXES = (4, 5)
CUTOFF = 0.7
#: A word is evidence if so many toxic training rows and such a share of them have it, its log odds and its G statistic are above these.
LEAST_ROWS, LEAST_SHARE, LEAST_ODDS, LEAST_G = 3, 0.01, 2.0, 20.0
#: What a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
    "+": "t", "(": "c", "€": "e", "£": "l", "¢": "c", "¡": "i", "%": "x", "#": "h",
}
SEPARATORS = ".-_*~'`,:/\\"
_SIGNS = re.compile("[" + re.escape("".join(LOOKALIKES)) + "]")
_LETTER = re.compile(r"[^\W\d_]")
_RUN = re.compile(r"(.)\1\1")
_PAIR = re.compile(r"(.)\1")
_SPLIT = re.compile(r"[\W\d_]+")
_EDGES = ".,;:!?\"'()[]{}<>«»“”„¿¡-_*~`/\\"
#: Signs at a word's edges that stand for no letter.
_PLAIN_EDGES = "".join(c for c in _EDGES if c not in LOOKALIKES)
#: Longer parts are read as several words too.
_LONGEST = 40
_SETTLE = 64
_REMEMBERED = 20_000
_PIECE = 1 << 20
_CODES = np.zeros(256, np.int32)
_CODES[97:123] = np.arange(1, 27)
_CODES[65:91] = np.arange(1, 27)
_CODES[128:] = 27
LETTERS = 28
READ_COST, KEEP_RUN, SHRINK_PAIR, DROP_COST = 0.5, 0.7, 4.0, 4.0


def code(char: str) -> int:
    return ord(char) - 96 if "a" <= char <= "z" else 27 if ord(char) >= 128 else 0


def _trigrams(batches):
    total = np.zeros(LETTERS**3, np.int64)

    def count(raw: bytes) -> None:
        for at in range(0, len(raw) - 2, _PIECE):  # pieces share two letters
            c = _CODES[np.frombuffer(raw, np.uint8, min(_PIECE + 2, len(raw) - at), at)]
            before = np.where(c[1:-1] == 0, 0, c[:-2])
            total[:] += np.bincount((before * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=LETTERS**3)

    for batch in batches:
        held, size = [], 0
        for text in batch.column(0):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            held.append(raw)
            size += len(raw)
            if size > _PIECE:
                count(b"\n\n" + b"\n\n".join(held) + b"\n")
                held, size = [], 0
        count(b"\n\n" + b"\n\n".join(held) + b"\n")
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log P(letter | two letters before) over the 28 letter classes, from all texts; at most 28 ** 3 counts go to the driver."""
    counted = docs.select(text).mapInArrow(_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((LETTERS,) * 3)
    for row in counted:
        counts.ravel()[row["gram"]] = row["n"]
    two = counts.sum(0) + 0.5
    two /= two.sum(1, keepdims=True)
    return np.log((counts + 8 * two[None]) / (counts.sum(2, keepdims=True) + 8))


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of one character, its readings and their costs."""
    out, at = [], 0
    while at < len(word):
        end = at
        while end < len(word) and word[end] == word[at]:
            end += 1
        char, n = word[at], end - at
        reads = [(x, READ_COST) for x in LOOKALIKES[char]] if char in LOOKALIKES else [(char, 0.0)] if _LETTER.match(char) else []
        options = []
        for letter, cost in reads:
            if n == 1:
                options.append((letter, cost))
            elif n == 2:
                options += [(letter * 2, 2 * cost), (letter, cost + SHRINK_PAIR)]
            else:
                options += [(letter, cost + KEEP_RUN), (letter * 2, cost + KEEP_RUN)]
        if not reads or char in LOOKALIKES:
            options.append(("", DROP_COST if reads else 0.0))
        out.append(options)
        at = end
    return out


def _broken(options: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """The readings, and the same with a word break before them or inside a pair."""
    inside = [(f"{t[0]} {t[1]}", c) for t, c in options if len(t) == 2]
    return [*options, *inside, *((f" {t}", c) for t, c in options + inside)]


def decode(word: str, model: np.ndarray, breaks: bool = False) -> str:
    """The likeliest reading of an obfuscated word (Viterbi over pairs of letters); with `breaks`, of a run of words.

    What all states begin with is settled as the pass goes, so that time is linear in the length.
    """
    states, settled = {(0, 0): (0.0, "")}, []
    for at, options in enumerate(lattice(word)):
        if breaks:
            options = _broken(options)
        if at % _SETTLE == _SETTLE - 1:
            shared = os.path.commonprefix([t for _, t in states.values()])
            settled.append(shared)
            states = {k: (v, t[len(shared) :]) for k, (v, t) in states.items()}
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in states.items():
            for letters, cost in options:
                x, y, s = a, b, score - cost
                for letter in letters:
                    z = code(letter)
                    s += model[x, y, z]
                    x, y = (y, z) if z else (0, 0)
                if (x, y) not in new or new[x, y][0] < s:
                    new[x, y] = (s, text + letters)
        states = new
    return "".join(settled) + max((score + model[a, b, 0], text) for (a, b), (score, text) in states.items())[1]


def single(token: str) -> str:
    """The one character that a token is, punctuation around it apart; empty if it has more."""
    bare = token.strip(_EDGES)
    return bare if len(bare) == 1 else token if len(token) == 1 else ""


@dataclass
class Reader:
    """Restores words; the last decoded ones are remembered, which changes no result."""

    model: np.ndarray
    seen: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def read(self, word: str) -> tuple[str, ...]:
        """The words that one token stands for."""
        bare = word.strip(_PLAIN_EDGES)
        if bare.isalpha() and not _PAIR.search(bare):
            return (bare,)
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) >= _REMEMBERED:
                self.seen.clear()
            got = self.seen[word] = self._restore(word, bare)
        return got

    def _restore(self, word: str, bare: str) -> tuple[str, ...]:
        if not _LETTER.search(word):
            return tuple(p for p in _SPLIT.split(bare) if p)
        if bare.isalpha() and not _RUN.search(bare):
            return (bare, decode(bare, self.model))
        parts = [p for p in re.split("[" + re.escape(SEPARATORS) + "]+", bare) if p]
        if len(parts) >= 4 and all(len(p) == 1 for p in parts):
            return tuple(sorted(self.spaced("".join(parts))))
        out = []
        for part in parts:
            if _LETTER.search(part) and (_SIGNS.search(part) or _RUN.search(part)):
                out.append(decode(part, self.model))
                if len(part) > _LONGEST:  # may hold several words
                    out += [p for p in _SPLIT.split(part) if p]
                    out += decode(part, self.model, True).split()
                plain = part.strip(_EDGES)
                if plain != part and plain.isalpha():  # the signs may be punctuation
                    out.append(decode(plain, self.model) if _RUN.search(plain) else plain)
            else:
                out += [p for p in _SPLIT.split(part) if p]
        return tuple(out)

    def spaced(self, run: str) -> set[str]:
        """Readings of letters that were apart: as one word, and as several."""
        if not _LETTER.search(run):
            return set()
        return {decode(run, self.model), *decode(run, self.model, True).split()}

    def words(self, text: str | None) -> tuple[set[str], int]:
        """Distinct restored words of a text and its number of tokens."""
        tokens = (text or "").lower().split()
        found: set[str] = set()
        for token in set(tokens):
            if token.isalpha() and not _PAIR.search(token):
                found.add(token)
            else:
                found.update(self.read(token))
        singles = [single(t) if len(t) == 1 or not t.isalpha() else "" for t in tokens]
        lengths = bytes([1 if t else 0 for t in singles])
        at = lengths.find(b"\1\1\1\1")
        while at >= 0:
            end = lengths.find(b"\0", at)
            end = len(tokens) if end < 0 else end
            found.update(self.spaced("".join(singles[at:end])))
            at = lengths.find(b"\1\1\1\1", end)
        return found, len(tokens)


def features(word: str) -> list[str]:
    return [word] + [f"{word[:k]}~" for k in PREFIXES if len(word) > k]


@dataclass
class Model:
    letters: np.ndarray
    weights: dict[str, float]
    fit: tuple[float, ...]


def evidence(words: set[str], n: int, weights: dict[str, float]) -> tuple[float, float, float]:
    hits = []
    for word in words:
        best = max(weights.get(word, 0.0), weights.get(word[:4] + "~", 0.0), weights.get(word[:5] + "~", 0.0))
        if best:
            hits.append(best)
    return (max(hits), math.log1p(sum(hits)), math.log1p(len(hits))) if hits else (0.0, 0.0, 0.0)


def _count(letters: np.ndarray):
    def run(batches):
        reader, counts = Reader(letters), {}
        for batch in batches:
            for text, toxic, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, _ = reader.words(text)
                for feature in {f for w in words for f in features(w)}:
                    counts.setdefault(feature, [0, 0, 0, 0])[2 * half + (1 - toxic)] += 1
        names = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[f][k] for f in names], pa.int64()) for k in range(4))], ["feature", "p0", "n0", "p1", "n1"])

    return run


def _log_odds(p: float, n: float, pos: float, neg: float) -> float:
    """Log odds of a feature if it marks toxic documents significantly and often enough, else 0."""
    if p < max(LEAST_ROWS, LEAST_SHARE * pos) or pos < 1 or neg < 1:
        return 0.0
    odds = math.log((p + 0.5) / (pos + 1)) - math.log((n + 0.5) / (neg + 1))
    total, share = p + n, pos / (pos + neg)
    g = 2 * (p * math.log(p / (total * share)) + (n * math.log(n / (total * (1 - share))) if n else 0.0))
    return min(odds, 8.0) if odds > LEAST_ODDS and g > LEAST_G else 0.0


def _evidence_rows(letters, weights):
    def run(batches):
        reader = Reader(letters)
        for batch in batches:
            rows = []
            for text, toxic, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, n = reader.words(text)
                rows.append((*evidence(words, n, weights[1 - half]), toxic))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.float64()) for k in range(4)], ["top", "total", "hits", "toxic"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights (the constant first) of a ridge logistic regression, by Newton steps."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1)) * 10
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, letters: np.ndarray | None = None, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from the documents (doc_id, text) that `labels` (doc_id, toxic) marks 0 or 1.

    Labels without a document, of null documents and of other values teach nothing; of a document's several labels the greatest
    counts, of rows that share a doc_id the least text. Without labels of both kinds, all scores are the smoothed share of toxic rows.
    """
    letters = character_model(docs) if letters is None else letters
    key = F.md5(F.col("doc_id").cast("string"))
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(key, "doc_id").limit(train_rows)
    half = (F.conv(F.substring(key, 32, 1), 16, 10).cast("int") % 2).alias("half")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = materialize(rows.select("text", "toxic", half).repartition(partitions(docs.sparkSession)), "train")
    sizes = {(r["half"], r["toxic"]): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}
    pos, neg = ([sizes.get((h, y), 0) for h in (0, 1)] for y in (1, 0))
    if not sum(pos) or not sum(neg):
        release(rows)
        share = (sum(pos) + 0.5) / (sum(pos) + sum(neg) + 1)
        return Model(letters, {}, (math.log(share / (1 - share)), 0.0, 0.0, 0.0))
    counted = rows.mapInArrow(_count(letters), "feature string, p0 long, n0 long, p1 long, n1 long").groupBy("feature")
    counted = counted.agg(*(F.sum(c).alias(c) for c in ("p0", "n0", "p1", "n1")))
    # all that can be evidence, in all rows or in a half of them
    marks = F.lit(False)
    for p, n, has, lacks in [(F.col("p0"), F.col("n0"), pos[0], neg[0]), (F.col("p1"), F.col("n1"), pos[1], neg[1]), (F.col("p0") + F.col("p1"), F.col("n0") + F.col("n1"), sum(pos), sum(neg))]:
        marks |= (p >= max(LEAST_ROWS, LEAST_SHARE * has)) & (F.log((p + 0.5) / (has + 1)) - F.log((n + 0.5) / (lacks + 1)) > LEAST_ODDS - 0.01)
    best = counted.where(marks).orderBy("feature").collect()
    halves = [{r["feature"]: w for r in best if (w := _log_odds(r[f"p{h}"], r[f"n{h}"], pos[h], neg[h]))} for h in (0, 1)]
    weights = {r["feature"]: w for r in best if (w := _log_odds(r["p0"] + r["p1"], r["n0"] + r["n1"], sum(pos), sum(neg)))}
    seen = np.array([tuple(r) for r in rows.mapInArrow(_evidence_rows(letters, halves), "top double, total double, hits double, toxic double").collect()])
    release(rows)
    return Model(letters, weights, tuple(logistic(seen[:, :3], seen[:, 3])))


def probability(text: str | None, model: Model, reader: Reader) -> float:
    words, n = reader.words(text)
    seen = evidence(words, n, model.weights)
    z = model.fit[0] + sum(w * x for w, x in zip(model.fit[1:], seen, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all) of `docs` and `out`: the probability that the text is toxic.

    Null texts count as empty; a null doc_id or a repeated row is scored like any; a column that has the name `out` is replaced.
    """
    kept = [f for f in docs.schema.fields if f.name != out and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, T.StructField(out, T.DoubleType())])
    names = [f.name for f in schema.fields]

    def run(batches):
        reader = Reader(model.letters)
        for batch in batches:
            found = [probability(t.as_py(), model, reader) for t in batch.column(batch.schema.get_field_index(text))]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64())], names)

    return docs.mapInArrow(run, schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: crc32 of doc_id as text, modulo 3, is not 1."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    scored = score(docs.select("doc_id", "text"), model, out="score", keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
