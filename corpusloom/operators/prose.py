"""Prose: sentences, shingles, MinHash, byte vectors and the cascade of near-duplicate sentences."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.kernels import column_kernel, text_kernel
from corpusloom.functions.text import sentences, shingles, trim_space, word_total, words

MIN_WORDS, MAX_WORDS, WINDOW = 8, 40, 20
HASHES, DIM, SHINGLE = 128, 384, 5
SAME_SLOTS = 103  # more than 0.8 of 128
SIMILAR = np.float32(0.8)
_BLOCK = 512
#: Sentences that a kernel gives at a time, with their vectors some 3 MB.
SENTENCES = 2048
NARRATIVE = (
    r"(?iU)\b(I had|I remember|I once|I worked with|I saw|I met|there was a|there was an|she said|he said|they said|told me"
    r"|my (client|patient|daughter|son|friend|colleague)|years ago|one day|a client of mine)\b"
)
#: Python's white space has the separators \x1c to \x1f, Unicode's has not.
_separators = re.compile("[\x1c-\x1f]")
_words = re.compile(r"(?:[^\s]|[\x1c-\x1f])+")


def split_words(text: str) -> list[str]:
    return _words.findall(text) if _separators.search(text) else text.split()


def sentence_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sent_no (from 0), sentence, n_words."""
    rows = docs.select(key, F.posexplode(sentences(F.col(text))).alias("sent_no", "sentence"))
    return rows.withColumn("n_words", word_total(F.col("sentence")).cast("long"))


def sentence_shapes(rows: DataFrame) -> DataFrame:
    """Adds shape: Narrative for reported speech and first-person openers, else Concept."""
    return rows.withColumn("shape", F.when(F.col("sentence").rlike(NARRATIVE), "Narrative").otherwise("Concept"))


def sentence_shingles(rows: DataFrame, key: str = "doc_id", k: int = SHINGLE) -> DataFrame:
    """key, sent_no, shingle_no, shingle of the sentences that take part in the cascade."""
    fit = rows.where(F.col("n_words").between(MIN_WORDS, MAX_WORDS)).withColumn("__w", words(F.col("sentence")))
    return fit.select(key, "sent_no", F.posexplode(shingles(F.col("__w"), k)).alias("shingle_no", "shingle"))


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers_of_31(n: int) -> tuple[np.ndarray, np.ndarray]:
    """31 ** i and its inverse modulo 2 ** 64."""
    global _powers
    if len(_powers[0]) < n:
        up, down = np.full(max(n, 1 << 14), 31, np.uint64), np.full(max(n, 1 << 14), pow(31, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers


def minhashes(texts: list[str], n: int = HASHES) -> np.ndarray:
    """A row for each text: the least h_i(s) over its shingles s (the text itself if it has fewer words).

    h_i folds bytes by h * 31 + b from i, so h_i(s) = h_0(s) + i * 31 ** len(s); h_0 of all shingles
    comes from one running sum over the bytes of all texts.
    """
    parts, starts, ends, counts, at = [], [], [], [], 0
    for text in texts:
        words_ = [w.encode() for w in split_words(text)]
        raw = b" ".join(words_) if len(words_) >= SHINGLE else text.encode()
        if len(words_) >= SHINGLE:
            sizes = np.fromiter(map(len, words_), np.int64, len(words_))
            stop = np.cumsum(sizes + 1) - 1 + at
            starts.append((stop - sizes)[: len(words_) - SHINGLE + 1])
            ends.append(stop[SHINGLE - 1 :])
        else:
            starts.append(np.array([at]))
            ends.append(np.array([at + len(raw)]))
        counts.append(len(starts[-1]))
        parts.append(raw)
        at += len(raw)
    if not texts:
        return np.zeros((0, n), np.uint64)
    up, down = _powers_of_31(at + 1)
    sums = np.zeros(at + 1, np.uint64)
    np.cumsum(np.frombuffer(b"".join(parts), np.uint8) * down[:at], out=sums[1:])
    start, end = np.concatenate(starts), np.concatenate(ends)
    zero = np.where(end > start, (sums[end] - sums[start]) * up[np.maximum(end - 1, 0)], np.uint64(0))
    power, seeds = up[end - start], np.arange(n, dtype=np.uint64)
    first = np.concatenate([[0], np.cumsum(counts)])
    out, i = np.empty((len(texts), n), np.uint64), 0
    while i < len(texts):  # some thousand shingles at a time
        j = max(i + 1, int(np.searchsorted(first, first[i] + 4096, side="right")) - 1)
        part = slice(first[i], first[j])
        h = zero[part, None] + seeds[None] * power[part, None]
        out[i:j] = np.minimum.reduceat(h, first[i:j] - first[i], axis=0)
        i = j
    return out


def minhash(sentence: str, n: int = HASHES) -> np.ndarray:
    return minhashes([sentence], n)[0]


def byte_vectors(texts: list[str]) -> np.ndarray:
    """A unit row of 384 buckets for each text: byte b at place i of a word counts in (31 b + i) mod 384, by 1 / words."""
    owners, sizes, shares, raw = [], [], [], []
    for t, text in enumerate(texts):
        words_ = [w.encode() for w in split_words(text)]
        sizes += map(len, words_)
        owners += [t] * len(words_)
        shares += [1 / len(words_)] * len(words_) if words_ else []
        raw += words_
    size = np.array(sizes, np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    place = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    bucket = np.repeat(np.array(owners, np.int64), size) * DIM + (data * 31 + place) % DIM
    out = np.bincount(bucket, np.repeat(np.array(shares, np.float64), size), len(texts) * DIM).reshape(len(texts), DIM).astype(np.float32)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def byte_vector(sentence: str) -> np.ndarray:
    return byte_vectors([sentence])[0]


def minhash_signatures(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, sent_no, signature (unsigned 64-bit values as signed) of the sentences that take part in the cascade."""
    kernel = column_kernel(lambda texts: list(minhashes(texts).view(np.int64)), "array<long>")
    fit = rows.where(F.col("n_words").between(MIN_WORDS, MAX_WORDS))
    return fit.select(key, "sent_no", kernel(F.col("sentence")).alias("signature"))


def cascade(pieces: list[str]) -> tuple[list[int], list[int], list[int]]:
    """Places of the sentences that stay: those compared, then those too short or long; and of those that go.

    In order, a sentence that stays removes all later ones that share over 0.8 of its MinHash slots or whose
    vectors have a cosine over 0.8 with its own.
    """
    return _cascade(pieces)[:3]


def _cascade(pieces: list[str]) -> tuple[list[int], list[int], list[int], np.ndarray]:
    """What `cascade` gives, and the vectors of the compared sentences that stay."""
    counts = [len(split_words(p)) for p in pieces]
    fit = [i for i, n in enumerate(counts) if MIN_WORDS <= n <= MAX_WORDS]
    others = [i for i, n in enumerate(counts) if not MIN_WORDS <= n <= MAX_WORDS]
    if not fit:
        return [], others, [], np.zeros((0, DIM), np.float32)
    texts = [pieces[i] for i in fit]
    sig, vec = minhashes(texts), byte_vectors(texts)
    alive, kept = np.ones(len(fit), bool), []
    for low in range(0, len(fit), _BLOCK):  # similarities of a block of sentences to all later ones
        block = slice(low, low + _BLOCK)
        if not alive[block].any():
            continue
        near = vec[block] @ vec[low:].T > SIMILAR
        for i in range(low, min(low + _BLOCK, len(fit))):
            if alive[i]:
                kept.append(fit[i])
                later = np.flatnonzero(alive[i + 1 :]) + i + 1
                if len(later):
                    alive[later[near[i - low, later - low]]] = False
                    later = later[alive[later]]
                    alive[later[(sig[later] == sig[i]).sum(1) >= SAME_SLOTS]] = False
    return kept, others, [fit[i] for i in np.flatnonzero(~alive)], vec[alive]


def cascade_text(pieces: list[str]) -> tuple[str, str, int, int]:
    """compressed (document order is lost: compared sentences first), the same in document order, kept_count, removed_count."""
    kept, others, gone = cascade(pieces)
    return " ".join(pieces[i] for i in kept + others), " ".join(pieces[i] for i in sorted(kept + others)), len(kept) + len(others), len(gone)


CASCADE_FIELDS = "compressed string, kept_in_order string, kept_count long, removed_count long"


def cascade_kernel():
    """A column function of an array of sentences."""
    return text_kernel(lambda pieces: cascade_text(list(pieces)), CASCADE_FIELDS)


def cascade_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the fields of CASCADE_FIELDS; one row's sentences are compared inside that row."""
    return docs.select(key, cascade_kernel()(sentences(F.col(text))).alias("c")).select(key, "c.*")


def kept_batches(batches, include_embedding: bool = False, most: int = SENTENCES):
    """Rows (key, place, sent_no, sentence, embedding), at most `most` in a batch, of the sentences that stay of rows (key, sentences)."""
    for batch in batches:
        owners, places, numbers, texts, vectors = [], [], [], [], []

        def flush(keys=batch.column(0)):
            ends = np.cumsum([0] + [0 if v is None else DIM for v in vectors])
            there = [v for v in vectors if v is not None]
            values = pa.array(np.concatenate(there) if there else np.zeros(0, np.float32), pa.float32())
            embedding = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([v is None for v in vectors]))
            columns = [keys.take(pa.array(owners, pa.int64())), pa.array(places, pa.int32()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), embedding]
            for held in (owners, places, numbers, texts, vectors):
                held.clear()
            return pa.RecordBatch.from_arrays(columns, ["key", "place", "sent_no", "sentence", "embedding"])

        for i in range(batch.num_rows):
            pieces = batch.column(1)[i].as_py() or []
            kept, others, _, compared = _cascade(pieces)
            for place, number in enumerate(kept + others):
                owners.append(i)
                places.append(place)
                numbers.append(number)
                texts.append(pieces[number])
                vectors.append(compared[place] if include_embedding and place < len(kept) else None)
                if len(owners) == most:
                    yield flush()
        if owners:
            yield flush()


def kept_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", include_embedding: bool = False) -> DataFrame:
    """key, place, sent_no, sentence, shape, embedding (null unless asked for, or not compared) of the sentences that stay.

    The kernel gives a row for each sentence, some thousand at a time, so no task holds the vectors of all its texts.
    """
    rows = docs.select(F.col(key).alias("key"), sentences(F.col(text)).alias("s"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(lambda batches: kept_batches(batches, include_embedding), f"key {kind}, place int, sent_no int, sentence string, embedding array<float>")
    return sentence_shapes(out.withColumnRenamed("key", key)).select(key, "place", "sent_no", "sentence", "shape", "embedding")


def word_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 300) -> DataFrame:
    """key, chunk, words: groups of `size` words for a model that labels words; its labels come back by (key, chunk)."""
    rows = docs.select(key, words(F.col(text)).alias("w"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int")), lambda i: F.slice("w", i * size + 1, size))
    return rows.where(F.size("w") > 0).select(key, F.posexplode(cut).alias("chunk", "words"))


def restore_punctuation(docs: DataFrame, text: str = "text", labels: str = "labels", out: str = "restored", marks=("", ".", ",", "?", "-", ":")) -> DataFrame:
    """Words joined by blanks, each with its label's mark; the first word and words after . or ? get a capital."""
    rows = docs.withColumn("__w", words(F.col(text)))
    table = F.array(*[F.lit(m) for m in marks])
    of = lambda i: F.coalesce(F.get(table, F.get(F.col(labels), i)), F.lit(""))

    def word(w, i):
        capital = (i == 0) | of(F.greatest(i - 1, F.lit(0))).isin(".", "?")
        shown = F.when(capital, F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))).otherwise(w)
        return F.concat(shown, of(i))

    return rows.withColumn(out, F.array_join(F.transform("__w", word), " ")).drop("__w")


def trimmed(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn(text, trim_space(F.col(text)))
