"""Text as lines, words and sentences: Column builders with exact, engine-independent semantics.

Lines end at LF or CRLF, a trailing line end adds no line and the empty text has none. White space is
Unicode's. Sizes of texts are UTF-8 bytes unless a name says characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BRAND = ""  # a prefix for markers, with a blank at its end


def lines(text: Column) -> Column:
    body = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(body)


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), 1)


def word_total(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, inside one expression: a column of its own would be copied into every row on the way."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(array: Column) -> Column:
    """0 to size - 1; no positions for the empty array."""
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(F.array().cast("array<int>"))


def punctuated_sentences(text: Column) -> Column:
    """Cut after . ! or ? before white space; pieces trimmed; an empty end is dropped."""
    pieces = F.transform(F.split(text, r"(?U)(?<=[.!?])(?=\s)", -1), trim_space)
    return F.filter(pieces, lambda s: s != "")


def word_windows(text: Column, window: int = 20) -> Column:
    """Consecutive groups of `window` words, as slices of the text."""
    return F.regexp_extract_all(text, F.lit(r"(?U)((?:\S+\s+){0,%d}\S+)" % (window - 1)), 1)


def unpunctuated(text: Column) -> Column:
    """Fewer than one mark . ! ? for every hundred words."""
    n, marks = word_total(text), F.regexp_count(text, F.lit("[.!?]"))
    return (n > 0) & (marks * 100 < n)


def sentences(text: Column) -> Column:
    return F.when(unpunctuated(text), word_windows(text)).otherwise(punctuated_sentences(text))


def shingles(words_column: Column, k: int = 5) -> Column:
    """k-word shingles joined by blanks; the whole if there are fewer words."""
    several = F.transform(F.sequence(F.lit(1), F.size(words_column) - k + 1), lambda i: F.array_join(F.slice(words_column, i, k), " "))
    return F.when(F.size(words_column) >= k, several).otherwise(F.array(F.array_join(words_column, " ")))


def replace_sized(text: Column, pattern: str, marker) -> Column:
    """Every match replaced by marker(bytes of the match)."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    joined = F.zip_with(F.split(text, pattern, -1), found, lambda part, match: F.concat(part, F.when(match.isNull(), F.lit("")).otherwise(marker(F.octet_length(match)))))
    return F.array_join(joined, "")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))
