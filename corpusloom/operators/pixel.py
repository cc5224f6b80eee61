"""Dense text as grayscale page images."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.kernels import text_kernel

# The page geometry and the density gate.
GLYPH_WIDTH, GLYPH_HEIGHT, COLUMNS, PAGE_WIDTH, PAGE_HEIGHT = 5, 8, 312, 1568, 728
ROWS_PER_PAGE, MARGIN = PAGE_HEIGHT // GLYPH_HEIGHT, (PAGE_WIDTH - COLUMNS * GLYPH_WIDTH) // 2
DENSE = 2.5
CHUNK = r"[\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}\p{IsWhite_Space}]"


def chars_per_token(text: Column) -> Column:
    """Characters by runs of letters and digits and other signs; infinite for the empty text."""
    chunks = F.greatest(F.regexp_count(text, F.lit(CHUNK)), F.lit(1))
    return F.when(text == "", F.lit(float("inf"))).otherwise(F.length(text).cast("double") / chunks)


def profitable(text: Column) -> Column:
    return (text != "") & (chars_per_token(text) <= DENSE)


def eligible(kind: Column) -> Column:
    """Kinds whose exact letters may get lost."""
    return kind.isin("Json", "Log", "PlainText")


def display_rows(text: Column) -> Column:
    """Lines cut at LF, each wrapped after 312 characters; an empty line is a row."""

    def wrap(line: Column) -> Column:
        n = F.greatest(F.ceil(F.length(line) / COLUMNS).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(line, i * COLUMNS + 1, F.lit(COLUMNS)))

    return F.flatten(F.transform(F.split(text, "\n", -1), wrap))


def page_rows(text: Column) -> Column:
    """Number of display rows, without building them."""
    return F.aggregate(F.split(text, "\n", -1), F.lit(0).cast("long"), lambda s, l: s + F.greatest(F.ceil(F.length(l) / COLUMNS), F.lit(1)))


def pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds rows, pages, width and height of the image of a text."""
    rows = docs.withColumn("rows", page_rows(F.col(text)))
    count = F.greatest(F.ceil(F.col("rows") / ROWS_PER_PAGE), F.lit(1)).cast("long")
    return rows.withColumn("pages", count).withColumn("width", F.lit(PAGE_WIDTH)).withColumn("height", (F.col("pages") * PAGE_HEIGHT).cast("long"))


def glyph(char: str) -> np.ndarray:
    """A 5 x 8 bitmap: blank for white space and controls, else an own pattern with the code point's bits inside a frame."""
    out = np.zeros((GLYPH_HEIGHT, GLYPH_WIDTH), bool)
    if char.isspace() or not char.isprintable():
        return out
    bits = [(ord(char) >> i) & 1 for i in range(21)]
    out[1:7, 1:4] = np.array(bits[:18], bool).reshape(6, 3)
    out[7, 1:4] = bits[18:]
    out[0, 1:4] = True
    return out


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit grayscale PNG."""
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    height, width = pixels.shape
    raw = np.concatenate([np.zeros((height, 1), np.uint8), pixels], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def wrap_text(text: str) -> list[str]:
    return [line[i : i + COLUMNS] for line in text.split("\n") for i in range(0, max(len(line), 1), COLUMNS)]


def render(text: str) -> bytes:
    """Pages below each other in one image."""
    rows = wrap_text(text)
    height = PAGE_HEIGHT * max(1, -(-len(rows) // ROWS_PER_PAGE))
    image = np.full((height, PAGE_WIDTH), 255, np.uint8)
    known: dict[str, np.ndarray] = {}
    for r, row in enumerate(rows):
        if row:
            cells = np.concatenate([known.setdefault(c, glyph(c)) for c in row], axis=1)
            image[r * GLYPH_HEIGHT : (r + 1) * GLYPH_HEIGHT, MARGIN : MARGIN + cells.shape[1]][cells] = 0
    return png(image)


def render_dense(docs: DataFrame, text: str = "text", kind: str = "kind") -> DataFrame:
    """Adds png for texts of an eligible kind that are dense enough, else null."""
    chosen = F.when(eligible(F.col(kind)) & profitable(F.col(text)), F.col(text))
    return docs.withColumn("png", text_kernel(render, "binary")(chosen))
