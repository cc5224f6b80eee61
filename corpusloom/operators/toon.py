"""Token-oriented object notation: JSON as indented text, with tables for uniform arrays of flat objects.

Numbers are written in plain decimal with at most 12 decimals, so floats beyond that and the
difference of 1 and 1.0 do not survive; everything else does. An empty object or array as the first
field of a list item is written `- k:` and `- k: []`, which the decoder reads back.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.kernels import split_lines, text_kernel
from corpusloom.functions.strict_json import minified, parse

INDENT = "  "
_numeric = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?(?:e[+-]?[0-9]+)?", re.I)
_special = re.compile(r'[:"\\\[\]{},\x00-\x1f]')
_named = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def number(value: int | float) -> str:
    if isinstance(value, int):
        return str(value)
    if value == 0:
        return "0"
    if not 1e-6 <= abs(value) < 1e21:
        return format(Decimal(repr(value)), "f").removesuffix(".0")
    return f"{value:.12f}".rstrip("0").rstrip(".")


def quoted(text: str) -> bool:
    return (
        text in ("", "true", "false", "null")
        or text[0] in " \t-#"
        or text[-1] in " \t"
        or _numeric.fullmatch(text) is not None
        or _special.search(text) is not None
    )


def scalar(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return number(value)
    if not quoted(value):
        return value
    return '"' + "".join(_named.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in value) + '"'


def _flat(value) -> bool:
    return not isinstance(value, (dict, list))


def _table_fields(items: list) -> list[str] | None:
    if len(items) < 2 or not all(isinstance(x, dict) for x in items):
        return None
    names = list(items[0])
    same = all(len(x) == len(names) and all(k in x and _flat(x[k]) for k in names) for x in items)
    return names if same else None


def _object(value: dict, level: int) -> list[str]:
    return [line for k, v in value.items() for line in _field(k, v, level)]


def _field(name: str, value, level: int) -> list[str]:
    pad = INDENT * level
    if isinstance(value, dict):
        return [f"{pad}{name}:", *_object(value, level + 1)]
    if isinstance(value, list):
        return _array(value, level, name) if value else [f"{pad}{name}: []"]
    return [f"{pad}{name}: {scalar(value)}"]


def _array(items: list, level: int, name: str = "") -> list[str]:
    head = f"{INDENT * level}{name}[{len(items)}]"
    if (names := _table_fields(items)) is not None:
        return [f"{head}{{{','.join(names)}}}:", *(INDENT * (level + 1) + ",".join(scalar(x[k]) for k in names) for x in items)]
    if all(map(_flat, items)):
        return [f"{head}: {','.join(map(scalar, items))}"]
    return [f"{head}:", *(line for x in items for line in _item(x, level + 1))]


def _item(value, level: int) -> list[str]:
    dash = INDENT * level + "-"
    if isinstance(value, dict):
        if not value:
            return [dash]
        (first, inner), *others = value.items()
        if isinstance(inner, dict):
            head = [f"{dash} {first}:", *_object(inner, level + 2)]
        elif isinstance(inner, list) and inner:
            top, *below = _array(inner, level + 1, first)
            head = [f"{dash} {top.lstrip()}", *below]
        else:
            head = [f"{dash} {first}: {'[]' if inner == [] else scalar(inner)}"]
        return head + _object(dict(others), level + 1)
    if isinstance(value, list):
        if not value:
            return [f"{dash} []"]
        top, *below = _array(value, level)
        return [f"{dash} {top.lstrip()}", *below]
    return [f"{dash} {scalar(value)}"]


def _sorted_keys(value):
    if isinstance(value, dict):
        return {k: _sorted_keys(value[k]) for k in sorted(value)}
    return [_sorted_keys(x) for x in value] if isinstance(value, list) else value


def encode(value) -> str:
    """Text of a JSON value; object keys in order."""
    value = _sorted_keys(value)
    if isinstance(value, list):
        return "\n".join(_array(value, 0)) if value else "[]"
    return "\n".join(_object(value, 0)) if isinstance(value, dict) else scalar(value)


class DecodeError(ValueError):
    pass


def _cells(text: str) -> list[str]:
    """Parts between the commas outside quotes; a backslash in quotes protects the next character."""
    return re.findall(r'(?:"(?:\\.|[^"\\])*"?|[^",])+|(?<=,)(?=,|\Z)|\A(?=,|\Z)', text, re.S)


def _value(token: str):
    token = token.strip()
    if len(token) >= 2 and token[0] == token[-1] == '"':
        return _unescape(token[1:-1])
    if token in ("true", "false", "null", "[]"):
        return {"true": True, "false": False, "null": None, "[]": []}[token]
    if _numeric.fullmatch(token):
        if re.fullmatch("[+-]?[0-9]+", token) and -(1 << 63) <= int(token) < 1 << 64:
            return int(token)
        if abs(float(token)) != float("inf"):
            return float(token)
    return token


def _unescape(text: str) -> str:
    letters = {"n": "\n", "r": "\r", "t": "\t"}
    return re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else letters.get(m[2], m[2]), text, flags=re.S)


_header = re.compile(r'(?P<name>[^\s\[]*)\[(?P<n>[0-9]+)\](?:\{(?P<fields>[^}]*)\})?:(?P<rest>.*)', re.S)


class _Reader:
    def __init__(self, text: str):
        self.lines, self.at = split_lines(text), 0

    def level(self) -> int:
        """Indent of the current line, -1 at the end or a blank line."""
        if self.at >= len(self.lines) or not self.lines[self.at].strip():
            return -1
        line = self.lines[self.at]
        return (len(line) - len(line.lstrip(" "))) // 2

    def take(self) -> str:
        if self.at >= len(self.lines):
            raise DecodeError("text ends early")
        self.at += 1
        return self.lines[self.at - 1].strip(" ")

    def array(self, found: re.Match, level: int) -> list:
        n, rest = int(found["n"]), found["rest"].strip()
        if found["fields"] is not None:
            names = found["fields"].split(",") if found["fields"] else []
            return [dict(zip(names, map(_value, _cells(self.take())), strict=False)) for _ in range(n)]
        if rest:
            return [_value(c) for c in _cells(rest)]
        return [self.item(level + 1) for _ in range(n)]

    def item(self, level: int):
        line = self.take()
        if not line.startswith("-"):
            raise DecodeError(f"a list item must begin with a hyphen: {line}")
        body = line[1:].removeprefix(" ")
        if not body:
            return {}
        if body[0] == '"' and len(_cells(body)) == 1 and re.fullmatch(r'"(?:\\.|[^"\\])*"', body, re.S):
            return _value(body)
        found = _header.fullmatch(body)
        if found and not found["name"]:
            return self.array(found, level)
        if found or ":" in body:
            out = self.field(body, found, level + 1)
            if self.level() == level + 1 and not self.lines[self.at].lstrip().startswith("- "):
                out |= self.fields(level + 1)
            return out
        return _value(body)

    def field(self, body: str, found: re.Match | None, level: int) -> dict:
        if found:
            return {found["name"]: self.array(found, level)}
        name, colon, rest = body.partition(":")
        if not colon:
            raise DecodeError(f"a field needs a colon: {body}")
        if rest.strip():
            return {name: _value(rest)}
        return {name: self.fields(level + 1) if self.level() == level + 1 else {}}

    def fields(self, level: int) -> dict:
        out: dict = {}
        while self.level() == level:
            body = self.take()
            found = _header.fullmatch(body)
            out |= self.field(body, found if found and found["name"] else None, level)
        return out


def decode(text: str):
    """The JSON value of encoded text; DecodeError for text that is none."""
    reader = _Reader(text)
    if reader.level() < 0:
        return {}
    first = reader.lines[0].strip()
    if first == "[]":
        return []
    found = _header.fullmatch(first)
    if found and not found["name"]:
        reader.at = 1
        return reader.array(found, 0)
    if len(reader.lines) == 1 and (first[0] == '"' or ":" not in first):
        return _value(first)
    return reader.fields(0)


def encode_if_smaller(text: str) -> tuple[str, str] | None:
    """(text, source): the notation if it is shorter than minified JSON, else that; None unless the text is JSON."""
    ok, value = parse(text.strip())
    if not ok:
        return None
    plain, short = minified(value), encode(value)
    return (short, "toon") if len(short.encode()) < len(plain.encode()) else (plain, "toon-not-smaller")


def to_toon(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds compressed, source, chars_before and chars_after (bytes); null compressed and source where the text is no JSON."""
    encoded = text_kernel(lambda t: encode_if_smaller(t) or (None, None), "compressed string, source string")
    rows = docs.withColumn("__t", encoded(F.col(text))).select(*docs.columns, "__t.*")
    return rows.withColumn("chars_before", F.octet_length(text).cast("long")).withColumn("chars_after", F.octet_length("compressed").cast("long"))


def from_toon(docs: DataFrame, text: str = "text", out: str = "json") -> DataFrame:
    """Adds the minified JSON of encoded texts; null where a text cannot be read."""

    def read(t: str):
        try:
            return minified(decode(t))
        except (DecodeError, RecursionError):
            return None

    return docs.withColumn(out, text_kernel(read, "string")(F.col(text)))


def toon_tables(elements: DataFrame, key: str = "doc_id") -> DataFrame:
    """The tabular form of whole arrays of uniform flat objects, by DataFrame operations alone: key, compressed.

    Takes `json_elements`; arrays of another shape give no row.
    """
    numeric = F.lit(r"(?i)^[+-]?[0-9]+(?:\.[0-9]+)?(?:e[+-]?[0-9]+)?\z")
    def cell(f):
        v = f["value"]
        plain = ~(v.isin("", "true", "false", "null") | v.rlike(r"(?s)\A[ \t#-]|[ \t]\z") | F.regexp(v, numeric) | v.rlike(r'[:"\\\[\]{},\x00-\x1f]'))
        quoted_text = F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t")), F.lit('"'))
        return F.when(v.isNull(), "null").when(f["tag"] != "string", v).when(plain, v).otherwise(quoted_text)

    names = F.transform("fields", lambda f: f["name"])
    rows = elements.withColumn("names", names).withColumn("row", F.array_join(F.transform("fields", cell), ","))
    flat = F.forall("fields", lambda f: f["tag"].isin("null", "bool", "int", "string"))
    whole = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min("is_object").alias("objects"), F.min(flat).alias("flat"), F.min("names").alias("names"), F.max("names").alias("last"),
        F.array_sort(F.collect_list(F.struct("pos", "row"))).alias("rows"),
    )
    whole = whole.where((F.col("n") >= 2) & F.col("objects") & F.col("flat") & (F.col("names") == F.col("last")))
    head = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]{"), F.array_join("names", ","), F.lit("}:"))
    body = F.transform("rows", lambda r: F.concat(F.lit("\n  "), r["row"]))
    return whole.select(key, F.concat(head, F.array_join(body, "")).alias("compressed"))
