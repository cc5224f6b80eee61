"""Strict JSON: what a strict parser accepts, with the last of repeated keys, and minified text with sorted keys."""

from __future__ import annotations

import json
import re
from decimal import Decimal

MAX_DEPTH = 127
_NUMBER = re.compile(r"[+-]?(?:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)", re.I)


class Raw(str):
    """The source text of a JSON number."""


def _refuse(_):
    raise ValueError("not JSON")


def _integer(text: str):
    value = int(text)
    return value if -(1 << 63) <= value < 1 << 64 else _float(text)


def _float(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError("number out of range")
    return value


def _depth(value, level: int = 1) -> None:
    if level > MAX_DEPTH + 1:
        raise ValueError("too deep")
    if isinstance(value, dict):
        for v in value.values():
            _depth(v, level + 1)
    elif isinstance(value, list):
        for v in value:
            _depth(v, level + 1)


def loads(text: str, raw_numbers: bool = False):
    """The value of strict JSON; ValueError for anything else. raw_numbers: numbers as their source text."""
    try:
        value = json.loads(text, parse_constant=_refuse, parse_int=Raw if raw_numbers else _integer, parse_float=Raw if raw_numbers else _float)
        if "\\u" in text:
            json.dumps(value, ensure_ascii=False).encode()
        if text.count("[") + text.count("{") > MAX_DEPTH:
            _depth(value)
    except (RecursionError, UnicodeEncodeError) as e:
        raise ValueError("not JSON") from e
    return value


def parse(text: str | None):
    """(True, value) or (False, None)."""
    if text is None:
        return False, None
    try:
        return True, loads(text)
    except ValueError:
        return False, None


def number_text(value: int | float) -> str:
    """Shortest text that reads back: 5.0, 1e16, 1e-6; integers as they are."""
    if isinstance(value, int):
        return str(value)
    if value == 0:
        return "-0.0" if str(value)[0] == "-" else "0.0"
    sign, digits, exponent = Decimal(repr(value)).as_tuple()
    while len(digits) > 1 and digits[-1] == 0:
        digits, exponent = digits[:-1], exponent + 1
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if exponent >= 0 and point <= 16:
        out = text + "0" * exponent + ".0"
    elif 0 < point <= 16:
        out = text[:point] + "." + text[point:]
    elif -5 < point <= 0:
        out = "0." + "0" * -point + text
    else:
        out = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{point - 1}"
    return "-" + out if sign else out


def minified(value) -> str:
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return number_text(value)
    if isinstance(value, Raw):
        return str(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(map(minified, value)) + "]"
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{minified(value[k])}" for k in sorted(value)) + "}"


def identity(value):
    """A hashable key under which two values are equal iff their JSON is: 1 and 1.0 differ, -0.0 and 0.0 do not."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return (type(value).__name__, value)
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, float):
        return ("float", value + 0.0)
    if isinstance(value, list):
        return ("list", tuple(map(identity, value)))
    return ("dict", tuple((k, identity(value[k])) for k in sorted(value)))


def parses_as_number(text: str) -> bool:
    return _NUMBER.fullmatch(text) is not None


def raw_slices(text: str) -> list[tuple[list[tuple[str, str]] | None]]:
    """For each element of a JSON array in `text`: its fields (name, source text; strings unescaped) by name, or None if it is no object."""
    decoder, out = json.JSONDecoder(parse_int=Raw, parse_float=Raw), []
    at = _skip(text, 0) + 1
    while text[at := _skip(text, at)] != "]":
        if text[at] == ",":
            at += 1
            continue
        if text[at] == "{":
            fields: dict[str, str] = {}
            at += 1
            while text[at := _skip(text, at)] != "}":
                if text[at] == ",":
                    at += 1
                    continue
                key, at = decoder.raw_decode(text, at)
                at = _skip(text, _skip(text, at) + 1)
                value, end = decoder.raw_decode(text, at)
                fields[key] = value if isinstance(value, str) and not isinstance(value, Raw) else text[at:end]
                at = end
            at += 1
            out.append(sorted(fields.items()))
        else:
            _, at = decoder.raw_decode(text, at)
            out.append(None)
    return out


def _skip(text: str, at: int) -> int:
    while text[at] in " \t\n\r":
        at += 1
    return at
