"""Thresholds, and the one knob that sets them."""

from __future__ import annotations

from dataclasses import dataclass

#: Texts of at most so many bytes skip the log, diff and prose compressors.
SIZE_GATE = 2000


@dataclass(frozen=True)
class DiffLimits:
    max_context_lines: int = 2
    max_hunks_per_file: int = 10
    max_files: int = 20


@dataclass(frozen=True)
class LogLimits:
    max_errors: int = 10
    max_warnings: int = 5
    context_lines: int = 2
    max_total_lines: int = 100


@dataclass(frozen=True)
class FactLimits:
    max_enum_values: int = 5
    max_value_len: int = 24
    max_marker_bytes: int = 160


@dataclass(frozen=True)
class JsonLimits:
    keep_edge: int = 5
    min_savings: float = 0.30
    facts: FactLimits = FactLimits()


@dataclass(frozen=True)
class Level:
    """`paraphrase_threshold` is for the vector-based sentence dedup; the lexical cascade is fixed at 0.8."""

    name: str = "default"
    paraphrase_threshold: float = 0.80
    diff: DiffLimits = DiffLimits()
    log: LogLimits = LogLimits()
    json: JsonLimits = JsonLimits()


LEVELS = {
    "conservative": Level("conservative", 0.90, DiffLimits(4, 20, 40), LogLimits(20, 10, 4, 200), JsonLimits(10)),
    "default": Level(),
    "aggressive": Level("aggressive", 0.70, DiffLimits(1, 5, 10), LogLimits(5, 2, 1, 50), JsonLimits(2)),
}


def level(name: str) -> Level:
    if name not in LEVELS:
        raise ValueError(f"level must be one of {', '.join(LEVELS)}: {name!r}")
    return LEVELS[name]
