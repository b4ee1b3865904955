"""The scalar functions of the domain for SQL text: ``register(spark)`` makes them temporary SQL functions.

Each is an expression of Spark's own functions, which the optimizer sees through; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tagloom.functions import features as fx
from tagloom.functions import tags as tg
from tagloom.functions import text


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _literal(pattern: str) -> str:
    return "r'" + pattern + "'"


def _transitions(pairs: dict[str, list[str]], first: str, second: str) -> str:
    return " OR ".join(f"({first} = '{p}' AND {second} IN ({_list(others)}))" for p, others in pairs.items())


_EDGES = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"
_BEFORE, _NOW = "tag_prefix(coalesce(before, 'O'))", "tag_prefix(coalesce(tag, 'O'))"
_CHANGE = "tag_type(coalesce(before, 'O')) <> tag_type(coalesce(tag, 'O'))"
_MIDDLE = f"regexp_extract(feature, {_literal('(?s)^[^:]*:(.*):[^:]*$')}, 1)"

#: Name and arguments, result type, expression.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "strip_line": ("line STRING", "STRING", f"regexp_replace(line, {_literal(_EDGES)}, '')"),
    "line_words": ("line STRING", "ARRAY<STRING>", f"array_remove(split(line, {_literal(text.WHITESPACE)}), '')"),
    "tag_prefix": ("tag STRING", "STRING", "substring_index(tag, '-', 1)"),
    "tag_type": (
        "tag STRING", "STRING",
        "CASE WHEN NOT contains(tag, '-') OR substr(tag, locate('-', tag) + 1) = '0' THEN '' ELSE substr(tag, locate('-', tag) + 1) END",
    ),
    "chunk_starts": (
        "before STRING, tag STRING", "BOOLEAN",
        f"{_transitions(tg.OPENS_AFTER, _NOW, _BEFORE)} OR ({_NOW} NOT IN ({_list(tg.NO_CHUNK)}) AND {_CHANGE}) OR {_NOW} IN ({_list(tg.SINGLE)})",
    ),
    "chunk_ended": (
        "before STRING, tag STRING", "BOOLEAN",
        f"{_transitions(tg.CLOSES_BEFORE, _BEFORE, _NOW)} OR ({_BEFORE} NOT IN ({_list(tg.NO_CHUNK)}) AND {_CHANGE}) OR {_BEFORE} IN ({_list(tg.SINGLE)})",
    ),
    "word_suffix": ("word STRING, j INT", "STRING", "CASE WHEN length(word) >= j THEN right(word, j) END"),
    "feature_family": ("feature STRING", "STRING", "substring_index(feature, ':', 1)"),
    "feature_tag": ("feature STRING", "STRING", "substring_index(feature, ':', -1)"),
    "feature_context": (
        "feature STRING", "STRING",
        f"CASE WHEN feature_family(feature) = '{fx.SUFF}' THEN regexp_extract({_MIDDLE}, {_literal('(?s)^(.*):[0-9]+$')}, 1) ELSE {_MIDDLE} END",
    ),
    "feature_length": (
        "feature STRING", "INT",
        f"CASE WHEN feature_family(feature) = '{fx.SUFF}' THEN int(substring_index({_MIDDLE}, ':', -1)) END",
    ),
}


def register(spark: SparkSession) -> None:
    """Create the functions in the session; ``before`` and ``tag`` may be null at the edges of a sentence."""
    for name, (arguments, kind, expression) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {expression}")
