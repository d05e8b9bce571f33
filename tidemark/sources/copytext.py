"""Tab-separated text with ``\\N`` nulls and backslash escapes, as database bulk exports write it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import ColumnSpec, from_text

_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def parse_line(line: str) -> list[str | None]:
    """The fields of one line; None is null, an empty field the empty text."""
    cell = lambda raw: None if raw == "\\N" else re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), raw, flags=re.S)
    return [cell(raw) for raw in line.split("\t")]


def unescaped(raw: Column) -> Column:
    """The same by built-in functions: escaped backslashes step aside while the other escapes are read."""
    out = F.replace(raw, F.lit("\\\\"), F.lit("\x00"))
    for letter, char in _ESCAPES.items():
        out = F.replace(out, F.lit(f"\\{letter}"), F.lit(char))
    out = F.replace(F.replace(out, F.lit("\\"), F.lit("")), F.lit("\x00"), F.lit("\\"))
    return F.when(raw == "\\N", F.lit(None)).otherwise(out)


def read_copy(spark: SparkSession, path: str, columns: list[ColumnSpec]) -> DataFrame:
    """Lines to typed columns; an empty line is one empty field."""
    cells = F.split(F.col("value"), "\t", -1)
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(*[from_text(unescaped(F.get(cells, F.lit(k))), c).alias(c.name) for k, c in enumerate(columns)])


def plan_ranges(rows: int, workers: int) -> list[tuple[int, int | None]]:
    """Disjoint ranges that cover everything; the last is open-ended, for rows that come meanwhile."""
    n = max(1, min(workers, rows or 1))
    edges = [rows * k // n for k in range(n)]
    return [(a, b) for a, b in zip(edges, [*edges[1:], None], strict=True)]
