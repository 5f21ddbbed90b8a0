"""Column helpers shared by the operators: liveness, patterns, index ranges, number parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The very end of a text; ``$`` would also stand before a last line feed.
END = r"(?![\s\S])"
WHOLE_NUMBER = "^-?[0-9]+" + END


def live(state: DataFrame, now_ms: int) -> DataFrame:
    """Rows that have no deadline or one after ``now_ms``. The time is always a parameter."""
    return state.where(F.col("deadline_ms").isNull() | (F.col("deadline_ms") > F.lit(now_ms)))


def glob_regex(pattern: str) -> str:
    """A whole-key regular expression for ``*``, ``?``, ``[a-c]``, ``[^x]``, ``[!x]`` and ``\\x``."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            negated = body[:1] in ("^", "!")
            body = body[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&").replace("^", "\\^")
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + END


def glob(column: Column, pattern: str) -> Column:
    """Whether a key matches. Plain and prefix patterns become comparisons that reach the scan."""
    if not re.search(r"[*?\[\\]", pattern):
        return column == pattern
    if pattern == "*":
        return column.isNotNull()
    if pattern.endswith("*") and not re.search(r"[*?\[\\]", pattern[:-1]):
        return column.startswith(pattern[:-1])
    return column.rlike(glob_regex(pattern))


def slice_bounds(start: int, stop: int, size: Column) -> tuple[Column, Column]:
    """First and last place of an inclusive slice whose ends may count from the back.

    Empty if first > last. ``size``: how many places there are.
    """
    first = F.lit(start) if start >= 0 else F.greatest(F.lit(0), size + start)
    last = F.least(F.lit(stop) if stop >= 0 else size + stop, size - 1)
    return first, last


def parse_int(column: Column) -> Column:
    """A whole 64-bit number without plus sign or blanks; null otherwise."""
    return F.when(column.rlike(WHOLE_NUMBER), column.try_cast("bigint"))


def parse_double(column: Column) -> Column:
    """A number, inf or nan, each with or without a sign; null otherwise. Hexadecimal floats aren't supported."""
    word = F.lower(column)
    return (F.when(word.isin("inf", "+inf", "infinity"), F.lit(float("inf"))).when(word.isin("-inf", "-infinity"), F.lit(float("-inf")))
            .when(word.isin("nan", "+nan", "-nan"), F.lit(float("nan")))
            .when(column.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?" + END), column.try_cast("double")))


def shard_of(key: Column, shards: int) -> Column:
    """The shard that a key belongs to."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
