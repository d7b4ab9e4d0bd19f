"""Search patterns as Spark's regular expressions, with the white space that web scripts know."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: White space of ECMAScript; Java's \s is ASCII alone.
WHITE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = f"[{WHITE}]"
NOT_WS = f"[^{WHITE}]"


def widen(pattern: str) -> str:
    """``\\s`` and ``\\S`` of a user's pattern with the wide meaning, in and out of brackets."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(WHITE if inside else WS)
        elif two == r"\S":
            out.append(f"&&{NOT_WS}" if inside and out and out[-1] == "[" else NOT_WS)
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = (inside or two[0] == "[") and two[0] != "]"
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out)


def trim_wide(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def is_blank(c: Column) -> Column:
    return F.length(trim_wide(c)) == 0


def is_valid(spark: SparkSession, pattern: str) -> bool:
    """Whether Spark takes the pattern; a bad one would fail only while a query runs."""
    try:
        spark.range(1).select(F.lit("").rlike(pattern)).collect()
    except PySparkException:
        return False
    return True


def build_matcher(spark: SparkSession, query: str, regex: bool = False, case_sensitive: bool = False) -> str | None:
    """The pattern for a query, or None for a blank query or a bad expression.

    A plain query is matched literally; by default upper and lower case are the same in all scripts.
    """
    if not re.sub(f"[{WHITE}]+", "", query):
        return None
    pattern = widen(query) if regex else re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", query)
    pattern = pattern if case_sensitive else f"(?iu){pattern}"
    return pattern if not regex or is_valid(spark, pattern) else None


def invalid_regex(spark: SparkSession, query: str, regex: bool) -> bool:
    """In expression mode: a query that isn't blank and can't be used."""
    return regex and bool(re.sub(f"[{WHITE}]+", "", query)) and build_matcher(spark, query, True) is None


def group_number(pattern: str, name: str) -> int | None:
    """The number of a named group: capturing groups count by their opening brackets."""
    number, i, inside = 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "(":
            special = pattern[i + 1 : i + 2] == "?"
            named = re.match(r"\(\?<([A-Za-z]\w*)>", pattern[i:])
            if not special or named:
                number += 1
            if named and named[1] == name:
                return number
        i += 1
    return None
