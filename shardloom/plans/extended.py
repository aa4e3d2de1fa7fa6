"""The extended mode: all of Spark SQL, plus TIME_BUCKET and the percentile functions.

TIME_BUCKET('n unit', c) is rewritten to an expression over built-in functions;
PERCENTILE(c, p) and P50(c)... to exact nearest rank over the sorted values.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidTimeBucket
from ..functions.aggregates import NAMED_PERCENTILES
from ..functions.time import parse_interval

_CALL = re.compile(r"\b(time_bucket|percentile|p50|p90|p95|p99)\s*\(", re.IGNORECASE)


def _masked(text: str) -> str:
    """``text`` with the insides of strings, quoted names and comments blanked, at the same places."""
    return re.sub(r"'(?:[^'\\]|''|\\.)*'|`[^`]*`|--[^\n]*|/\*.*?\*/", lambda m: " " * len(m[0]), text, flags=re.DOTALL)


def _arguments(masked: str, start: int) -> tuple[list[tuple[int, int]], int]:
    """The spans of a call's arguments, and where its closing parenthesis is."""
    depth, spans, begin = 0, [], start
    for i in range(start, len(masked)):
        c = masked[i]
        if c == "(":
            depth += 1
        elif c == ")":
            if depth == 0:
                return [*spans, (begin, i)], i
            depth -= 1
        elif c == "," and depth == 0:
            spans.append((begin, i))
            begin = i + 1
    raise InvalidTimeBucket("unclosed call")


def rewrite(text: str) -> str:
    """``text`` as plain Spark SQL."""
    at = 0
    while m := _CALL.search(_masked(text), at):
        spans, end = _arguments(_masked(text), m.end())
        args = [text[a:b].strip() for a, b in spans]
        name = m[1].lower()
        if name == "time_bucket":
            if len(args) != 2 or not re.fullmatch(r"'[^']*'", args[0]):
                raise InvalidTimeBucket
            ms = f"unix_millis(CAST({args[1]} AS TIMESTAMP))"
            new = f"timestamp_millis({ms} - pmod({ms}, {parse_interval(args[0][1:-1])}L))"
        else:
            p = repr(NAMED_PERCENTILES[name]) if name in NAMED_PERCENTILES else args[1] if len(args) > 1 else "0.5"
            value = f"CAST({args[0]} AS DOUBLE)"
            rank = f"CAST(floor(CAST({p} AS DOUBLE) * (count({value}) - 1) + 0.5D) AS INT)"
            new = f"get(sort_array(collect_list({value})), {rank})"
        text = text[: m.start()] + new + text[end + 1 :]
        at = m.start() + 1
    return text


def run(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(rewrite(text))
