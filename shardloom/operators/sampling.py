"""Sampling by hash: the same rows whatever the partitioning, and in any engine that has MD5."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import quote

_PARTS = 1_000_000
#: Parts of the hash's range that subsample() counts.
_RANGES = 1 << 16


def _row_hash(df: DataFrame, key: str | None, seed: int) -> Column:
    """60 bits of the MD5 of '<key>|<seed>'; without a key, of the row as JSON."""
    value = F.col(quote(key)).cast("string") if key else F.to_json(F.struct(*(F.col(quote(c)) for c in df.columns)))
    name = F.concat_ws("|", F.coalesce(value, F.lit("")), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def bernoulli(df: DataFrame, rate: float, seed: int = 0, key: str | None = None) -> DataFrame:
    """Each row with probability ``rate``, by the hash of ``key`` (or the whole row): none at 0 or less, all from 1."""
    if rate >= 1:
        return df
    if rate <= 0:
        return df.filter(F.lit(False))
    return df.filter(F.pmod(_row_hash(df, key, seed), F.lit(_PARTS)) < round(rate * _PARTS))


def sample_k(df: DataFrame, k: int, seed: int = 0, key: str | None = None) -> DataFrame:
    """``k`` distinct rows, all if there are fewer. Top-k by hash, so only k rows a task move."""
    order = [_row_hash(df, key, seed)] + ([F.col(quote(key))] if key else [])
    return df.orderBy(*order).limit(max(0, k))


@dataclass(frozen=True)
class SubsampleStats:
    rows: int
    target: int


def subsample(df: DataFrame, ratio: float, seed: int = 0, key: str | None = None) -> tuple[DataFrame, SubsampleStats]:
    """ceil(n * ratio) rows of ``df``, and the counts: those of the smallest hashes.

    Counts by ranges of the hash say which of them are in; only the rows of the one range that the
    sample ends in are put in order.
    """
    held = F.shiftright(_row_hash(df, key, seed), 60 - (_RANGES.bit_length() - 1)).cast("int")
    sizes = df.groupBy(held.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # _RANGES rows at most
    n = sum(r.n for r in sizes)
    target = min(n, max(0, -int(-n * ratio // 1)))
    taken, end = 0, -1
    for r in sorted(sizes, key=lambda r: r.part):
        end = r.part
        if taken + r.n >= target:
            break
        taken += r.n
    rest = sample_k(df.filter(held == end), target - taken, seed, key)
    return df.filter(held < end).union(rest), SubsampleStats(n, target)
