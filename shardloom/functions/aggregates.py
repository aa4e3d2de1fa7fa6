"""Aggregates with the engine's types: sums are doubles, percentiles nearest rank."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from ..errors import UnsupportedFunction

PLAIN = ("count", "sum", "avg", "min", "max")
NAMED_PERCENTILES = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def aggregate(function: str, column: Column | None) -> Column:
    """COUNT, SUM, AVG, MIN or MAX; a column of None is ``*``."""
    if function == "count":
        return F.count(F.lit(1) if column is None else column)
    if function == "sum":
        return F.sum(column.cast("double"))
    if function == "avg":
        return F.avg(column.cast("double"))
    if function == "min":
        return F.min(column)
    if function == "max":
        return F.max(column)
    raise UnsupportedFunction(function)


def rank_of(p: float, n: Column) -> Column:
    """The 1-based rank of the nearest-rank percentile among ``n`` sorted values."""
    return F.floor(F.lit(float(p)) * (n - 1) + 0.5).cast("long") + 1


def percentiles(df: DataFrame, keys: Sequence[tuple[str, Column]], column: Column, wanted: Sequence[tuple[str, float]]) -> DataFrame:
    """Exact nearest-rank percentiles of one column: a row per group that has values, with the keys and a column per ``wanted``.

    Values are first counted per group and value, so repeats collapse before the shuffle; ranks are
    then running sums over distinct values within slices of the value range, offset by the sums of the
    slices before. Slices end at approximate quantiles of the values that occur, so each holds about
    the same number of them however narrow their range is. No group is ever held or sorted in one place.
    """
    names = [name for name, _ in keys]
    slots = [f"__k{i}" for i in range(len(keys))]
    values = df.select(*(c.alias(s) for s, (_, c) in zip(slots, keys, strict=True)), column.cast("double").alias("__v"))
    counts = values.filter("__v is not null").groupBy(*slots, "__v").agg(F.count(F.lit(1)).alias("__n"))
    edges = F.percentile_approx(F.when(~F.isnan("__v"), F.col("__v")), F.array(*(F.lit(k / SLICES) for k in range(1, SLICES))), F.lit(20 * SLICES))
    side = int(SLICES**0.5)
    coarse = F.transform(F.sequence(F.lit(side - 1), F.lit(SLICES - 2), F.lit(side)), lambda k: F.get("__edges", k))
    cuts = counts.agg(edges.alias("__edges")).select("__edges", coarse.alias("__coarse"))  # one row
    cut = counts.crossJoin(F.broadcast(cuts)).withColumn("__slice", _slice(F.col("__v"), F.col("__edges"), F.col("__coarse")))
    cut = cut.drop("__edges", "__coarse")
    sums = cut.groupBy(*slots, "__slice").agg(F.sum("__n").alias("__held"))
    before = Win.partitionBy(*slots).orderBy("__slice").rowsBetween(Win.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__held").over(before), F.lit(0)))
    sums = sums.withColumn("__all", F.sum("__held").over(Win.partitionBy(*slots)))
    # only the slices that hold a wanted rank go on
    ranks = [rank_of(p, F.col("__all")) for _, p in wanted]
    inside = [(F.col("__before") < r) & (r <= F.col("__before") + F.col("__held")) for r in ranks]
    sums = sums.filter(reduce(lambda x, y: x | y, inside))
    run = Win.partitionBy(*slots, "__slice").orderBy("__v").rowsBetween(Win.unboundedPreceding, Win.currentRow)
    left, right = cut.alias("l"), sums.alias("r")
    same = [F.col(f"l.{s}").eqNullSafe(F.col(f"r.{s}")) for s in [*slots, "__slice"]]
    met = left.join(right, same).select("l.*", "r.__before", "r.__all")
    met = met.withColumn("__upto", F.sum("__n").over(run) + F.col("__before"))
    picks = []
    for name, p in wanted:
        rank = rank_of(p, F.col("__all"))
        hit = (F.col("__upto") - F.col("__n") < rank) & (rank <= F.col("__upto"))
        picks.append(F.max(F.when(hit, F.col("__v"))).alias(name))
    found = met.groupBy(*slots).agg(*picks)
    return found.select(*(F.col(s).alias(n) for s, n in zip(slots, names, strict=True)), *(n for n, _ in wanted))


#: Slices of the value range, a square.
SLICES = 256


def _slice(value: Column, edges: Column, coarse: Column) -> Column:
    """How many of the ascending ``edges`` lie below the value, by way of every sixteenth of them; NaN comes last."""
    side = int(SLICES**0.5)
    run = F.size(F.filter(coarse, lambda e: e < value))
    within = F.size(F.filter(F.slice(edges, run * side + 1, side), lambda e: e < value))
    return F.when(F.isnan(value), F.lit(SLICES)).otherwise(F.when(edges.isNull(), F.lit(0)).otherwise(run * side + within)).cast("int")


def nearest_rank(column: Column, p: float) -> Column:
    """The same percentile as a plain aggregate, for groups known to be small: it gathers the values."""
    values = F.sort_array(F.collect_list(column.cast("double")))
    return F.get(values, (rank_of(p, F.count(column)) - 1).cast("int"))


#: Input, by the planner's estimate, up to which a group's values may be gathered in one place.
SMALL_BYTES = 32 << 20


def is_small(df: DataFrame) -> bool:
    """Whether all of ``df`` is surely small: the estimate of files and cached tables is an upper bound, others are huge."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES


def approximate(column: Column, p: float, accuracy: int = 10_000) -> Column:
    """Opt-in: bounded state, not exact."""
    return F.percentile_approx(column.cast("double"), F.lit(p), F.lit(accuracy))


def histogram(df: DataFrame, column: str, size: float, by: Sequence[str] = ()) -> DataFrame:
    """Per group, ``histogram``: JSON [[bucket, count], ...] by floor(value / size), nulls left out."""
    if not size > 0:
        raise ValueError("bucket size must be positive")
    value = F.col(f"`{column}`").cast("double")
    keys = [F.col(f"`{b}`") for b in by]
    bucket = F.floor(value / F.lit(float(size))).cast("long")
    counts = df.filter(value.isNotNull()).groupBy(*keys, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.transform(F.sort_array(F.collect_list(F.struct("bucket", "n"))), lambda s: F.array(s["bucket"], s["n"]))
    grouped = counts.groupBy(*by) if by else counts.groupBy()
    return grouped.agg(F.to_json(pairs).alias("histogram"))
