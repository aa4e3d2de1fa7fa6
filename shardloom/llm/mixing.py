"""Mixing of sources to target weights, as DataFrame functions.

The corpus is a tree of levels (domain, language, source). A node's budget goes to
its children in proportion to their weights; a child that holds less than its share
gives it all, and the rest goes to its siblings. A child holds what its leaves hold
in all allowed epochs, so a shortage reaches the parent's siblings only where the
whole parent is short. Shares are exact integers: what rounding leaves over goes
one token each to the children that are furthest from being short.

A leaf's budget is so many whole epochs and a prefix of one more, each epoch a
seeded order of its documents of its own. The prefix is the whole documents that
fit. Its end is found from sums over hash ranges, so no leaf is ever sorted in one
place: only the documents of the one range that holds the end are.

Defined results: null levels are the level ''; null and empty text have no tokens,
take no budget, and go along with the prefix that reaches them; repeated rows count
each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

#: Hash ranges of a leaf.
RANGES = 4096
#: Leaves up to which the budgets are broadcast (about 100 MB); beyond it they are joined by shuffle.
BROADCAST_LEAVES = 500_000


def n_tokens(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded_order(seed: int, epoch: Column, doc_id: Column) -> Column:
    """60 bits that order an epoch."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def _weight(level: Column, weights: dict[str, int]) -> Column:
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    return reduce(lambda out, kv: F.when(level == kv[0], F.lit(kv[1])).otherwise(out), weights.items(), F.lit(1)).cast("long")


def share_out(children: DataFrame, parent: Sequence[str], child: str) -> DataFrame:
    """``children`` (parent columns, child, capacity, weight, parent's budget) with ``share``."""
    big = "decimal(38,0)"
    by = [F.col(p) for p in parent]
    order = Win.partitionBy(*by).orderBy(F.col("capacity") / F.col("weight"), F.col(child))
    before = order.rowsBetween(Win.unboundedPreceding, -1)
    after = order.rowsBetween(Win.currentRow, Win.unboundedFollowing)
    whole = Win.partitionBy(*by)
    out = children.withColumn("__spent", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
    out = out.withColumn("__weights", F.sum("weight").over(after))
    short = F.col("capacity").cast(big) * F.col("__weights") <= F.col("weight").cast(big) * (F.col("budget") - F.col("__spent"))
    out = out.withColumn("__short", short)
    out = out.withColumn("__left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("__short"), F.col("capacity"))).over(whole), F.lit(0)))
    out = out.withColumn("__rest", F.sum(F.when(~F.col("__short"), F.col("weight"))).over(whole))
    part = F.expr("cast(weight as decimal(38,0)) * __left div __rest").cast("long")
    out = out.withColumn("share", F.when(F.col("__short"), F.col("capacity")).otherwise(part))
    out = out.withColumn("__over", F.col("__left") - F.sum(F.when(~F.col("__short"), F.col("share"))).over(whole))
    last = Win.partitionBy(*by).orderBy(F.col("__short").asc(), (F.col("capacity") / F.col("weight")).desc(), F.col(child).desc())
    extra = ~F.col("__short") & (F.row_number().over(last) <= F.col("__over"))
    out = out.withColumn("share", F.col("share") + extra.cast("long"))
    return out.drop("__spent", "__weights", "__short", "__left", "__rest", "__over")


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], weights: dict[str, dict[str, int]], budget: int, max_epochs: int
) -> DataFrame:
    """(levels, tokens, budget) of ``leaves`` (levels, tokens)."""
    from .store import materialize

    parents = leaves.sparkSession.range(1).select(F.lit(budget).cast("long").alias("budget"))
    for depth in range(1, len(levels) + 1):
        path = list(levels[:depth])
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).cast("long").alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(F.col(path[-1]), weights.get(path[-1], {})))
        above = nodes.withColumn("budget", F.lit(budget).cast("long")) if depth == 1 else nodes.join(parents, path[:-1])
        above = above.withColumn("__root", F.lit(0))
        shared = share_out(above, path[:-1] or ["__root"], path[-1])
        parents = materialize(shared.select(*path, F.col("share").alias("budget")), "shares")
    return leaves.join(parents, list(levels))


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, dict[str, int]],
    share: float | None = None,
    budget: int | None = None,
    max_epochs: int = 4,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = False,
) -> DataFrame:
    """Per document: id, level_<name> of each level, n_tokens, leaf_budget and copies (how often the mix holds it).

    ``levels``: name -> column of ``docs``, from the root. The budget is ``budget`` tokens or ``share`` of the corpus.
    ``weights``: level -> value -> weight, 1 where none is given. ``carry``: also ``row``, the whole row of ``docs``.
    """
    from .store import materialize

    names = [f"level_{n}" for n in levels]
    rows = docs.select(
        F.col(id_col).alias("id"),
        *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(names, levels.values(), strict=True)),
        n_tokens(F.col(text_col).cast("string")).alias("n_tokens"),
        *([F.struct(*(docs[c] for c in docs.columns)).alias("row")] if carry else []),
    )
    each = materialize(rows.select("id", *names, "n_tokens"), "tokens")
    leaves = materialize(each.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    if budget is None:
        budget = int(share * (leaves.agg(F.sum("tokens")).first()[0] or 0))
    by_name = {f"level_{k}": v for k, v in weights.items()}
    budgets = materialize(leaf_budgets(leaves, names, by_name, budget, max_epochs), "budgets")
    few = budgets.count() <= BROADCAST_LEAVES
    epochs = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0))
    budgets = budgets.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    met = _ordered(each.join(F.broadcast(budgets) if few else budgets, names), seed)
    sums = met.groupBy(*names, "range").agg(F.sum("n_tokens").alias("held"), F.max("rest").alias("rest"))
    so_far = Win.partitionBy(*names).orderBy("range").rowsBetween(Win.unboundedPreceding, Win.currentRow)
    sums = sums.withColumn("upto", F.sum("held").over(so_far)).withColumn("before", F.col("upto") - F.col("held"))
    ends = sums.filter("before <= rest and rest < upto").select(*names, F.col("range").alias("end"), "before")
    whole = materialize(budgets.join(ends, names, "left"), "ends")
    met = _ordered((rows if carry else each).join(F.broadcast(whole) if few else whole, names), seed)
    out = ["id", *names, "n_tokens", F.col("budget").alias("leaf_budget"), *(["row"] if carry else [])]
    # all that is before the range with the end is in; an epoch without an end is one that fits
    plain = met.filter("end is null or range <> end")
    fits = (F.col("rest") > 0) & (F.col("end").isNull() & (F.col("rest") >= F.col("tokens")) | (F.col("range") < F.col("end")))
    plain = plain.select(*out, (F.col("epochs") + F.coalesce(fits, F.lit(False)).cast("long")).alias("copies"))
    edge = met.filter("range = end")
    run = Win.partitionBy(*names).orderBy("order", "id", "n_tokens").rowsBetween(Win.unboundedPreceding, Win.currentRow)
    edge = edge.withColumn("sum", F.col("before") + F.sum("n_tokens").over(run))
    fits = (F.col("rest") > 0) & (F.col("sum") <= F.col("rest"))
    edge = edge.select(*out, (F.col("epochs") + fits.cast("long")).alias("copies"))
    return plain.union(edge)


def _ordered(rows: DataFrame, seed: int) -> DataFrame:
    """With each row's place in the seeded order, and its hash range."""
    rows = rows.withColumn("order", seeded_order(seed, F.col("epochs"), F.col("id")))
    return rows.withColumn("range", F.shiftright("order", 60 - (RANGES.bit_length() - 1)).cast("int"))


# Documents have no column for a domain: the query derives one of four from the source's name.
DOMAIN = "concat('dom', pmod(cast(conv(substring(md5(source), 1, 8), 16, 10) as long), 4))"
LEVELS = ("domain", "lang", "source")
WEIGHTS = {"domain": {"dom0": 4, "dom1": 3, "dom2": 2, "dom3": 1}, "lang": {"en": 5, "de": 2, "fr": 2}}
SHARE, MAX_EPOCHS, SEED = 0.6, 4, 17


def mix_documents(docs: DataFrame, carry: bool = False) -> DataFrame:
    levels = {"domain": F.expr(DOMAIN), "lang": F.col("lang"), "source": F.col("source")}
    return mix(docs, levels, WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS, seed=SEED, carry=carry)


def query(spark, sf_dir: str) -> DataFrame:
    from .store import table

    mixed = mix_documents(table(spark, sf_dir, "documents"))
    levels = [F.col(f"level_{n}").alias(n) for n in LEVELS]
    return mixed.select(F.col("id").alias("doc_id"), *levels, "n_tokens", "leaf_budget", "copies")


def _level_sql(name: str, above: str, path: list[str]) -> str:
    """The same sharing out as SQL; ``above`` holds the budgets of the parents."""
    child, parent = path[-1], path[:-1]
    cases = " ".join(f"WHEN {child} = '{k}' THEN {v}" for k, v in WEIGHTS.get(child, {}).items())
    weight = f"CASE {cases} ELSE 1 END" if cases else "1"
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    joined = f"JOIN {above} USING ({', '.join(parent)})" if parent else f"CROSS JOIN {above}"
    keys = ", ".join(path)
    return f"""
{name}0 AS (SELECT * FROM (SELECT {keys}, (sum(tokens) * {MAX_EPOCHS})::HUGEINT AS capacity, ({weight})::HUGEINT AS weight FROM leaves GROUP BY {keys}) {joined}),
{name}1 AS (SELECT *,
  coalesce(sum(capacity) OVER ({by} ORDER BY capacity::DOUBLE / weight::DOUBLE, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
  sum(weight) OVER ({by} ORDER BY capacity::DOUBLE / weight::DOUBLE, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM {name}0),
{name}2 AS (SELECT *, capacity * weights <= weight * (budget - spent) AS short FROM {name}1),
{name}3 AS (SELECT *, budget - coalesce(sum(capacity) FILTER (short) OVER ({by}), 0) AS remain, sum(weight) FILTER (NOT short) OVER ({by}) AS rest FROM {name}2),
{name}4 AS (SELECT *, CASE WHEN short THEN capacity ELSE (weight * remain) // rest END AS part FROM {name}3),
{name}5 AS (SELECT *, remain - sum(part) FILTER (NOT short) OVER ({by}) AS over_,
  row_number() OVER ({by} ORDER BY short, capacity::DOUBLE / weight::DOUBLE DESC, {child} DESC) AS r FROM {name}4),
{name} AS (SELECT {keys}, (part + CASE WHEN NOT short AND r <= over_ THEN 1 ELSE 0 END)::HUGEINT AS budget FROM {name}5)"""


ORACLE_SQL = f"""
WITH each AS (
  SELECT doc_id, 'dom' || (('0x' || substr(md5(source), 1, 8))::BIGINT % 4) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens FROM each GROUP BY ALL),
root AS (SELECT floor({SHARE} * sum(tokens))::HUGEINT AS budget FROM leaves),{_level_sql("a", "root", ["domain"])},{_level_sql("b", "a", ["domain", "lang"])},{_level_sql("c", "b", ["domain", "lang", "source"])},
met AS (SELECT each.*, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs, tokens FROM each JOIN leaves USING (domain, lang, source) JOIN c USING (domain, lang, source)),
hashed AS (SELECT *, ('0x' || substr(md5('{SEED}:' || epochs || ':' || doc_id), 1, 15))::BIGINT AS o FROM met),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY o, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM hashed)
SELECT doc_id, domain, lang, source, n_tokens, budget::BIGINT AS leaf_budget, (epochs + CASE WHEN epochs * tokens < budget AND s <= budget - epochs * tokens THEN 1 ELSE 0 END)::BIGINT AS copies FROM run"""
