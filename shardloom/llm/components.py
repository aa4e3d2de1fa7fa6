"""Connected components of a link table, by contraction.

Each round hooks every root to its smallest neighbour, shortens the pointers,
and contracts the links; a written table cuts the lineage of each round. All
joins are on node ids, and no component is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b long): root is the same throughout a component."""
    edges = materialize(_both(links), "edges")
    roots = None
    while not edges.isEmpty():
        # a root points to its smallest neighbour if that is smaller than itself
        hooks = edges.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("node"), F.least("a", "b").alias("root")
        )
        hooks = materialize(hooks, "hooks")
        for _ in range(2):
            hooks = _jump(hooks, hooks)
        hooks = materialize(hooks, "hooks")
        roots = hooks if roots is None else materialize(_jump(roots, hooks), "roots")
        edges = (
            edges.join(hooks.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
            .join(hooks.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
            .filter("x <> y")
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
            .distinct()
        )
        edges = materialize(edges, "edges")
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return roots


def _both(links: DataFrame) -> DataFrame:
    return (
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    )


def _jump(pointers: DataFrame, hooks: DataFrame) -> DataFrame:
    """Pointers one step further along hooks."""
    step = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return pointers.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
