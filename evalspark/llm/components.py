"""Connected components of a link table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import materialise


def _distinct_links(links: DataFrame) -> DataFrame:
    a, b = F.least("a", "b"), F.greatest("a", "b")
    return links.select(a.alias("a"), b.alias("b")).filter("a <> b").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``links``; a component is named by its
    smallest node.

    Each round hooks a node to its smallest neighbour and then to that node's
    own, renames the ends of all links, and drops those that have become loops
    or repeats.  Star-shaped links vanish in a round or two, and the rounds
    work on ever fewer links.  Only aggregates with map-side combining and
    joins against one row per node are used, so a node with very many links is
    no single task's work.  Every round is written to the shared folder.
    """
    every = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    alone = every.filter("a = b").select(F.col("a").alias("node")).distinct()
    left = materialise(_distinct_links(every), "links")
    hooks = []
    while left.limit(1).count():
        both = (left.select(F.col("a").alias("node"), F.col("b").alias("other"))
                .unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other"))))
        hook = materialise(both.groupBy("node").agg(F.min("other").alias("other"))
                           .select("node", F.least("node", "other").alias("up")), "components")
        upper = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hook = materialise(hook.join(upper, "up").select("node", F.col("top").alias("component")), "components")
        to = lambda c: hook.select(F.col("node").alias(c), F.col("component").alias(f"{c}_to"))
        left = materialise(_distinct_links(
            left.join(to("a"), "a").join(to("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))),
            "links")
        hooks.append(hook)
    # Names are put together from the last round back, smallest table first.
    names = alone.select("node", F.col("node").alias("component")).limit(0)
    for hook in reversed(hooks):
        above = names.select(F.col("node").alias("component"), F.col("component").alias("name"))
        names = materialise(hook.join(above, "component", "left")
                            .select("node", F.coalesce("name", "component").alias("component")), "components")
    lone = alone.join(names, "node", "left_anti").select("node", F.col("node").alias("component"))
    return names.unionByName(lone)


def add_links(names: DataFrame, links: DataFrame) -> DataFrame:
    """``names`` after more links (a, b): only the classes they touch are joined anew."""
    to = lambda c: names.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    classes = (links.join(to("a"), "a", "left").join(to("b"), "b", "left")
               .select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b")))
    fresh = connected_components(classes)
    moved = fresh.select(F.col("node").alias("component"), F.col("component").alias("name"))
    new = fresh.join(names.select("node"), "node", "left_anti")
    return materialise(names.join(moved, "component", "left")
                       .select("node", F.coalesce("name", "component").alias("component"))
                       .unionByName(new), "components")
