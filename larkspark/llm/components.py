"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

#: Up to this counted number of links, a round's tables are one file each; beyond it the engine deals them.
FEW = 200_000


def _together(df: DataFrame, rows: int) -> DataFrame:
    """df, which has at most so many rows, in one partition if they are few."""
    return df.coalesce(1) if rows <= FEW else df


def _roots(hooks: DataFrame, rows: int) -> DataFrame:
    """hooks: node, component (a smaller node or itself). Follows them to their ends, twice as far each round."""
    while True:
        to = hooks.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        new = cut(_together(hooks.join(to, "component").select("node", F.col("component").alias("was"), F.col("beyond").alias("component")), rows), "hooks")
        drop(hooks)
        hooks = new.select("node", "component")
        hooks.shared_path = new.shared_path
        if new.filter("was <> component").isEmpty():
            return hooks


def connected_components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns node, component (the smallest node reachable) for every node that has a link.

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots and contracts the
    links to links between roots, so settled nodes drop out and the graph shrinks at least by half. A node with
    many links costs no task more than others: its smallest neighbour is found with partial aggregates, and the
    joins on it have plain exchanges on both sides, which the engine splits. Neither links nor labels go to the
    driver; each round's tables are deleted after the next one. links is read once.
    """
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("link")
    edges = cut(links.filter("a <> b").select(both).select("link.a", "link.b").distinct(), "edges")
    known, rows = None, edges.count()
    first = rows
    while True:
        hooks = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component"))
        hooks = _roots(cut(_together(hooks, rows), "hooks"), rows)
        one, two = (hooks.select(F.col("node").alias(x), F.col("component").alias(f"r{x}")) for x in "ab")
        left = cut(_together(edges.join(one, "a").select("ra", "b").join(two, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b").distinct(), rows), "edges")
        drop(edges)
        edges, rows = left, left.count()
        if known is not None:  # what was hooked before follows its root to the new one
            further = hooks.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
            new = cut(_together(known.join(further, "component", "left").select("node", F.coalesce("beyond", "component").alias("component")), first), "components")
            drop(known, hooks)
            hooks = new
        known = hooks
        if not rows:
            drop(edges)
            return known
