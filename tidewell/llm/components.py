"""Connected components over a table of links, by hooking labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """node, component for every node of ``links`` (a, b): the smallest node reachable.

    Each round hooks every label to the least label linked to it, follows the hooks to their ends
    and draws the links anew between the labels that are left. Two rounds at least halve the labels
    that still have links, whatever the order of the ids, and hooks in a row halve with each jump;
    the loop ends when no link is left. Every step ends in a written table. A hub's neighbours are
    combined before the shuffle. Self links and repeated links are fine; an empty table gives none.
    """
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        hooks = _followed(materialize(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")), "hooks"))
        # the first hooks name every node; later ones only labels that still had links
        if labels is None:
            labels = materialize(hooks.select("node", "component"), "labels")
        else:
            up = hooks.select(F.col("node").alias("component"), F.col("component").alias("end"))
            renamed = materialize(labels.join(up, "component", "left").select("node", F.coalesce("end", "component").alias("component")), "labels")
            discard(labels)
            labels = renamed
        a, b = (hooks.select(F.col("node").alias(x), F.col("component").alias(f"to_{x}")) for x in "ab")
        drawn = edges.join(a, "a").join(b, "b").filter("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        left = materialize(drawn, "links")
        discard(edges, hooks)
        edges = left
        if edges.limit(1).count() == 0:
            discard(edges)
            return labels


def _followed(hooks: DataFrame) -> DataFrame:
    """node, component with every chain of components followed to its end."""
    while True:
        up = hooks.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        stepped = materialize(hooks.join(up, "component").select("node", F.col("jump").alias("component"), F.col("component").alias("was")), "hooks")
        discard(hooks)
        hooks = stepped
        if hooks.filter("component <> was").limit(1).count() == 0:
            return hooks
