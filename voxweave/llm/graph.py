"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, label): label is the least node of each component; nodes with edges only.

    Rounds of hooking and contraction: each node hooks to the least node among itself
    and its neighbours, hooks are followed twice, and edges are rewritten between the
    hooks. Each round's tables are written and read back: they stay distributed, outlive
    executors, and the next round is planned with their real sizes.
    """
    live = as_table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "graph-edges")
    known = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = as_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("up")), "graph-hooks")
        for _ in range(2):
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            hook = hook.join(above, "up").select("node", F.col("upper").alias("up"))
        hook = as_table(hook, "graph-hooks")
        if known is None:
            known = hook.withColumnRenamed("up", "label")
        else:
            # `hook` need not know every label: one that has no edges left stays
            step = hook.select(F.col("node").alias("label"), "up")
            known = as_table(known.join(step, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "graph-labels")
        a = hook.select(F.col("node").alias("a"), F.col("up").alias("new_a"))
        b = hook.select(F.col("node").alias("b"), F.col("up").alias("new_b"))
        moved = live.join(a, "a").join(b, "b").where("new_a <> new_b")
        live = as_table(moved.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct(), "graph-edges")
    if known is None:
        return live.select(F.col("a").alias("node"), F.col("a").alias("label"))
    return known


def contract(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, label) after further links (a, b) have joined components; labels are least nodes."""
    if labels is None:
        return components(links)
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    merged = components(named.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")))
    if merged.isEmpty():
        return labels
    step = merged.select(F.col("node").alias("label"), F.col("label").alias("upper"))
    moved = labels.join(step, "label", "left").select("node", F.coalesce("upper", "label").alias("label"))
    return as_table(moved.unionByName(merged.join(labels, "node", "left_anti")), "graph-labels")
