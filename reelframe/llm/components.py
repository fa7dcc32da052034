"""Connected components of an edge table by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, shared


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): all nodes of a component share one root.

    Each round hooks every node to its smallest neighbour, jumps twice and contracts the edges, so
    that the edges left shrink round by round; nothing but their number reaches the driver. Each
    round's tables are written to the shared folder, which cuts the lineage; those of the round before go.
    """
    left = shared(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    roots: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = shared(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up")), "hooks")
        up = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = shared(hook.join(up, "up").select("node", F.col("top").alias("up")), "jumps")
        up = jumped.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = shared(jumped.join(up, "up").select("node", F.col("top").alias("root")), "roots")
        ends = left.join(step.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        contracted = shared(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        free(left, hook, jumped)
        left = contracted
        if roots is None:
            roots = step
        else:
            later = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
            joined = shared(roots.join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
            free(roots, step)
            roots = joined
    return roots if roots is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
