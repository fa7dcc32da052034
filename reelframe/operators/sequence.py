"""Clusters of neighbouring, similar pages and their representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import DEFAULT


def order_window() -> WindowSpec:
    return Window.partitionBy("job").orderBy("start", "ord")


def sequence_clusters(pages: DataFrame, similarity: Column, window: float = DEFAULT.cluster_window_seconds, least: float = DEFAULT.min_cluster_similarity) -> DataFrame:
    """Adds cluster: a page opens one unless it follows its predecessor closely and resembles it.

    ``similarity`` compares a page with its predecessor in (start, ord) order. Chaining is on the
    immediate predecessor, so clusters are gaps and islands.
    """
    joins = (F.col("start") - F.lag("end").over(order_window()) <= window) & (similarity >= least)
    opens = F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)
    # the similarity may hold windows of its own, so the flag is a column before it is summed
    flagged = pages.withColumn("_opens", opens)
    return flagged.withColumn("cluster", F.sum("_opens").over(order_window().rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_opens")


def cluster_representatives(clustered: DataFrame, rank: Column, bad: Column, penalty: float = DEFAULT.bad_neighbour_penalty) -> DataFrame:
    """One page of each cluster: highest rank after penalties for bad neighbours; ties to the first.

    A side costs the penalty if exactly one of the two is bad, 0.35 of it if both are.
    """
    w = Window.partitionBy("job", "cluster").orderBy("start", "ord")
    df = clustered.withColumns({"_bad": bad, "_rank": rank})
    side = lambda other: F.when(other.isNull(), 0.0).when(F.col("_bad") & other, penalty * 0.35).when(F.col("_bad") | other, penalty).otherwise(0.0)
    df = df.withColumn("sequence_score", F.col("_rank") - side(F.lag("_bad").over(w)) - side(F.lead("_bad").over(w)))
    top = F.row_number().over(Window.partitionBy("job", "cluster").orderBy(F.desc("sequence_score"), "start", "ord"))
    best = df.withColumn("_top", top).where("_top = 1").drop("_top", "_bad", "_rank")
    return best.withColumn("page_number", F.row_number().over(Window.partitionBy("job").orderBy("cluster")).cast("long"))
