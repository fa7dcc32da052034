"""Best frame of each segment, with ties to the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def soft_filter(df: DataFrame, keys: list[str], rejected: str = "rejected") -> DataFrame:
    """Accepted rows of each group; all rows of a group that has none."""
    some = F.max((~F.col(rejected)).cast("int")).over(Window.partitionBy(*keys)) == 1
    return df.withColumn("_some", some).where(~F.col(rejected) | ~F.col("_some")).drop("_some")


def top_one(df: DataFrame, keys: list[str], rank: Column, tie: str) -> DataFrame:
    """Row of highest rank of each group; of equals the one with the least ``tie``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(rank.desc(), F.col(tie).asc()))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def best_frames(members: DataFrame, rank: Column) -> DataFrame:
    """Pages from segment members: the best candidate frame, its label and notes."""
    # one sort for both: the count takes all rows of the window that places them
    w = Window.partitionBy("job", "seg_no").orderBy(F.col("rank").desc(), F.col("idx").asc())
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pool = members.where("is_candidate").withColumn("rank", rank).withColumns({"n_candidates": F.count("*").over(every), "_place": F.row_number().over(w)})
    best = pool.where("_place = 1").drop("_place")
    notes = F.array(
        F.format_string("Selected from %d candidate frames.", F.col("n_candidates")),
        F.format_string("Segment stability delta: %.4f", F.col("mean_change_ratio")),
    )
    return best.withColumns({"page_id": F.concat(F.lit("page-"), F.col("seg_no")), "label": F.concat(F.lit("Page "), F.col("seg_no")), "notes": notes})
