"""Reports: fixture evaluation, workspace counters, debug reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import NEUTRAL


def evaluate_cases(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Cases (name, min_pages, max_pages, max_weak) against results (name, pages, weak).

    A case without a result is skipped; null bounds don't bind. ``detail`` lists the failures.
    """
    out = cases.join(results, "name", "left")
    low = F.when(F.col("pages") < F.col("min_pages"), F.format_string("pages %d < min %d", "pages", "min_pages"))
    high = F.when(F.col("pages") > F.col("max_pages"), F.format_string("pages %d > max %d", "pages", "max_pages"))
    weak = F.when(F.col("weak") > F.col("max_weak"), F.format_string("weak_pages %d > max %d", "weak", "max_weak"))
    failures = F.array_compact(F.array(low, high, weak))
    skipped = F.col("pages").isNull()
    detail = F.when(skipped, "skipped").otherwise(F.concat(F.format_string("pages=%d weak_pages=%d", "pages", "weak"), F.when(F.size(failures) > 0, F.concat(F.lit(" failures="), F.array_join(failures, ", "))).otherwise("")))
    return out.select("name", skipped.alias("skipped"), (~skipped & (F.size(failures) == 0)).alias("passed"), detail.alias("detail"))


def summarize(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(F.count("*").alias("cases"), F.count_if(~F.col("skipped")).alias("executed"), F.count_if(F.col("passed") & ~F.col("skipped")).alias("passed"))


def workspace_stats(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: sessions, ready jobs, pages shown, pages deleted, manual pages."""
    p = pages.agg(F.count_if(~F.col("deleted")).alias("visible_pages"), F.count_if("deleted").alias("deleted_pages"), F.count_if("manual").alias("manual_pages"))
    j = jobs.agg(F.count("*").alias("sessions"), F.count_if(F.col("status") == "ready").alias("ready_jobs"))
    # two tables of one row each
    return j.withColumn("k", F.lit(1)).join(F.broadcast(p.withColumn("k", F.lit(1))), "k").drop("k")


def job_counters(pages: DataFrame) -> DataFrame:
    """Per job: pages shown, deleted, manual and turned."""
    counts = {"active": ~F.col("deleted"), "deleted": F.col("deleted"), "manual": F.col("manual"), "rotated": F.col("rotation") != 0}
    return pages.groupBy("job").agg(*[F.count_if(c).alias(f"{k}_pages") for k, c in counts.items()])


def frame_summaries(frames: DataFrame) -> DataFrame:
    """Per job the frames' summaries in order: index, time, score and reasons, nested as a report shows them."""
    row = F.struct(F.col("idx").alias("frame_index"), F.col("t").alias("timestamp"), "score", F.col("reasons").alias("rejection_reasons"))
    return frames.groupBy("job").agg(F.array_sort(F.collect_list(row)).alias("frames"))


def transition_stats(marked: DataFrame, members: DataFrame) -> DataFrame:
    """Per job: largest deltas, transitions found, segments kept (what a segmentation run logs)."""
    m = marked.groupBy("job").agg(F.max("change_ratio").alias("max_change"), F.max("mean_diff").alias("max_diff"), F.max("hash_distance").alias("max_hash"), F.count_if("is_transition").alias("transitions"))
    n = members.groupBy("job").agg(F.countDistinct("seg_no").alias("segments"))
    return m.join(n, "job", "left").withColumn("segments", F.coalesce("segments", F.lit(0)))


def export_rows(pages: DataFrame) -> DataFrame:
    """Active stored pages as export rows: neutral quality, an error where a page has no image.

    Stored pages carry no measures, so those of a perfect page stand in.
    """
    path = F.coalesce("image_path", F.raise_error(F.concat(F.lit("page without image: "), F.col("id").cast("string"))).cast("string"))
    neutral = {k: F.lit(v) for k, v in NEUTRAL.items()} | {"score": F.lit(1.0), "phash": F.lit("0"), "rejected": F.lit(False)}
    return pages.where(~F.col("deleted")).select("job", "id", "order_index", "rotation", path.alias("image_path")).withColumns(neutral)


def first_of_job(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First ``n`` rows of each job in a stated order, numbered from 1 as ``place`` (debug images)."""
    place = F.row_number().over(Window.partitionBy("job").orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= n)
