"""Frame sampling and lookups by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_interval(fps: Column, sample_fps: Column) -> Column:
    """Frames between samples; half a frame rounds to even."""
    return F.greatest(F.bround(fps / F.greatest(sample_fps, F.lit(0.25))).cast("long"), F.lit(1).cast("long"))


def sample_frames(frames: DataFrame, fps: Column, sample_fps: Column) -> DataFrame:
    """Every ``interval``-th frame of each job."""
    return frames.where(F.col("idx") % sample_interval(fps, sample_fps) == 0)


def require_frames(frames: DataFrame) -> DataFrame:
    """``frames`` unchanged; ValueError if there are none."""
    if frames.isEmpty():
        raise ValueError("no frames could be sampled")
    return frames


def job_metadata(frames: DataFrame) -> DataFrame:
    """job, frame_count, fps, duration: one row a job from its first and last frame times."""
    g = frames.groupBy("job").agg(F.count("*").alias("frame_count"), F.min("t").alias("first"), F.max("t").alias("last"))
    fps = F.when(F.col("last") > F.col("first"), (F.col("frame_count") - 1) / (F.col("last") - F.col("first")))
    return g.select("job", "frame_count", fps.alias("fps"), (F.col("frame_count") / fps).alias("duration"))


def nearest_frame(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each (job, wanted_t) the frame nearest to the time clamped to the job's span; the earlier of two.

    Both sides are merged by time and scanned once in each direction per job (last frame before, first
    frame after), so no pair of a request and a frame is formed.
    """
    span = Window.partitionBy("job")
    f = frames.select("job", "t", "idx", F.lit(None).cast("double").alias("wanted_t"))
    w = wanted.select("job", F.lit(None).cast("double").alias("t"), F.lit(None).cast("long").alias("idx"), "wanted_t")
    both = f.unionByName(w).withColumn("at", F.when(F.col("wanted_t").isNull(), F.col("t")).otherwise(F.least(F.greatest("wanted_t", F.min("t").over(span)), F.max("t").over(span))))
    # frames sort before requests of the same time
    order = [F.col("at"), F.col("wanted_t").isNotNull(), F.col("idx")]
    seen = F.when(F.col("idx").isNotNull(), F.struct("t", "idx"))
    before = F.last(seen, True).over(span.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # the first frame behind is the last one met when the order is read backwards
    after = F.last(seen, True).over(span.orderBy(*[o.desc() for o in order]).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"before": before, "after": after}).where("wanted_t is not null and (before is not null or after is not null)")
    left = F.col("after").isNull() | (F.col("before").isNotNull() & (F.col("at") - F.col("before.t") <= F.col("after.t") - F.col("at")))
    hit = F.when(left, F.col("before")).otherwise(F.col("after"))
    return both.select("job", "wanted_t", hit["idx"].alias("idx"), hit["t"].alias("t"))
