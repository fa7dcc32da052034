"""Stable segments of frame sequences.

Frames have columns job, idx, t, rejected and per-frame signals. Every window is partitioned by job
and ordered by idx, so the whole chain from deltas to segments shares one shuffle; the one
order-dependent fold (split suppression) runs over the few split candidates of a job. Each sort holds
a task's rows, so windows that follow each other ask for one and the same order. ``order`` names columns
that order a job's frames as idx does, for frames that already lie in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import SCREEN, ModeSettings

#: Kept splits that a step of the fold may copy.
BLOCK = 128
IDX = ("idx",)


def job_window() -> WindowSpec:
    return Window.partitionBy("job")


def order_window(order: tuple[str, ...] = IDX) -> WindowSpec:
    return job_window().orderBy(*order)


def whole(window: WindowSpec) -> WindowSpec:
    """All rows of an ordered window's partition, under the same sort."""
    return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def frame_deltas(frames: DataFrame, change: Column, diff: Column, distance: Column) -> DataFrame:
    """Adds change_ratio, mean_diff, hash_distance and transition_score against the previous frame.

    ``change``, ``diff`` and ``distance`` compare a frame with ``lag``-ged columns; a job's first
    frame has change ratio 0 and no other delta.
    """
    out = frames.withColumns({"change_ratio": change, "mean_diff": diff, "hash_distance": distance})
    out = out.withColumn("transition_score", 0.7 * F.col("change_ratio") + 0.3 * F.col("mean_diff"))
    return out.withColumn("change_ratio", F.coalesce("change_ratio", F.lit(0.0)))


def threshold_columns(config: ModeSettings) -> dict[str, Column]:
    """Adaptive thresholds and spacing of a job as partition-wide windows."""
    score, diff = F.col("transition_score"), F.col("mean_diff")
    gap = F.greatest(F.col("t") - F.col("previous_t"), F.lit(0.001))
    spacing = F.coalesce(F.median(F.when(F.col("previous_t").isNotNull(), gap)).over(job_window()), F.lit(0.25))
    few = F.greatest(F.lit(1).cast("long"), F.bround(config.min_seconds / F.greatest(spacing, F.lit(0.001))).cast("long"))
    quartile = F.percentile("hash_distance", F.lit(0.75)).over(job_window()).cast("long")
    return {
        "score_limit": F.greatest(F.lit(config.max_change_ratio), F.avg(score).over(job_window()) + 0.9 * F.stddev_pop(score).over(job_window())),
        "hash_limit": F.greatest(F.lit(config.hash_distance_threshold).cast("long"), quartile),
        "diff_limit": F.greatest(F.lit(config.mean_diff_threshold), F.avg(diff).over(job_window()) + 0.75 * F.stddev_pop(diff).over(job_window())),
        "spacing": spacing,
        "min_frames": F.when(F.count("*").over(job_window()) == 1, F.lit(1).cast("long")).otherwise(few),
    }


def with_thresholds(deltas: DataFrame, config: ModeSettings = SCREEN, order: tuple[str, ...] = IDX) -> DataFrame:
    return deltas.withColumn("previous_t", F.lag("t").over(order_window(order))).withColumns(threshold_columns(config)).drop("previous_t")


def adaptive_thresholds(deltas: DataFrame, config: ModeSettings = SCREEN, order: tuple[str, ...] = IDX) -> DataFrame:
    """One row a job: score_limit, hash_limit, diff_limit, spacing, min_frames.

    Grouped rather than windowed: the frames themselves are not needed.
    """
    gap = F.greatest(F.col("t") - F.col("previous_t"), F.lit(0.001))
    g = deltas.withColumn("previous_t", F.lag("t").over(order_window(order))).groupBy("job")
    spacing = F.coalesce(F.median(F.when(F.col("previous_t").isNotNull(), gap)), F.lit(0.25))
    out = g.agg(
        F.count("*").alias("n"),
        (F.avg("transition_score") + 0.9 * F.stddev_pop("transition_score")).alias("s"),
        F.percentile("hash_distance", F.lit(0.75)).cast("long").alias("h"),
        (F.avg("mean_diff") + 0.75 * F.stddev_pop("mean_diff")).alias("d"),
        spacing.alias("spacing"),
    )
    few = F.greatest(F.lit(1).cast("long"), F.bround(config.min_seconds / F.greatest("spacing", F.lit(0.001))).cast("long"))
    return out.select(
        "job",
        F.greatest(F.lit(config.max_change_ratio), "s").alias("score_limit"),
        F.greatest(F.lit(config.hash_distance_threshold).cast("long"), "h").alias("hash_limit"),
        F.greatest(F.lit(config.mean_diff_threshold), "d").alias("diff_limit"),
        "spacing",
        F.when(F.col("n") == 1, F.lit(1).cast("long")).otherwise(few).alias("min_frames"),
    )


def with_transitions(limited: DataFrame, order: tuple[str, ...] = IDX) -> DataFrame:
    """Adds is_transition: a local peak of the score (plateaus count) over any adaptive limit."""
    s = F.col("transition_score")
    peak = (s >= F.coalesce(F.lag("transition_score").over(order_window(order)), F.lit(-1.0))) & (s >= F.coalesce(F.lead("transition_score").over(order_window(order)), F.lit(-1.0)))
    over = (s >= F.col("score_limit")) | (F.col("hash_distance") >= F.col("hash_limit")) | (F.col("mean_diff") >= F.col("diff_limit"))
    return limited.withColumn("is_transition", F.coalesce(peak & over, F.lit(False)))


def suppress(candidates: Column, min_gap: Column) -> Column:
    """Split indices kept of ordered (idx, score) candidates.

    A candidate nearer than ``min_gap`` to the last kept split replaces it if its score is strictly
    higher, else falls; the gap is measured from the split that stands at that moment.
    """
    kind = "array<struct<idx: bigint, score: double>>"
    # kept splits lie in full blocks and an open one, so that no step copies them all
    start = F.struct(F.array().cast(f"array<{kind}>").alias("full"), F.array().cast(kind).alias("open"))

    def step(state: Column, c: Column) -> Column:
        kept = state["open"]
        last = F.element_at(kept, -1)
        near = (F.size(kept) > 0) & (c["idx"] - last["idx"] < min_gap)
        swapped = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(c))
        full = F.struct(F.concat(state["full"], F.array(kept)).alias("full"), F.array(c).alias("open"))
        same = lambda items: F.struct(state["full"].alias("full"), items.alias("open"))
        return F.when(near & (c["score"] > last["score"]), same(swapped)).when(near, state).when(F.size(kept) >= BLOCK, full).otherwise(same(F.concat(kept, F.array(c))))

    done = F.aggregate(candidates, start, step, lambda s: F.concat(F.flatten(s["full"]), s["open"]))
    return F.transform(done, lambda x: x["idx"])


def nms_splits(marked: DataFrame, order: tuple[str, ...] = IDX) -> DataFrame:
    """(job, idx) of the splits kept.

    A candidate that lies ``min_frames`` or more behind the candidate before it lies as far behind every
    split kept so far, so it is kept whatever came before: the fold runs over each run between such gaps.
    """
    gap = F.greatest(F.lit(1).cast("long"), F.col("min_frames"))
    c = marked.where("is_transition").select("job", F.col("idx").cast("long").alias("idx"), F.col("transition_score").alias("score"), gap.alias("gap"), *[n for n in order if n != "idx"])
    opens = F.coalesce(F.col("idx") - F.lag("idx").over(order_window(order)) >= F.col("gap"), F.lit(True))
    c = c.withColumn("run", F.sum(opens.cast("long")).over(order_window(order).rowsBetween(Window.unboundedPreceding, 0)))
    g = c.groupBy("job", "run").agg(F.array_sort(F.collect_list(F.struct("idx", "score"))).alias("c"), F.max("gap").alias("m"))
    return g.select("job", F.explode(suppress(F.col("c"), F.col("m"))).alias("idx"))


def with_splits(marked: DataFrame, order: tuple[str, ...] = IDX) -> DataFrame:
    """Adds is_split: the splits are sorted in among the frames, each just before its own, in one pass."""
    splits = nms_splits(marked, order).select("job", F.col("idx").cast(marked.schema["idx"].dataType).alias("idx"), F.lit(True).alias("_split"))
    both = marked.withColumn("_split", F.lit(False)).unionByName(splits, allowMissingColumns=True)
    before = F.lag("_split").over(job_window().orderBy("idx", F.desc("_split")))
    return both.withColumn("is_split", F.coalesce(before, F.lit(False))).where("not _split").drop("_split")


def segment_frames(split: DataFrame, config: ModeSettings = SCREEN) -> DataFrame:
    """Frames of kept segments with seg_no, start, end, n, mean_change_ratio and is_candidate.

    A segment is dropped if it is both short and has few frames, or if all its frames are rejected.
    Candidates leave out the first and last of more than two frames, then the rejected ones if any
    other is left. A job none of whose segments is long enough is one segment as a whole.
    """
    raw = split.withColumn("part", F.sum(F.col("is_split").cast("long")).over(order_window().rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy("job", "part").orderBy("idx")
    sized = raw.withColumns({
        "n": F.count("*").over(whole(w)), "start": F.min("t").over(whole(w)), "end": F.max("t").over(whole(w)),
        "place": F.row_number().over(w), "usable": F.max((~F.col("rejected")).cast("int")).over(whole(w)) == 1,
    })
    kept = ~((F.col("end") - F.col("start") < config.min_seconds) & (F.col("n") < F.col("min_frames"))) & F.col("usable")
    sized = sized.withColumn("kept", kept)
    some = F.max(F.col("kept").cast("int")).over(job_window()) == 1
    # parts follow each other as their frames do, so this is the order of idx under the sort of w
    again, placed = job_window(), job_window().orderBy("part", "idx")
    all_in = sized.withColumn("some", some).withColumns({
        "n": F.when(F.col("some"), F.col("n")).otherwise(F.count("*").over(again)),
        "start": F.when(F.col("some"), F.col("start")).otherwise(F.min("t").over(again)), "end": F.when(F.col("some"), F.col("end")).otherwise(F.max("t").over(again)),
        "place": F.when(F.col("some"), F.col("place")).otherwise(F.row_number().over(placed)),
        "kept": F.when(F.col("some"), F.col("kept")).otherwise(F.max((~F.col("rejected")).cast("int")).over(again) == 1),
    }).where("kept").drop("kept", "usable")
    inner = (F.col("n") <= 2) | ((F.col("place") > 1) & (F.col("place") < F.col("n")))
    of_segment = lambda f, c: F.when(F.col("some"), f(c).over(whole(w))).otherwise(f(c).over(again))
    out = all_in.withColumn("inner", inner)
    out = out.withColumns({"accepted": of_segment(F.max, (F.col("inner") & ~F.col("rejected")).cast("int")) == 1, "mean_change_ratio": of_segment(F.avg, "change_ratio")})
    out = out.withColumn("is_candidate", F.col("inner") & (~F.col("rejected") | ~F.col("accepted")))
    number = F.when(F.col("some"), F.dense_rank().over(job_window().orderBy("part"))).otherwise(1)
    return out.withColumn("seg_no", number.cast("long")).drop("inner", "accepted", "place", "part", "some")


def stable_segments(members: DataFrame) -> DataFrame:
    """One row a segment."""
    g = members.groupBy("job", "seg_no")
    return g.agg(F.first("start").alias("start"), F.first("end").alias("end"), F.first("n").alias("n"), F.sum(F.col("is_candidate").cast("long")).alias("n_candidates"), F.first("mean_change_ratio").alias("mean_change_ratio"))
