"""Frame queries: deltas, thresholds, splits, segments, best frames, sampling, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import mode_settings
from ..functions import scores
from ..operators import report, sampling, segments, selection
from .views import EVENT_CONFIG, FRAME_ORDER, FRAMES_SQL, frames, ordered_frames

C = EVENT_CONFIG


def _r(x, n: int = 6):
    return F.round(x, n)


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = lambda c: F.lag(c).over(segments.order_window(FRAME_ORDER))
    return segments.frame_deltas(
        ordered_frames(spark, sf_dir),
        F.abs(F.col("value") - before("value")) / 500.0,
        F.abs(F.col("sod") - before("sod")) / 86400.0,
        F.bit_count(F.col("code").bitwiseXOR(before("code"))).cast("long"),
    )


DELTAS_SQL = f"""{FRAMES_SQL},
d0 AS (SELECT *, abs(value - lag(value) OVER w) / 500.0::DOUBLE AS ch, abs(sod - lag(sod) OVER w) / 86400.0::DOUBLE AS mean_diff,
  CAST(bit_count(xor(code, lag(code) OVER w)) AS BIGINT) AS hash_distance, lag(t) OVER w AS pt FROM f WINDOW w AS (PARTITION BY job ORDER BY idx)),
d AS (SELECT *, 0.7::DOUBLE * ch + 0.3::DOUBLE * mean_diff AS s, coalesce(ch, 0) AS change_ratio FROM d0)"""
LIMITS_SQL = f"""{DELTAS_SQL},
l0 AS (SELECT job, count(*) AS n, greatest({C.max_change_ratio}, avg(s) + 0.9::DOUBLE * stddev_pop(s)) AS score_limit,
  greatest({C.hash_distance_threshold}, CAST(floor(quantile_cont(hash_distance, 0.75)) AS BIGINT)) AS hash_limit,
  greatest({C.mean_diff_threshold}, avg(mean_diff) + 0.75::DOUBLE * stddev_pop(mean_diff)) AS diff_limit,
  coalesce(median(greatest(t - pt, 0.001::DOUBLE)) FILTER (pt IS NOT NULL), 0.25) AS spacing FROM d GROUP BY job),
l AS (SELECT *, CASE WHEN n = 1 THEN 1 ELSE greatest(1, CAST(round_even({C.min_seconds}::DOUBLE / greatest(spacing, 0.001), 0) AS BIGINT)) END AS min_frames FROM l0)"""
MARKS_SQL = f"""{LIMITS_SQL},
m AS (SELECT d.*, l.min_frames, coalesce(s >= coalesce(lag(s) OVER w, -1) AND s >= coalesce(lead(s) OVER w, -1)
  AND (s >= score_limit OR hash_distance >= hash_limit OR mean_diff >= diff_limit), false) AS hit FROM d JOIN l USING (job) WINDOW w AS (PARTITION BY job ORDER BY idx)),
c AS (SELECT job, idx, s, min_frames AS gap, row_number() OVER (PARTITION BY job ORDER BY idx) AS rn FROM m WHERE hit)"""
SPLITS_SQL = f"""{MARKS_SQL},
st AS (SELECT job, rn, idx AS li, s AS ls, true AS new FROM c WHERE rn = 1 UNION ALL
  SELECT c.job, c.rn, CASE WHEN c.idx - li >= gap OR c.s > ls THEN c.idx ELSE li END, CASE WHEN c.idx - li >= gap OR c.s > ls THEN c.s ELSE ls END, c.idx - li >= gap
  FROM st JOIN c ON c.job = st.job AND c.rn = st.rn + 1),
k AS (SELECT job, li AS idx FROM (SELECT *, lead(new) OVER (PARTITION BY job ORDER BY rn) AS nx FROM st) WHERE nx IS NULL OR nx)"""
MEMBERS_SQL = f"""{SPLITS_SQL},
p1 AS (SELECT m.*, sum(CASE WHEN k.idx IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY m.job ORDER BY m.idx ROWS UNBOUNDED PRECEDING) AS part FROM m LEFT JOIN k ON k.job = m.job AND k.idx = m.idx),
p2 AS (SELECT *, count(*) OVER w AS n, min(t) OVER w AS a, max(t) OVER w AS b, row_number() OVER (PARTITION BY job, part ORDER BY idx) AS place, bool_or(NOT rejected) OVER w AS usable FROM p1 WINDOW w AS (PARTITION BY job, part)),
p3 AS (SELECT *, NOT (b - a < {C.min_seconds} AND n < min_frames) AND usable AS kept FROM p2),
p4 AS (SELECT * FROM p3 WHERE kept UNION ALL
  SELECT * REPLACE (0 AS part, count(*) OVER j AS n, min(t) OVER j AS a, max(t) OVER j AS b, idx + 1 AS place, bool_or(NOT rejected) OVER j AS kept) FROM p3
  WHERE job NOT IN (SELECT job FROM p3 WHERE kept) WINDOW j AS (PARTITION BY job)),
p5 AS (SELECT *, n <= 2 OR (place > 1 AND place < n) AS inside FROM p4 WHERE kept),
p6 AS (SELECT *, bool_or(inside AND NOT rejected) OVER (PARTITION BY job, part) AS acc, avg(change_ratio) OVER (PARTITION BY job, part) AS mcr, dense_rank() OVER (PARTITION BY job ORDER BY part) AS seg_no FROM p5),
mem AS (SELECT *, inside AND (NOT rejected OR NOT acc) AS cand FROM p6)"""


def frame_deltas(spark, sf_dir):
    d, zero = deltas(spark, sf_dir), lambda c: F.coalesce(F.col(c), F.lit(0))
    return d.select("job", "idx", _r(F.col("change_ratio")).alias("change_ratio"), _r(zero("mean_diff")).alias("mean_diff"), zero("hash_distance").cast("long").alias("hash_distance"), _r(zero("transition_score")).alias("transition_score"))


def adaptive_thresholds(spark, sf_dir):
    a = segments.adaptive_thresholds(deltas(spark, sf_dir), C, FRAME_ORDER)
    return a.select("job", *[_r(F.col(c)).alias(c) for c in ("score_limit", "diff_limit", "spacing")], "hash_limit", "min_frames")


def marked(spark, sf_dir) -> DataFrame:
    return segments.with_transitions(segments.with_thresholds(deltas(spark, sf_dir), C, FRAME_ORDER), FRAME_ORDER)


def members(spark, sf_dir) -> DataFrame:
    return segments.segment_frames(segments.with_splits(marked(spark, sf_dir), FRAME_ORDER), C)


def transition_points(spark, sf_dir):
    return marked(spark, sf_dir).where("is_transition").select("job", "idx", _r(F.col("transition_score")).alias("transition_score"))


def nms_splits(spark, sf_dir):
    return segments.nms_splits(marked(spark, sf_dir), FRAME_ORDER)


def stable_segments(spark, sf_dir):
    s = segments.stable_segments(members(spark, sf_dir))
    return s.select("job", "seg_no", _r(F.col("start")).alias("start_time"), _r(F.col("end")).alias("end_time"), "n", "n_candidates", _r(F.col("mean_change_ratio"), 10).alias("mean_change_ratio"))


def best_frame(spark, sf_dir):
    m = members(spark, sf_dir).withColumns({"score": F.col("value") / 500.0, "readability_score": F.col("code") % 97 / 96.0, "text_density": F.col("code") % 13 / 400.0})
    rank = scores.selection_score(scores.features(), F.col("t"), F.col("start"), F.col("end"), False)
    best = selection.best_frames(m, rank)
    return best.select("job", "seg_no", "idx", "page_id", "label", "n_candidates", _r(F.col("rank")).alias("rank"))


BEST_SQL = f"""{MEMBERS_SQL},
b0 AS (SELECT *, count(*) OVER (PARTITION BY job, seg_no) AS nc, value / 500.0::DOUBLE + greatest(0, 1 - 2 * (abs(t - (a + b) / 2) / greatest(b - a, 0.001::DOUBLE))) * 0.12::DOUBLE
  + greatest(0, 1 - change_ratio) * 0.16::DOUBLE + code % 97 / 96.0::DOUBLE * 0.18::DOUBLE + least(code % 13 / 400.0::DOUBLE * 10, 0.18::DOUBLE) - CASE WHEN rejected THEN 0.65::DOUBLE ELSE 0 END AS rank FROM mem WHERE cand),
best AS (SELECT * FROM b0 QUALIFY row_number() OVER (PARTITION BY job, seg_no ORDER BY rank DESC, idx) = 1)"""


def pipeline_counts(spark, sf_dir):
    """Per job: frames, rejected frames, segments, candidates."""
    f = frames(spark, sf_dir).groupBy("job").agg(F.count("*").alias("frames"), F.count_if("rejected").alias("rejected"))
    s = segments.stable_segments(members(spark, sf_dir)).groupBy("job").agg(F.count("*").alias("segments"), F.sum("n_candidates").alias("candidates"))
    return f.join(s, "job", "left").select("job", "frames", "rejected", F.coalesce("segments", F.lit(0)).cast("long").alias("segments"), F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"))


def _modes(spark, df: DataFrame) -> DataFrame:
    mode = F.when(F.col("job") % 2 == 0, "screen").otherwise("camera")
    # the mode table has two rows
    return df.withColumn("mode", mode).join(F.broadcast(mode_settings(spark)), "mode")


def sample_frames(spark, sf_dir):
    f = _modes(spark, frames(spark, sf_dir))
    return sampling.sample_frames(f, (F.col("job") % 5 + 6).cast("double"), F.col("sample_fps")).select("job", "idx", "mode")


def mode_table(spark, sf_dir):
    return mode_settings(spark)


def wanted(spark, sf_dir) -> DataFrame:
    f = frames(spark, sf_dir).groupBy("job").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return f.select("job", F.explode(F.array(F.col("a") - 100, (F.col("a") + F.col("b")) / 2, F.col("a") + (F.col("b") - F.col("a")) * 0.25, F.col("b") + 100)).alias("wanted_t"))


def nearest_frame(spark, sf_dir):
    n = sampling.nearest_frame(frames(spark, sf_dir), wanted(spark, sf_dir))
    return n.select("job", _r(F.col("wanted_t"), 3).alias("wanted_t"), "idx")


def job_metadata(spark, sf_dir):
    m = sampling.job_metadata(frames(spark, sf_dir))
    return m.select("job", "frame_count", _r(F.col("fps") * 86400).alias("frames_a_day"), _r(F.col("duration"), 2).alias("duration"))


def format_time(spark, sf_dir):
    from ..functions.text import format_time

    return frames(spark, sf_dir).select("job", "idx", format_time(F.col("code") / 64.0 - 20).alias("shown"))


def transition_rows(spark, sf_dir):
    """Deltas over a sliding window of frames: mean and maximum of the last five scores."""
    w = segments.order_window(FRAME_ORDER).rowsBetween(-4, 0)
    return deltas(spark, sf_dir).select("job", "idx", _r(F.coalesce(F.avg("transition_score").over(w), F.lit(0.0))).alias("mean5"), _r(F.coalesce(F.max("transition_score").over(w), F.lit(0.0))).alias("max5"))


def transition_stats(spark, sf_dir):
    s = report.transition_stats(marked(spark, sf_dir), members(spark, sf_dir))
    zero = lambda c: _r(F.coalesce(F.col(c), F.lit(0.0))).alias(c)
    return s.select("job", zero("max_change"), zero("max_diff"), F.coalesce("max_hash", F.lit(0)).cast("long").alias("max_hash"), "transitions", F.col("segments").cast("long").alias("segments"))


_G = 0.25
QUERIES = {
    "frame_deltas": frame_deltas, "adaptive_thresholds": adaptive_thresholds, "transition_points": transition_points, "nms_splits": nms_splits, "stable_segments": stable_segments,
    "best_frame": best_frame, "pipeline_counts": pipeline_counts, "sample_frames": sample_frames, "mode_settings": mode_table, "nearest_frame": nearest_frame, "job_metadata": job_metadata,
    "format_time": format_time, "transition_rows": transition_rows, "transition_stats": transition_stats,
}

ORACLE_SQL = {
    "frame_deltas": f"WITH {DELTAS_SQL} SELECT job, idx, round(change_ratio, 6) AS change_ratio, round(coalesce(mean_diff, 0), 6) AS mean_diff, coalesce(hash_distance, 0) AS hash_distance, round(coalesce(s, 0), 6) AS transition_score FROM d",
    "adaptive_thresholds": f"WITH {LIMITS_SQL} SELECT job, round(score_limit, 6) AS score_limit, round(diff_limit, 6) AS diff_limit, round(spacing, 6) AS spacing, hash_limit, min_frames FROM l",
    "transition_points": f"WITH {MARKS_SQL} SELECT job, idx, round(s, 6) AS transition_score FROM m WHERE hit",
    "nms_splits": f"WITH RECURSIVE {SPLITS_SQL} SELECT job, idx FROM k",
    "stable_segments": f"WITH RECURSIVE {MEMBERS_SQL} SELECT job, seg_no, round(any_value(a), 6) AS start_time, round(any_value(b), 6) AS end_time, any_value(n) AS n, CAST(count(*) FILTER (cand) AS BIGINT) AS n_candidates, round(any_value(mcr), 10) AS mean_change_ratio FROM mem GROUP BY job, seg_no",
    "best_frame": f"WITH RECURSIVE {BEST_SQL} SELECT job, seg_no, idx, 'page-' || seg_no AS page_id, 'Page ' || seg_no AS label, nc AS n_candidates, round(rank, 6) AS rank FROM best",
    "pipeline_counts": f"""WITH RECURSIVE {MEMBERS_SQL}, x AS (SELECT job, count(DISTINCT seg_no) AS segments, count(*) FILTER (cand) AS candidates FROM mem GROUP BY job)
SELECT f.job, count(*) AS frames, count(*) FILTER (rejected) AS rejected, coalesce(any_value(x.segments), 0) AS segments, coalesce(any_value(x.candidates), 0) AS candidates FROM f LEFT JOIN x ON x.job = f.job GROUP BY f.job""",
    "sample_frames": f"""WITH {FRAMES_SQL} SELECT job, idx, CASE WHEN job % 2 = 0 THEN 'screen' ELSE 'camera' END AS mode FROM f
WHERE idx % greatest(CAST(round_even((job % 5 + 6)::DOUBLE / CASE WHEN job % 2 = 0 THEN 4.0 ELSE 3.0 END, 0) AS BIGINT), 1) = 0""",
    "mode_settings": """SELECT * FROM (VALUES ('screen', 4.0::DOUBLE, 0.5::DOUBLE, 0.008::DOUBLE, 3::BIGINT, 0.012::DOUBLE, 2::BIGINT), ('camera', 3.0, 0.6, 0.01, 4, 0.02, 3))
AS t(mode, sample_fps, min_seconds, max_change_ratio, hash_distance_threshold, mean_diff_threshold, dedupe_threshold)""",
    "nearest_frame": f"""WITH {FRAMES_SQL}, s AS (SELECT job, min(t) AS a, max(t) AS b FROM f GROUP BY job), w AS (SELECT job, a, b, unnest([a - 100, (a + b) / 2, a + (b - a) * {_G}::DOUBLE, b + 100]) AS wt FROM s)
SELECT w.job, round(wt, 3) AS wanted_t, idx FROM w JOIN f USING (job) QUALIFY row_number() OVER (PARTITION BY w.job, wt ORDER BY abs(t - least(greatest(wt, a), b)), t, idx) = 1""",
    "job_metadata": f"""WITH {FRAMES_SQL}, m AS (SELECT job, count(*) AS frame_count, CASE WHEN max(t) > min(t) THEN (count(*) - 1) / (max(t) - min(t)) END AS fps FROM f GROUP BY job)
SELECT job, frame_count, round(fps * 86400, 6) AS frames_a_day, round(frame_count / fps, 2) AS duration FROM m""",
    "format_time": f"""WITH {FRAMES_SQL}, x AS (SELECT job, idx, greatest(code / 64.0::DOUBLE - 20, 0) AS s FROM f)
SELECT job, idx, CAST(floor(floor(s) / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(s) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '.' || CAST(floor((s - floor(s)) * 10) AS BIGINT) AS shown FROM x""",
    "transition_stats": f"""WITH RECURSIVE {MEMBERS_SQL}, x AS (SELECT job, count(DISTINCT seg_no) AS n FROM mem GROUP BY job)
SELECT m.job, round(coalesce(max(change_ratio), 0), 6) AS max_change, round(coalesce(max(mean_diff), 0), 6) AS max_diff, coalesce(max(hash_distance), 0) AS max_hash, count(*) FILTER (hit) AS transitions, coalesce(any_value(x.n), 0) AS segments
FROM m LEFT JOIN x ON x.job = m.job GROUP BY m.job""",
    "transition_rows": f"""WITH {DELTAS_SQL} SELECT job, idx, round(coalesce(avg(s) OVER w, 0), 6) AS mean5, round(coalesce(max(s) OVER w, 0), 6) AS max5 FROM d WINDOW w AS (PARTITION BY job ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
}
