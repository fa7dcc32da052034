"""Views of the test tables in the shape of the engine's tables, in Spark and in DuckDB SQL.

The tables hold no video: events stand in for frames, embeddings for 8x8 grey images, documents for
pages with quality features, orders and line items for jobs and their pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ModeSettings
from ..functions import grid

#: Event streams are sparse, so segments are measured in days rather than seconds.
EVENT_CONFIG = ModeSettings(4.0, 100_000.0, 0.05, 3, 0.012, 2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Frames that a task sorts on average, at most; a larger table is dealt over more partitions than the session's.
FRAMES_A_TASK = 500_000
#: Columns that order the frames of a job as idx does; ``ordered_frames`` lie in this order.
FRAME_ORDER = ("ts", "event_id")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_frames(spark, sf_dir).drop(*FRAME_ORDER)


def ordered_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frames`` with the columns of their order."""
    e = table(spark, sf_dir, "events")
    parts = -(-e.count() // FRAMES_A_TASK)
    w = Window.partitionBy("job").orderBy(*FRAME_ORDER)
    e = e.select(F.col("user_id").alias("job"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "value", (F.col("event_type") == "error").alias("rejected"))
    e = e.repartition(parts, "job") if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else e
    t = F.unix_micros("ts") / 1e6
    out = e.select("job", *FRAME_ORDER, (F.row_number().over(w) - 1).cast("long").alias("idx"), t.alias("t"), "value", "rejected", F.round(F.col("value") * 100).cast("long").alias("code"))
    return out.withColumn("sod", F.col("t") - F.floor(F.col("t") / 86400) * 86400)


FRAMES_SQL = """e AS (SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, epoch_us(ts) / 1e6 AS t,
  value, event_type = 'error' AS rejected, CAST(round(value * 100) AS BIGINT) AS code FROM events),
f AS (SELECT *, t - floor(t / 86400) * 86400 AS sod FROM e)"""


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job, id, ord, grid (0..255 after min-max scaling), unit (0..1)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("job"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("raw"))
    e = e.select("job", "id", "raw", grid.minmax(F.col("raw")).alias("unit"))
    return e.select("job", "id", F.col("id").alias("ord"), "raw", "unit", F.transform("unit", lambda x: x * 255).alias("grid"))


GRIDS_SQL = """r AS (SELECT CAST(label AS BIGINT) AS job, vec_id AS id, CAST(embedding AS DOUBLE[]) AS raw FROM embeddings),
u AS (SELECT *, list_transform(raw, lambda x: (x - list_min(raw)) / (list_max(raw) - list_min(raw))) AS unit FROM r),
g AS (SELECT *, list_transform(unit, lambda x: x * 255) AS grid FROM u)"""

#: Feature: multiplier and modulus that spread the document's length over 0..1.
_FEATURES = {
    "brightness": (7919, 255, 1.0), "contrast": (104729, 90, 1.0), "sharpness": (1299709, 2300, 1.0), "edge_density": (15485863, 300, 0.001), "text_density": (32452843, 60, 0.001),
    "page_coverage": (49979687, 997, 1 / 997), "rectangularity": (67867967, 983, 1 / 983), "single_page_score": (86028121, 977, 1 / 977), "perspective_score": (122949823, 971, 1 / 971),
    "contour_confidence": (141650939, 967, 1 / 967), "occlusion_ratio": (160481183, 953, 0.0002), "background_intrusion_ratio": (179424673, 947, 0.0003), "border_touch_ratio": (198491317, 941, 0.0003),
    "gutter_ratio": (217645177, 937, 0.0002), "opposing_page_ratio": (236887691, 929, 0.0003), "transition_penalty": (256203161, 919, 0.0007),
}


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: job, id, ord, start, end and all quality features."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    d = d.join(lab, "doc_id", "left").select(F.col("source").alias("job"), F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), "n_chars", "text", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("rejected"))
    d = d.withColumns({k: ((F.col("n_chars") + F.col("id")) * m % n) * s for k, (m, n, s) in _FEATURES.items()})
    w = Window.partitionBy("job").orderBy("id")
    d = d.withColumns({"found": F.col("id") % 7 != 0, "normalized": F.col("id") % 5 != 0, "camera": F.col("id") % 2 == 0, "start": (F.row_number().over(w) * 1.5 + F.col("n_chars") % 10 * 0.1)})
    return d.withColumn("end", F.col("start") + 0.25 + F.col("n_chars") % 7 * 0.1)


PAGES_SQL = f"""d AS (SELECT source AS job, doc_id AS id, doc_id AS ord, n_chars, text, coalesce(toxic = 1, false) AS rejected FROM documents LEFT JOIN labels USING (doc_id)),
d2 AS (SELECT *, {", ".join(f"((n_chars + id) * {m} % {n}) * CAST({s!r} AS DOUBLE) AS {k}" for k, (m, n, s) in _FEATURES.items())},
  id % 7 <> 0 AS found, id % 5 <> 0 AS normalized, id % 2 = 0 AS camera,
  row_number() OVER (PARTITION BY job ORDER BY id) * CAST(1.5 AS DOUBLE) + n_chars % 10 * CAST(0.1 AS DOUBLE) AS start FROM d),
p AS (SELECT *, start + CAST(0.25 AS DOUBLE) + n_chars % 7 * CAST(0.1 AS DOUBLE) AS "end" FROM d2)"""
