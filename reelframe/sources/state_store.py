"""Job state as one JSON document and as tables; fixture manifests."""

from __future__ import annotations

import json
import os

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import place_of, write_file

STAGE = "key string, label string, status string, progress_percent long, started_at string, completed_at string"
PAGE = "id string, order_index long, rotation long, deleted boolean, manual boolean, status string, image_path string, thumbnail_path string, segment_start double, segment_end double"
EXPORT = "status string, progress long, filename string, url string, error string"


def _struct(ddl: str) -> str:
    return "struct<" + ", ".join(f"{a}: {b}" for a, b in (x.split() for x in ddl.split(", "))) + ">"


SCHEMA = (
    "jobs array<struct<id: string, filename: string, mode: string, status: string, percent: bigint, message: string, created_at: string, updated_at: string, revision: bigint, "
    f"notes: array<string>, stages: array<{_struct(STAGE)}>, pages: array<{_struct(PAGE)}>, export: {_struct(EXPORT)}>>"
)
DEFAULTS = {"mode": "screen", "status": "queued", "percent": 0, "message": "", "revision": 0}


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """One row a job; a missing or unreadable file has none, missing fields have their defaults."""
    empty = spark.createDataFrame([], SCHEMA).select(F.explode("jobs").alias("j")).select("j.*")
    store, place = place_of(path)
    if store.get_file_info(place).type == fs.FileType.NotFound:
        return empty
    jobs = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path).select(F.explode("jobs").alias("j")).select("j.*")
    jobs = jobs.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in DEFAULTS.items()})
    lists = {k: F.coalesce(k, F.array().cast(jobs.schema[k].dataType)) for k in ("notes", "stages", "pages")}
    return jobs.withColumns(lists)


def pages_of(jobs: DataFrame) -> DataFrame:
    """(job, id, order_index, rotation, deleted, manual, ...) of nested jobs, with defaults."""
    p = jobs.select(F.col("id").alias("job"), F.explode("pages").alias("p")).select("job", "p.*")
    return p.withColumns({"rotation": F.coalesce("rotation", F.lit(0)), "deleted": F.coalesce("deleted", F.lit(False)), "manual": F.coalesce("manual", F.lit(False))})


def write_jobs(jobs: list[dict], path: str) -> None:
    """Replace the document in one step, so a reader sees the old state or the new one."""
    write_file(path, json.dumps({"jobs": jobs}, indent=1).encode())


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Fixture cases: name, input_path (resolved against the manifest), mode, bounds, notes."""
    schema = "cases array<struct<name: string, input_path: string, processing_mode: string, min_pages: bigint, max_pages: bigint, max_deleted_like_pages: bigint, notes: string>>"
    c = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("cases").alias("c")).select("c.*")
    base = os.path.dirname(path)
    full = F.when(F.col("input_path").startswith("/"), F.col("input_path")).otherwise(F.concat(F.lit(base + "/"), F.col("input_path")))
    return c.withColumns({"input_path": full, "processing_mode": F.coalesce("processing_mode", F.lit("camera"))}).withColumnRenamed("max_deleted_like_pages", "max_weak")
