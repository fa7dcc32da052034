"""From a recording to stored pages and back to a file: the callables that a job service runs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.reconstruct import Reconstruction, reconstruct
from .operators.sampling import require_frames
from .sources import sinks
from .sources.images import to_array


def stored_pages(out: Reconstruction, frames: DataFrame, folder: str, camera: bool) -> list[dict]:
    """Write the pages of a reconstruction and list them as the job store keeps them: a job's few pages, no pixels."""
    chosen = out.pages.select("job", "idx", "page_id").join(frames.select("job", "idx", "height", "width", "data"), ["job", "idx"])
    paths = sinks.write_pages(chosen, folder, camera).select("job", "page_id", "image_path", "thumbnail_path")
    rows = out.pages.select("job", "page_id", "page_number", "start", "end").join(paths, ["job", "page_id"]).orderBy("page_number").collect()
    fixed = {"rotation": 0, "deleted": False, "manual": False, "status": "active"}
    return [{"id": r.page_id, "order_index": r.page_number - 1, "image_path": r.image_path, "thumbnail_path": r.thumbnail_path, "segment_start": r.start, "segment_end": r.end} | fixed for r in rows]


def runner(frames_of: Callable[[dict], DataFrame], fps: float, folder: str) -> Callable[[dict, Callable[[str], None]], list[dict]]:
    """``run`` of a job service: frames of the job, reconstruction, pages written; each stage is told as it begins."""

    def run(job: dict, stage: Callable[[str], None]) -> list[dict]:
        frames = require_frames(frames_of(job))
        stage("segment")
        out = reconstruct(frames, fps, job["mode"])
        out.frames.count()  # features are kept from here on
        stage("select")
        out.selected.count()
        stage("dedupe")
        out.pages.count()
        stage("preview")
        return stored_pages(out, frames, folder, job["mode"] == "camera")

    return run


def exporter(spark: SparkSession, folder: str, base_url: str = "/artifacts") -> Callable[[dict, list[dict], Callable[[int], None]], str]:
    """``export`` of a job service: a PDF of the stored page images, turned as reviewed."""

    def export(job: dict, pages: list[dict], progress: Callable[[int], None]) -> str:
        turned = []
        for i, p in enumerate(pages):
            if not p["image_path"]:
                raise ValueError(f"page without image: {p['id']}")
            row = spark.read.format("image").load(p["image_path"] if "://" in p["image_path"] else f"file://{p['image_path']}").select("image.*").first()
            image = to_array(row.height, row.width, row.data)
            turned.append(np.ascontiguousarray(sinks.images.rotate(image, int(p["rotation"]))))
            progress(35 + 55 * (i + 1) // len(pages))
        sinks.write_file(f"{folder}/exports/{job['id']}.pdf", sinks.pdf(turned))
        return f"{base_url}/exports/{job['id']}.pdf"

    return export
