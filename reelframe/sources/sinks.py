"""Sinks: page images, thumbnails, PDF files, debug reports.

Files go through Python writers in the tasks, so ``folder`` must be one that all executors share: a
mounted path, or an address that Arrow's file systems know (``file://``, ``hdfs://``, ``s3://``). Names
depend on the row alone: a retried task writes the same file again.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import document, images
from ..operators.report import first_of_job
from .images import png, to_array


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address and the place within it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def write_file(path: str, data: bytes) -> None:
    """Whole file or none: written beside and renamed; where a store can't rename onto a file, that one goes first."""
    store, place = place_of(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    beside = f"{place}.{uuid.uuid4().hex}"
    with store.open_output_stream(beside) as f:
        f.write(data)
    if store.type_name == "hdfs" and store.get_file_info(place).type != fs.FileType.NotFound:
        store.delete_file(place)
    store.move(beside, place)


def write_pages(pages: DataFrame, folder: str, camera: bool = False, base_url: str = "/artifacts", width: int = 360) -> DataFrame:
    """Page PNGs and thumbnails of (job, page_id, height, width, data); returns their paths and URLs.

    Rows without an image have null paths. Camera pages are finished first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                if r.data is None:
                    out.append((r.job, r.page_id, None, None))
                    continue
                image = to_array(r.height, r.width, r.data)
                image = document.finish(image) if camera else image
                place = [f"{folder}/jobs/{r.job}/{kind}/{r.page_id}.png" for kind in ("pages", "thumbnails")]
                write_file(place[0], png(image))
                write_file(place[1], png(images.thumbnail(image, width)))
                out.append((r.job, r.page_id, *place))
            yield pd.DataFrame(out, columns=["job", "page_id", "image_path", "thumbnail_path"])

    paths = pages.select(F.col("job").cast("string"), "page_id", "height", "width", "data").mapInPandas(run, "job string, page_id string, image_path string, thumbnail_path string")
    url = lambda c: F.concat(F.lit(base_url), F.substring(c, len(folder) + 1, 1 << 30))
    return paths.withColumns({"image_url": url("image_path"), "thumbnail_url": url("thumbnail_path")})


def pdf(pages: list[np.ndarray], dpi: float = 150.0) -> bytes:
    """PDF with one page an image; ValueError without pages."""
    if not pages:
        raise ValueError("no pages to export")
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    kids = []
    for image in pages:
        rgb = np.ascontiguousarray(image[..., ::-1])
        h, w = rgb.shape[:2]
        data = zlib.compress(rgb.tobytes(), 6)
        n = len(objects) + 1
        x, y = w * 72 / dpi, h * 72 / dpi
        draw = f"q {x:.2f} 0 0 {y:.2f} 0 0 cm /I Do Q".encode()
        objects.append(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode /Length %d >>\nstream\n" % (w, h, len(data)) + data + b"\nendstream")
        objects.append(b"<< /Length %d >>\nstream\n" % len(draw) + draw + b"\nendstream")
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.2f %.2f] /Contents %d 0 R /Resources << /XObject << /I %d 0 R >> >> >>" % (x, y, n + 1, n))
        kids.append(f"{n + 2} 0 R")
    objects[1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(kids)}] >>".encode()
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + o + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


def export_pdf(pages: DataFrame, folder: str) -> DataFrame:
    """One PDF a job from (job, order_index, rotation, height, width, data): (job, path, n_pages).

    A task holds one job's pages, the size of the file that it writes.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("order_index")
        job = str(group["job"].iloc[0])
        turned = [images.rotate(to_array(r.height, r.width, r.data), int(r.rotation)) for r in group.itertuples()]
        path = f"{folder}/exports/{job}.pdf"
        write_file(path, pdf(turned))
        return pd.DataFrame({"job": [job], "path": [path], "n_pages": [len(turned)]})

    return pages.select(F.col("job").cast("string"), "order_index", "rotation", "height", "width", "data").groupBy("job").applyInPandas(run, "job string, path string, n_pages long")


def debug_images(frames: DataFrame, kept: DataFrame, folder: str, most: int = DEFAULT.debug_images) -> DataFrame:
    """PNGs of the first ``most`` rejected frames and kept pages of each job: (job, kind, place, path).

    ``frames`` and ``kept`` have job, idx, height, width, data; ``frames`` also rejected, ``kept`` page_number
    and page_id. Only rows within the limit carry their pixels into the tasks that write.
    """
    cols = ["job", "kind", "place", "name", "height", "width", "data"]
    bad = first_of_job(frames.where("rejected").select("job", "idx"), most, "idx").join(frames, ["job", "idx"])
    good = first_of_job(kept.select("job", "idx", "page_number", "page_id"), most, "page_number").join(kept.select("job", "idx", "height", "width", "data"), ["job", "idx"])
    bad = bad.withColumns({"kind": F.lit("rejected"), "name": F.format_string("rejected-%02d-frame-%d", "place", "idx")}).select(*cols)
    good = good.withColumns({"kind": F.lit("kept"), "name": F.format_string("kept-%02d-%s", "place", "page_id")}).select(*cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                path = f"{folder}/debug/{r.job}/{r.name}.png"
                if r.data is not None:
                    write_file(path, png(to_array(r.height, r.width, r.data)))
                    out.append((r.job, r.kind, r.place, path))
            yield pd.DataFrame(out, columns=["job", "kind", "place", "path"])

    return bad.unionByName(good).withColumn("job", F.col("job").cast("string")).mapInPandas(run, "job string, kind string, place long, path string")


_FRAME = {
    "score": "score", "readability_score": "readability_score", "transition_penalty": "transition_penalty", "single_page_score": "single_page_score", "page_coverage": "page_coverage",
    "background_intrusion_ratio": "background_intrusion_ratio", "gutter_ratio": "gutter_ratio", "opposing_page_ratio": "opposing_page_ratio", "rejection_reasons": "reasons",
}
_PAGE = {
    "page_id": "page_id", "label": "label", "source_segment_id": "segment_id", "segment_start": "start", "segment_end": "end", "frame_index": "idx", "timestamp": "t", "score": "score",
    "readability_score": "readability_score", "single_page_score": "single_page_score", "page_coverage": "page_coverage", "background_intrusion_ratio": "background_intrusion_ratio",
    "transition_penalty": "transition_penalty", "rejected": "rejected", "rejection_reasons": "reasons", "notes": "notes",
}


def debug_report(frames: DataFrame, segments: DataFrame, selected: DataFrame, collapsed: DataFrame, kept: DataFrame) -> DataFrame:
    """(job, report): counts of every step, all rejected frames, segments and pages of each step, as JSON.

    ``segments`` has a row for each frame of a segment.
    """

    def listed(df: DataFrame, name: str, order: str, fields: dict[str, str]) -> DataFrame:
        row = F.struct(*[F.col(c).alias(k) for k, c in fields.items()])
        rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("idx").alias("i"), row.alias("row"))))
        return df.groupBy("job").agg(F.transform(rows, lambda x: x["row"]).alias(name))

    named = F.concat(F.lit("segment-"), F.col("seg_no"))
    frame_counts = frames.groupBy("job").agg(F.count("*").alias("n_frames"))
    rejected = listed(frames.where("rejected"), "rejected_frames", "idx", {"frame_index": "idx", "timestamp": "t"} | _FRAME)
    candidates = F.array_sort(F.collect_list(F.when(F.col("is_candidate"), F.col("idx"))))
    parts = segments.groupBy("job", "seg_no").agg(F.first("start").alias("start"), F.first("end").alias("end"), F.first("mean_change_ratio").alias("mean"), candidates.alias("found"), F.min("idx").alias("idx"))
    parts = listed(parts.withColumn("segment_id", named), "segments", "seg_no", {"segment_id": "segment_id", "start_time": "start", "end_time": "end", "mean_change_ratio": "mean", "candidate_frame_indices": "found"})
    out, names = frame_counts, []
    pages = [(selected, "selected_pages", "ord"), (collapsed, "sequence_pages", "ord"), (kept, "deduped_pages", "page_number")]
    for found, name in [(rejected, "rejected_frames"), (parts, "segments"), *[(listed(df.withColumn("segment_id", named), name, order, _PAGE), name) for df, name, order in pages]]:
        out = out.join(found, "job", "left").withColumn(name, F.coalesce(name, F.array().cast(found.schema[name].dataType)))
        names.append(name)
    counts = F.struct(F.col("n_frames").alias("sampled_frames"), *[F.size(n).alias(n) for n in names])
    return out.select("job", F.to_json(F.struct(F.col("job").alias("job_id"), counts.alias("counts"), *names)).alias("report"))
