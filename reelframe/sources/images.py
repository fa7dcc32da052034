"""Image tables: (job, idx, t, height, width, data) with raw BGR bytes.

Spark's own ``image`` source decodes PNG and JPEG in the JVM; frames of a recording are a directory
of images named ``<job>/<index>.png`` with a frame rate.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FRAME_SCHEMA = "job string, idx long, t double, height int, width int, data binary"


def read_frames(spark: SparkSession, path: str, fps: float) -> DataFrame:
    """Frames of all jobs below ``path``; job and index come from the file's place."""
    if fps <= 0:
        raise ValueError("fps must be positive")
    images = spark.read.format("image").option("dropInvalid", True).load(path.rstrip("/") + "/*").select("image.*")
    parts = F.split("origin", "/")
    idx = F.regexp_extract("origin", r"(\d+)\.[A-Za-z]+$", 1).cast("long")
    return images.select(F.element_at(parts, -2).alias("job"), idx.alias("idx"), (idx / fps).alias("t"), "height", "width", "data")


def to_array(height: int, width: int, data: bytes) -> np.ndarray:
    """BGR array of an image row; grey and four-channel rows are converted."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, -1)
    return np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[..., :3]


def png(image: np.ndarray) -> bytes:
    """PNG file of a BGR or grey image."""
    grey = image.ndim == 2
    rgb = image if grey else image[..., ::-1]
    h, w = image.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if grey else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


class FrameSource(DataSource):
    """``spark.read.format("frames")``: frames from a decoder function, one partition a recording.

    Options: paths (comma-separated), decoder ("module:function", yields BGR arrays in order), fps and
    interval (every interval-th frame is kept; others are never turned into rows).
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAME_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FrameReader(self.options)


class _FrameReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", "").split(",") if p]
        self.decoder, self.fps, self.interval = options.get("decoder"), float(options.get("fps", 0)), max(int(options.get("interval", 1)), 1)
        if self.fps <= 0 or not self.decoder:
            raise ValueError("frames need a decoder and a positive fps")

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        from importlib import import_module

        module, _, name = self.decoder.partition(":")
        for i, frame in enumerate(getattr(import_module(module), name)(partition.value)):
            if i % self.interval == 0:
                yield partition.value, i, i / self.fps, frame.shape[0], frame.shape[1], np.ascontiguousarray(frame).tobytes()
