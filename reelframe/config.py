"""Settings: thresholds of both capture modes, quality gates, duplicate evidence."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession

MODES = ("screen", "camera")


# Thresholds that results depend on.
@dataclass(frozen=True)
class ModeSettings:
    sample_fps: float
    min_seconds: float
    max_change_ratio: float
    hash_distance_threshold: int
    mean_diff_threshold: float
    dedupe_threshold: int


SCREEN = ModeSettings(4.0, 0.5, 0.008, 3, 0.012, 2)
CAMERA = ModeSettings(3.0, 0.6, 0.01, 4, 0.02, 3)


@dataclass(frozen=True)
class Gates:
    min_sharpness: float = 0.24
    min_readability: float = 0.34
    max_transition: float = 0.42
    max_occlusion: float = 0.08
    min_coverage: float = 0.42
    min_rectangularity: float = 0.62
    min_single_page: float = 0.58
    max_background: float = 0.18
    max_border: float = 0.16
    min_contour_confidence: float = 0.62
    max_gutter: float = 0.11
    max_opposing: float = 0.2
    min_text_density: float = 0.012


@dataclass(frozen=True)
class Settings:
    screen: ModeSettings = SCREEN
    camera: ModeSettings = CAMERA
    gates: Gates = Gates()
    duplicate_window_seconds: float = 2.4
    duplicate_content_diff: float = 0.075
    cluster_window_seconds: float = 1.8
    bad_neighbour_penalty: float = 0.18
    min_cluster_similarity: float = 0.9
    text_similarity: float = 0.9
    low_text_visual: float = 0.94
    far_visual: float = 0.975
    text_density_cut: float = 0.018
    debug_images: int = 12
    artifact_base: str = "/artifacts"
    thumbnail_width: int = 360

    def mode(self, name: str) -> ModeSettings:
        if name not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {name!r}")
        return getattr(self, name)


DEFAULT = Settings()


def mode_settings(spark: SparkSession, settings: Settings = DEFAULT) -> DataFrame:
    """The mode table: one row a mode, two rows in all, so it may always be broadcast."""
    rows = [(m, *(float(v) for v in asdict(settings.mode(m)).values())) for m in MODES]
    names = [f.name for f in fields(ModeSettings)]
    df = spark.createDataFrame(rows, "mode string, " + ", ".join(f"{n} double" for n in names))
    return df.withColumns({n: df[n].cast("long") for n in ("hash_distance_threshold", "dedupe_threshold")})


# Sentences that clients show or look for.
SAID = {
    "restart": "Processing interrupted by server restart.",
    "restart_note": "Job was interrupted before completion and needs to be re-uploaded.",
    "export_restart": "Export interrupted by server restart.",
    "no_pages": "No active pages available for export.",
    "no_job": "Job not found",
    "no_page": "Job or page not found",
    "no_pages_named": "Job or pages not found",
    "bad_order": "Invalid page order or job not found",
    "no_manual": "Could not add a page from the requested video frame",
}
