"""Quality scores, gates and ranks as columns.

``q`` is a function from a feature's name to its column, so the same formulas serve flat tables,
structs and literals. Weights, caps and limits below are fixed values that results depend on.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Gates

Feature = Callable[[str], Column]

#: Features of a detected page and their neutral values where no page is looked for.
NEUTRAL = {
    "page_coverage": 1.0, "rectangularity": 1.0, "single_page_score": 1.0, "perspective_score": 1.0, "contour_confidence": 1.0,
    "occlusion_ratio": 0.0, "background_intrusion_ratio": 0.0, "border_touch_ratio": 0.0, "gutter_ratio": 0.0, "opposing_page_ratio": 0.0,
}


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(x, F.lit(1.0)))


def weighted(q: Feature, weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + q(name) * w
    return total


def by_mode(camera: Column | bool, yes: Callable[[], Column], no: Callable[[], Column]) -> Column:
    """A known mode needs only its own features; a mode column needs both."""
    if isinstance(camera, bool):
        return yes() if camera else no()
    return F.when(camera, yes()).otherwise(no())


def features(prefix: str = "") -> Feature:
    return lambda name: F.col(f"{prefix}{name}")


def component_scores(q: Feature) -> dict[str, Column]:
    """Normalised scores of the raw measures brightness, contrast, sharpness and edge density."""
    out = {
        "brightness_score": F.greatest(F.lit(0.0), 1 - F.abs(q("brightness") - 178.0) / 178.0),
        "contrast_score": F.least(q("contrast") / 72.0, F.lit(1.0)),
        "sharpness_score": F.least(q("sharpness") / 1800.0, F.lit(1.0)),
    }
    edge = F.least(q("edge_density") / 0.18, F.lit(1.0))
    out["readability_score"] = 0.4 * out["contrast_score"] + 0.35 * edge + 0.25 * out["sharpness_score"]
    return out


def stability(q: Feature) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.least(q("transition_penalty"), F.lit(1.0)))


def rejection_reasons(q: Feature, camera: Column | bool, g: Gates = DEFAULT.gates) -> Column:
    """Names of the failed gates, in gate order."""
    camera = F.lit(camera) if isinstance(camera, bool) else camera
    common = [
        (q("sharpness_score") < g.min_sharpness, "severe_defocus"),
        (q("readability_score") < g.min_readability, "low_readability"),
        (q("transition_penalty") > g.max_transition, "transition_motion"),
        (q("text_density") < g.min_text_density, "insufficient_text_detail"),
    ]
    seen = camera & q("found")
    page = [
        (camera & ~q("found"), "no_page_detected"),
        (seen & (q("page_coverage") < g.min_coverage), "partial_page_visibility"),
        (seen & (q("rectangularity") < g.min_rectangularity), "incomplete_page_contour"),
        (seen & (q("single_page_score") < g.min_single_page), "spread_or_off_axis_page"),
        (seen & (q("occlusion_ratio") > g.max_occlusion), "occlusion_or_finger"),
        (seen & (q("background_intrusion_ratio") > g.max_background), "background_clutter"),
        (seen & (q("border_touch_ratio") > g.max_border), "page_touches_frame_border"),
        (seen & (q("contour_confidence") < g.min_contour_confidence), "weak_page_isolation"),
        (seen & (q("gutter_ratio") > g.max_gutter), "gutter_dominant_spread"),
        (seen & (q("opposing_page_ratio") > g.max_opposing), "opposing_page_visible"),
        (seen & ~q("normalized"), "unstable_normalization"),
    ]
    return F.array_compact(F.array(*[F.when(p, F.lit(name)) for p, name in common + page]))


CAMERA_SCORE = {
    "readability_score": 0.22, "sharpness_score": 0.12, "contrast_score": 0.07, "brightness_score": 0.04, "text_density": 9.0, "page_coverage": 0.16,
    "rectangularity": 0.1, "single_page_score": 0.12, "perspective_score": 0.06, "contour_confidence": 0.07, "stability_score": 0.11, "occlusion_ratio": -0.28,
    "background_intrusion_ratio": -0.26, "border_touch_ratio": -0.18, "gutter_ratio": -0.26, "opposing_page_ratio": -0.3, "transition_penalty": -0.5,
}
SCREEN_SCORE = {"readability_score": 0.34, "sharpness_score": 0.24, "contrast_score": 0.14, "brightness_score": 0.08, "text_density": 7.5, "stability_score": 0.2, "transition_penalty": -0.45}
SEQUENCE_RANK = {"score": 1.0, "readability_score": 0.4, "stability_score": 0.25, "single_page_score": 0.22, "page_coverage": 0.18, "transition_penalty": -0.55, "background_intrusion_ratio": -0.35}
DUPLICATE_RANK = {
    "score": 1.0, "readability_score": 0.5, "single_page_score": 0.28, "page_coverage": 0.2, "contour_confidence": 0.16, "stability_score": 0.22,
    "transition_penalty": -0.55, "occlusion_ratio": -0.45, "background_intrusion_ratio": -0.35, "gutter_ratio": -0.3, "opposing_page_ratio": -0.3,
}
CAMERA_SELECTION = {"page_coverage": 0.14, "rectangularity": 0.08, "single_page_score": 0.2, "stability_score": 0.18, "occlusion_ratio": -0.42, "background_intrusion_ratio": -0.44, "border_touch_ratio": -0.25, "transition_penalty": -0.55}


def frame_score(q: Feature, camera: Column | bool, n_reasons: Column) -> Column:
    return by_mode(camera, lambda: weighted(q, CAMERA_SCORE), lambda: weighted(q, SCREEN_SCORE)) - F.least(n_reasons * 0.24, F.lit(1.2))


def selection_score(q: Feature, t: Column, start: Column, end: Column, camera: Column | bool) -> Column:
    """Rank of a frame within its segment: score, nearness to the middle, calm, legibility."""
    away = F.abs(t - (start + end) / 2.0) / F.greatest(end - start, F.lit(0.001))
    base = q("score") + F.greatest(F.lit(0.0), 1 - 2 * away) * 0.12 + F.greatest(F.lit(0.0), 1 - q("change_ratio")) * 0.16
    base = base + q("readability_score") * 0.18 + F.least(q("text_density") * 10.0, F.lit(0.18)) - F.when(q("rejected"), 0.65).otherwise(0.0)
    return base + by_mode(camera, lambda: weighted(q, CAMERA_SELECTION), lambda: F.lit(0.0))


def sequence_rank(q: Feature) -> Column:
    return weighted(q, SEQUENCE_RANK) - F.when(q("rejected"), 0.4).otherwise(0.0)


def duplicate_rank(q: Feature) -> Column:
    return weighted(q, DUPLICATE_RANK)


def weak(q: Feature, kind: str) -> Column:
    """Weak-page predicate; duplicates, sequences and fixture evaluation each have their own limits."""
    cov, single, bg, tp = {"duplicate": (0.68, 0.78, 0.08, 0.14), "sequence": (0.6, 0.72, 0.1, 0.22), "fixture": (0.6, 0.72, 0.1, 0.2)}[kind]
    return q("rejected") | (q("page_coverage") < cov) | (q("single_page_score") < single) | (q("background_intrusion_ratio") > bg) | (q("transition_penalty") > tp)


def stability_penalty(now: Feature, before: Feature) -> Column:
    """Penalty for a page that moves between two frames; 0 without a previous frame."""
    gap = lambda name, k, cap: F.least(F.abs(now(name) - before(name)) * k, F.lit(cap))
    moved = gap("page_coverage", 2.0, 0.32) + gap("rectangularity", 1.0, 0.18) + gap("perspective_score", 0.8, 0.14) + gap("single_page_score", 0.9, 0.18) + gap("border_touch_ratio", 0.7, 0.12)
    return F.when(before("found").isNull(), 0.0).when(now("found") & before("found"), moved).otherwise(0.22)


def camera_penalty(q: Feature) -> Column:
    """Transition penalty of a single camera frame, before stability and motion are added."""
    over = lambda x, k=1.0: F.greatest(F.lit(0.0), x) * k
    return (
        F.when(q("found"), 0.0).otherwise(0.35)
        + over(0.42 - q("page_coverage"))
        + over(0.58 - q("single_page_score"))
        + over(q("background_intrusion_ratio") - 0.08, 1.2)
        + over(q("border_touch_ratio") - 0.05, 0.8)
        + q("occlusion_ratio") * 1.1
    )


def motion_penalty(moving: Column, mean_diff: Column) -> Column:
    return F.least(0.85 * moving + 0.6 * mean_diff, F.lit(0.65))


def cluster_similarity(hist: Column, mean_diff: Column) -> Column:
    return clip01(0.7 * hist + 0.3 * (1 - F.least(mean_diff / 0.14, F.lit(1.0))))


def visual_similarity(hist: Column, diff: Column, layout: Column, profile: Column, content_diff: float = DEFAULT.duplicate_content_diff) -> Column:
    return clip01(0.4 * hist + 0.35 * (1 - F.least(diff / max(2 * content_diff, 0.001), F.lit(1.0))) + 0.15 * layout + 0.1 * profile)


def is_duplicate(e: Feature, max_hash: Column | int, window: float = DEFAULT.duplicate_window_seconds, text: float = DEFAULT.text_similarity) -> Column:
    """Duplicate decision from the evidence of a pair of pages; the first rule that applies wins.

    Evidence: hash_distance, gap, visual, layout, profile, tokens, ocr, text_heavy, either_weak.
    """
    max_hash = F.lit(max_hash) if isinstance(max_hash, int) else max_hash
    near = e("gap") <= window
    at = lambda v, lay, prof: (e("visual") >= v) & (e("layout") >= lay) & (e("profile") >= prof)
    return (
        F.when((e("hash_distance") > max_hash + 6) & (e("visual") < 0.95), False)
        .when(near & at(0.98, 0.94, 0.92), True)
        .when(near & at(0.72, 0.89, 0.93) & (e("tokens") >= 0.84) & e("either_weak"), True)
        .when(e("text_heavy"), (at(0.93, 0.9, 0.93) & (F.greatest(e("ocr"), e("tokens")) >= text)) | (near & at(0.9, 0.9, 0.93) & (e("tokens") >= 0.97)))
        .when(near & at(DEFAULT.low_text_visual, 0.92, 0.9), True)
        .when(~near & at(DEFAULT.far_visual, 0.95, 0.94), True)
        .otherwise(False)
    )


def is_duplicate_arrays(e: dict, max_hash: int, window: float = DEFAULT.duplicate_window_seconds, text: float = DEFAULT.text_similarity) -> np.ndarray:
    """``is_duplicate`` on arrays of evidence."""
    near = e["gap"] <= window
    at = lambda v, lay, prof: (e["visual"] >= v) & (e["layout"] >= lay) & (e["profile"] >= prof)
    heavy = (at(0.93, 0.9, 0.93) & (np.maximum(e["ocr"], e["tokens"]) >= text)) | (near & at(0.9, 0.9, 0.93) & (e["tokens"] >= 0.97))
    light = np.where(near, at(DEFAULT.low_text_visual, 0.92, 0.9), at(DEFAULT.far_visual, 0.95, 0.94))
    sure = near & (at(0.98, 0.94, 0.92) | (at(0.72, 0.89, 0.93) & (e["tokens"] >= 0.84) & e["either_weak"]))
    return ~((e["hash_distance"] > max_hash + 6) & (e["visual"] < 0.95)) & (sure | np.where(e["text_heavy"], heavy, light))
