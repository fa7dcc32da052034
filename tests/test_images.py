import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.functions import document, images
from reelframe.plans import reconstruct as rc
from reelframe.sources import images as src
from reelframe.sources import sinks


def rect(a, x0, y0, x1, y1, color):
    a[y0 : y1 + 1, x0 : x1 + 1] = color


def page(darken=0, shift=0):
    a = np.full((520, 380, 3), 255, np.uint8)
    rect(a, 40 + shift, 32, 322 + shift, 470, 190)
    rect(a, 42 + shift, 34, 320 + shift, 468, 242)
    for r in range(14):
        rect(a, 74 + shift, 61 + 26 * r, 288 + shift - 12 * (r % 3), 63 + 26 * r, 35 + darken)
    return a


def alt_page(shift=0):
    a = np.full((520, 380, 3), 255, np.uint8)
    rect(a, 42 + shift, 34, 320 + shift, 468, 242)
    for r in range(7):
        rect(a, 78 + shift, 72 + 48 * r, 272 + shift, 82 + 48 * r, 50)
    rect(a, 82 + shift, 392, 236 + shift, 420, 60)
    return a


def scene():
    a = np.full((420, 320, 3), (58, 82, 106), np.uint8)
    rect(a, 42, 36, 276, 384, 246)
    for y in (80, 140, 200, 260):
        rect(a, 70, y, 240, y + 6, 40)
    return a


def test_resize_keeps_the_mean():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (37, 53)).astype(np.uint8)
    assert abs(images.resize(a, 9, 8).mean() - a.mean()) < 1e-9 and images.resize(a, 53, 37).shape == (37, 53)
    assert np.allclose(images.resize(a, 53, 37), a)


def test_components_against_flood_fill():
    rng = np.random.default_rng(2)
    mask = rng.random((40, 50)) < 0.35
    labels, stats = images.components(mask)
    seen = np.zeros(mask.shape, int)
    n = 0
    for y, x in zip(*np.nonzero(mask)):
        if not seen[y, x]:
            n += 1
            stack = [(y, x)]
            while stack:
                a, b = stack.pop()
                if 0 <= a < 40 and 0 <= b < 50 and mask[a, b] and not seen[a, b]:
                    seen[a, b] = n
                    stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert len(stats) == n and sum(s[4] for s in stats) == mask.sum()
    assert len({(a, b) for a, b in zip(labels[mask], seen[mask])}) == n


def test_features_of_simple_images():
    flat = np.full((60, 80, 3), 120, np.uint8)
    m = images.measures(flat)
    assert m["sharpness"] == m["contrast"] == m["edge_density"] == 0 and images.dhash(flat) == "0" * 16
    step = flat.copy()
    step[:, 40:] = 220
    assert images.measures(step)["edge_density"] > 0 and images.change_ratio(flat, step) > 0.45 and images.change_ratio(step, step) == 0
    assert images.histogram_similarity(np.zeros((4, 4)), np.zeros((4, 4))) == pytest.approx(1.0)
    assert images.rotate(step, 90).shape == (80, 60, 3) and np.array_equal(images.rotate(images.rotate(step, 90), -90), step)
    assert min(images.rotate(step, 30).shape[:2]) > 60


def test_blur_lowers_sharpness():
    a = page()
    blurred = images.to_bytes(np.stack([images.gaussian(a[..., i], 13, 4) for i in range(3)], axis=-1))
    assert images.measures(blurred)["sharpness"] < 0.2 * images.measures(a)["sharpness"]


def test_morphology_against_plain_windows():
    rng = np.random.default_rng(3)
    mask, grey = rng.random((17, 23)) < 0.4, rng.integers(0, 256, (17, 23)).astype(float)
    for size in (2, 3, 4, 5):
        a, b = (size - 1) // 2, size // 2
        for y in range(17):
            for x in range(23):
                assert images.erode(mask, size)[y, x] == mask[max(y - a, 0) : y + b + 1, max(x - a, 0) : x + b + 1].all()
                assert images.dilate(mask, size)[y, x] == mask[max(y - b, 0) : y + a + 1, max(x - b, 0) : x + a + 1].any()
        assert not (images.opened(mask, size) & ~mask).any() and (images.closed(mask, size) | ~mask).all()
    p = np.pad(grey, 2, mode="reflect")
    assert np.allclose(images.box(grey, 5), [[p[y : y + 5, x : x + 5].mean() for x in range(23)] for y in range(17)])
    ring = np.zeros((9, 9), bool)
    ring[2:7, 1:8] = True
    ring[3:6, 3:5] = False
    assert document.filled_area(ring) == 35


def test_crop_by_colour_then_by_light():
    pale = np.full((300, 240, 3), (40, 40, 40), np.uint8)
    rect(pale, 30, 40, 209, 259, 240)
    assert document.page_box(document.page_mask(pale)) == (34, 266, 24, 216) and document.crop(pale).shape == (232, 192, 3)
    tinted = np.full((300, 240, 3), (20, 30, 30), np.uint8)  # yellow paper: too saturated for the first mask
    rect(tinted, 30, 40, 209, 259, (60, 190, 215))
    assert document.page_box(document.page_mask(tinted)) is None and document.crop(tinted).shape == (232, 192, 3)
    assert document.crop(pale[:79]).shape == (79, 240, 3)
    noise = np.random.default_rng(4).integers(0, 256, (120, 160, 3)).astype(np.uint8)
    assert document.crop(noise).shape == noise.shape


def test_finished_pages():
    """Thin strokes stay, ink at the border goes, and a page that stays dark is given in light greys."""
    a = np.full((200, 160, 3), 250, np.uint8)
    rect(a, 40, 60, 120, 61, 30)
    rect(a, 0, 120, 60, 123, 30)
    final = document.finish(a)[20:-20, 20:-20, 0]
    assert document.finish(a).shape == (240, 200, 3) and set(np.unique(final)) == {0, 255}
    assert (final[58:64, 60:100] == 0).any() and (final[116:128, :70] == 255).all()
    dark = np.full((200, 160), 250, np.uint8)
    yy, xx = np.indices((180, 140))
    dark[10:190, 10:150] = np.where((yy % 16 < 10) & (xx % 16 < 10), 20, 250)
    soft = document.finish(np.repeat(dark[..., None], 3, axis=2))[20:-20, 20:-20, 0]
    assert soft.min() == 135 and soft.max() == 255 and len(np.unique(soft)) > 2


def test_page_measures():
    a = np.full((100, 200, 3), 250, np.uint8)
    a[:, :28] = 0  # dark outer bands, 14 % each, weigh against the fold
    a[:, 172:] = 0
    a[:, 94:106] = 0
    assert document.gutter(a) == 0.0
    a[:, :28] = a[:, 172:] = 250
    assert document.gutter(a) == pytest.approx(0.5)
    assert document.perspective_score(np.array([[0, 0], [100, 0], [100, 50], [20, 50]], float)) == pytest.approx(1 - (0.2 + abs(np.hypot(20, 50) - 50) / np.hypot(20, 50)) / 2)
    assert document.background_intrusion(np.full((60, 60, 3), 200, np.uint8)) == 1.0


def test_detects_a_page_on_a_desk():
    d = document.detect(scene())
    assert d["found"] and d["page_coverage"] > 0.5 and d["rectangularity"] > 0.85 and d["single_page_score"] > 0.5
    h, w = d["corrected"].shape[:2]
    assert 300 < h < 400 and 200 < w < 280
    final = document.finish(d["corrected"])
    assert final.shape[2] == 3 and (final > 250).mean() > 0.7
    none = document.detect(np.full((100, 100, 3), 90, np.uint8))
    assert not none["found"] and none["background_intrusion_ratio"] == 1.0


def test_spread_is_not_a_single_page():
    a = np.full((540, 760, 3), 244, np.uint8)
    rect(a, 40, 34, 355, 500, 250)
    rect(a, 405, 34, 720, 500, 250)
    rect(a, 367, 34, 393, 500, 40)
    for r in range(15):
        rect(a, 70, 60 + 28 * r, 320, 62 + 28 * r, 60)
        rect(a, 440, 60 + 28 * r, 690, 62 + 28 * r, 60)
    d = document.detect(a)
    assert document.gutter(a) > 0.11 and not d["normalized"]


def _signed(rows):
    out = []
    for i, (start, score, image, more) in enumerate(rows):
        p = images.render(image)
        out.append({"job": "j", "idx": i, "id": i, "ord": i, "start": start, "rank": score, "phash": images.dhash(image), "content": images.content_signature(p), "layout": images.layout_signature(p), "tokens": images.structure_tokens(p), "text_density": 0.028, "weak": False} | more)
    return out


def _greedy(rows):
    kept = []
    for p in _signed(rows):
        at = next((i for i, k in enumerate(kept) if rc.is_duplicate(rc.evidence(k, p), 6)), None)
        if at is None:
            kept.append(p)
        elif p["rank"] > kept[at]["rank"]:
            kept[at] = p
    return [k["id"] for k in kept]


def test_near_duplicates_collapse_and_other_layouts_stay():
    assert _greedy([(1.0, 0.82, page(), {}), (2.2, 0.95, page(darken=10), {})]) == [1]
    assert _greedy([(1.0, 0.9, page(), {}), (2.1, 0.88, alt_page(), {})]) == [0, 1]
    assert _greedy([(1.0, 0.68, page(shift=1), {"weak": True}), (1.45, 0.94, page(), {})]) == [1]


def test_pages_that_match_share_a_key():
    """Over altered pages: what the rules accept is always found by the keys, and they tell most others apart."""
    rng = np.random.default_rng(5)
    shots = [f(shift=int(s)) for f in (page, alt_page) for s in range(0, 12, 2)] + [page(darken=int(d)) for d in (0, 10, 40, 80)]
    shots += [images.to_bytes(page() + rng.normal(0, s, page().shape)) for s in (2, 6, 12, 25)] + [images.to_bytes(alt_page() * k) for k in (0.9, 0.8, 0.6)]
    rows = _signed([(float(i), 0.9, s, {"weak": bool(i % 2)}) for i, s in enumerate(shots)])
    accepted = 0
    for most in (2, 6):
        keys = [rc.match_keys(most)(r) for r in rows]
        for i, a in enumerate(rows):
            for j, b in enumerate(rows[:i]):
                if rc.is_duplicate(rc.evidence(b, a), most, window=4.0):
                    accepted += 1
                    assert set(keys[j][0]) & set(keys[i][1])
    assert accepted > 20
    a, far = rows[0], dict(rows[0], phash=f"{int(rows[0]['phash'], 16) ^ (2**64 - 1):016x}", content=np.clip(rows[0]["content"] + 0.2, 0, 1))
    assert not set(rc.match_keys(6)(a)[0]) & set(rc.match_keys(6)(far)[1])


def test_png_round_trip_and_reconstruction(spark, tmp_path):
    """A recording of two pages, read back by the image source, gives two pages, a PDF and a report."""
    shots = [page()] * 8 + [alt_page()] * 8
    for i, s in enumerate(shots):
        sinks.write_file(f"{tmp_path}/frames/rec/{i}.png", src.png(s))
    frames = src.read_frames(spark, f"file://{tmp_path}/frames", 4.0)
    first = frames.where("idx = 0").first()
    assert np.array_equal(src.to_array(first.height, first.width, first.data), page())
    out = rc.reconstruct(frames, 4.0, "screen")
    pages = out.pages.orderBy("page_number").select("job", "idx", "page_number", "label", "slot").collect()
    assert [(p.job, p.idx >= 8, p.label) for p in pages] == [("rec", False, "Page 1"), ("rec", True, "Page 2")]
    chosen = out.pages.select("job", "idx", "page_id", "page_number").join(frames.select("job", "idx", "height", "width", "data"), ["job", "idx"])
    paths = sinks.write_pages(chosen, f"{tmp_path}/store").collect()
    assert len(paths) == 2 and all(p.image_url.startswith("/artifacts/jobs/rec/pages/") for p in paths)
    pdf = sinks.export_pdf(chosen.select("job", F.col("page_number").alias("order_index"), F.lit(90).alias("rotation"), "height", "width", "data"), f"{tmp_path}/store").first()
    data = open(pdf.path, "rb").read()
    assert pdf.n_pages == 2 and data.startswith(b"%PDF-1.4") and data.count(b"/Type /Page ") == 2 and int(re.search(rb"startxref\n(\d+)", data)[1]) == data.index(b"xref\n")
    report = sinks.debug_report(out.frames, out.segments, out.selected, out.collapsed, out.pages).first().report
    assert '"sampled_frames":16' in report and '"deduped_pages":2' in report
    marked = out.frames.select("job", "idx", (F.col("idx") % 2 == 0).alias("rejected")).join(frames, ["job", "idx"])
    shown = sinks.debug_images(marked, chosen, f"{tmp_path}/store", most=3).collect()
    assert sorted((r.kind, r.place) for r in shown) == [("kept", 1), ("kept", 2), ("rejected", 1), ("rejected", 2), ("rejected", 3)]
    assert all(open(r.path, "rb").read(4) == b"\x89PNG" for r in shown) and any(r.path.endswith("/debug/rec/rejected-03-frame-4.png") for r in shown)
    with pytest.raises(ValueError, match="no pages"):
        sinks.pdf([])


def test_no_pixels_in_a_shuffle(spark):
    """The feature pass reads pixels in a map; only numbers and miniatures are brought together."""
    df = spark.createDataFrame([("j", i, i / 4, 12, 16, bytearray(12 * 16 * 3)) for i in range(4)], src.FRAME_SCHEMA)
    found = rc.frame_features(df, False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = plan[: plan.index("MapInPandas")]
    assert "Exchange" in scans and "Exchange" not in plan[plan.index("MapInPandas") :] and "data#" not in scans
    got = {r.idx: (r.change, r.transition_penalty) for r in found.collect()}
    assert got == {0: (None, 0.0), 1: (0.0, 0.0), 2: (0.0, 0.0), 3: (0.0, 0.0)}


def test_camera_penalties_follow_the_frame_before(spark):
    shots = [scene(), scene(), np.full((420, 320, 3), 90, np.uint8)]
    df = spark.createDataFrame([("j", i, i / 3, 420, 320, bytearray(s.tobytes())) for i, s in enumerate(shots)], src.FRAME_SCHEMA)
    got = {r.idx: r for r in rc.frame_features(df, True).collect()}
    d = document.detect(shots[0])
    alone = max(0, 0.42 - d["page_coverage"]) + max(0, 0.58 - d["single_page_score"]) + 1.2 * max(0, d["background_intrusion_ratio"] - 0.08) + 0.8 * max(0, d["border_touch_ratio"] - 0.05) + 1.1 * d["occlusion_ratio"]
    assert got[0].transition_penalty == pytest.approx(alone) and got[1].transition_penalty == pytest.approx(alone)
    n = document.detect(shots[2])
    gone = 0.35 + 0.42 + 0.58 + 1.2 * 0.92 + 0.8 * 0.95 + 1.1 * n["occlusion_ratio"] + 0.22 + images.motion(shots[1], shots[2])
    assert got[2].transition_penalty == pytest.approx(gone)


def blur(a):
    return images.to_bytes(np.stack([images.gaussian(a[..., i], 13, 4) for i in range(3)], axis=-1))


def test_debug_report_lists_all(spark):
    number = "t score readability_score transition_penalty single_page_score page_coverage background_intrusion_ratio gutter_ratio opposing_page_ratio start end mean_change_ratio".split()
    frames = spark.range(40).select(
        F.lit("j").alias("job"), F.col("id").alias("idx"), *[F.col("id").cast("double").alias(c) for c in number], F.array(F.lit("blur")).alias("reasons"), (F.col("id") < 25).alias("rejected"),
        F.floor(F.col("id") / 2).alias("seg_no"), (F.col("id") % 2 == 1).alias("is_candidate"),
    )
    pages = frames.where("is_candidate").withColumns({"page_id": F.concat(F.lit("page-"), "seg_no"), "label": F.lit("Page"), "notes": F.array(F.lit("n")), "ord": F.col("seg_no"), "page_number": F.col("seg_no")})
    report = json.loads(sinks.debug_report(frames, frames, pages, pages.where("idx < 35"), pages.where("idx < 31")).first().report)
    assert report["counts"] == {"sampled_frames": 40, "rejected_frames": 25, "segments": 20, "selected_pages": 20, "sequence_pages": 17, "deduped_pages": 15}
    assert [f["frame_index"] for f in report["rejected_frames"]] == list(range(25)) and report["rejected_frames"][3]["rejection_reasons"] == ["blur"]
    assert [s["candidate_frame_indices"] for s in report["segments"]] == [[2 * i + 1] for i in range(20)]
    assert [len(report[k]) for k in ("selected_pages", "sequence_pages", "deduped_pages")] == [20, 17, 15] and report["deduped_pages"][14]["frame_index"] == 29
    assert report["job_id"] == "j" and report["segments"][2]["segment_id"] == report["selected_pages"][2]["source_segment_id"] == "segment-2"
    none = json.loads(sinks.debug_report(frames.withColumn("rejected", F.lit(False)), frames.where("false"), pages, pages, pages.where("false")).first().report)
    assert none["rejected_frames"] == none["segments"] == none["deduped_pages"] == [] and none["counts"]["selected_pages"] == 20


def shots_of(path):
    """Decoder of the frame source for the test below."""
    for i in range(7):
        yield np.full((4, 5, 3), i, np.uint8)


def test_frame_source(spark):
    spark.dataSource.register(src.FrameSource)
    df = spark.read.format("frames").option("paths", "a,b").option("decoder", "tests.test_images:shots_of").option("fps", "2").option("interval", "3").load()
    assert sorted((r.job, r.idx, r.t) for r in df.collect()) == [(j, i, i / 2) for j in "ab" for i in (0, 3, 6)]


def test_quality_scenarios(spark):
    from reelframe.plans import scenarios

    found = {r.name: (r.passed, r.detail) for r in scenarios.report(spark).collect()}
    assert len(found) == 4 and all(p for p, _ in found.values()), found
