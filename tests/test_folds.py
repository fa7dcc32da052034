import random

import pytest
from pyspark.sql import functions as F

from reelframe.config import SCREEN, ModeSettings, mode_settings
from reelframe.functions import grid, scores, text
from reelframe.operators import dedup, report, sampling, segments, selection, sequence, state


def _suppress(candidates, gap):
    kept = []
    for i, s in candidates:
        if kept and i - kept[-1][0] < gap:
            if s > kept[-1][1]:
                kept[-1] = (i, s)
        else:
            kept.append((i, s))
    return [i for i, _ in kept]


def test_suppression_equals_a_loop(spark):
    rng = random.Random(1)
    jobs = {j: [(i, rng.choice([0.1, 0.2, 0.3])) for i in sorted(rng.sample(range(60), rng.randint(0, 20)))] for j in range(40)}
    df = spark.createDataFrame([(j, [{"idx": i, "score": s} for i, s in c], j % 5 + 1) for j, c in jobs.items()], "job long, c array<struct<idx: long, score: double>>, gap long")
    for r in df.select("job", segments.suppress(F.col("c"), F.col("gap")).alias("k")).collect():
        assert r.k == _suppress(jobs[r.job], r.job % 5 + 1)


def _frames(spark, rows):
    return spark.createDataFrame(rows, "job long, idx long, t double, rejected boolean, is_split boolean, change_ratio double, min_frames long")


def test_segment_edges(spark):
    """One frame, two frames, all rejected, only an edge frame accepted, nothing long enough."""
    rows = [(1, 0, 0.0, False, False, 0.0, 1)]
    rows += [(2, i, i * 0.3, False, False, 0.1, 1) for i in range(2)]
    rows += [(3, i, i * 1.0, True, False, 0.1, 2) for i in range(4)]
    rows += [(4, i, i * 1.0, i != 0, False, 0.1, 2) for i in range(4)]
    rows += [(5, i, i * 0.1, False, i in (1, 2), 0.2, 3) for i in range(4)]
    m = segments.segment_frames(_frames(spark, rows), SCREEN)
    got = {}
    for r in m.orderBy("job", "idx").collect():
        got.setdefault((r.job, r.seg_no), []).append((r.idx, r.is_candidate))
    assert got[1, 1] == [(0, True)] and got[2, 1] == [(0, True), (1, True)]
    assert not any(j == 3 for j, _ in got)
    assert got[4, 1] == [(0, False), (1, True), (2, True), (3, False)]
    assert got[5, 1] == [(0, False), (1, True), (2, True), (3, False)] and (5, 2) not in got
    s = {r.job: r for r in segments.stable_segments(m).collect()}
    assert s[5].n == 4 and s[5].n_candidates == 2 and abs(s[5].mean_change_ratio - 0.2) < 1e-12


def test_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(1, 3, 0.5), (1, 1, 0.5), (1, 2, 0.4)], "job long, idx long, r double")
    assert selection.top_one(df, ["job"], F.col("r"), "idx").first().idx == 1


def test_soft_filter_keeps_a_group_without_accepted_rows(spark):
    df = spark.createDataFrame([(1, True), (1, False), (2, True), (2, True)], "job long, rejected boolean")
    assert sorted((r.job, r.rejected) for r in selection.soft_filter(df, ["job"]).collect()) == [(1, False), (2, True), (2, True)]


def test_greedy_dedup_equals_a_loop(spark):
    rng = random.Random(2)
    rows = [(j, i, i, float(rng.randint(0, 5)), rng.randint(0, 30), rng.randint(0, 3) * 1.0) for j in range(6) for i in range(40)]
    df = spark.createDataFrame(rows, "job long, id long, ord long, start double, x long, rank double")
    want = {}
    for j in range(6):
        kept = []
        for r in sorted((r for r in rows if r[0] == j), key=lambda r: (r[3], r[2])):
            at = next((i for i, k in enumerate(kept) if abs(k[4] - r[4]) <= 2), None)
            if at is None:
                kept.append(r)
            elif r[5] > kept[at][5]:
                kept[at] = r
        want |= {(j, s): k[1] for s, k in enumerate(kept, 1)}
    hof = dedup.greedy_dedup(df, lambda k, p: F.abs(k["x"] - p["x"]) <= 2, ["x"])
    plain = dedup.greedy_dedup_pandas(df, lambda k, p: abs(k["x"] - p["x"]) <= 2, ["x"])
    filed = dedup.greedy_dedup_pandas(df, lambda k, p: abs(k["x"] - p["x"]) <= 2, ["x"], lambda p: ([p["x"] // 3], [p["x"] // 3 + d for d in (-1, 0, 1)]))
    for out in (hof, plain, filed):
        assert {(r.job, r.slot): r.id for r in out.collect()} == want
    assert dedup.renumber(hof).where("page_number <> slot").isEmpty()


def test_band_pairs_find_all_close_pairs(spark):
    rng = random.Random(3)
    hashes = [rng.getrandbits(64) for _ in range(20)]
    hashes += [h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for h in hashes for _ in range(3)]
    df = spark.createDataFrame([(i % 2, i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)], "job long, id long, h long")
    want = {(a, b) for a in range(80) for b in range(a + 1, 80) if a % 2 == b % 2 and (hashes[a] ^ hashes[b]).bit_count() <= 4}
    got = [(r.left_id, r.right_id) for r in dedup.band_pairs(df, "h", 4).collect()]
    assert set(got) == want and len(got) == len(want)


TREE = [  # hash, gap, visual, layout, profile, tokens, text_heavy, weak -> duplicate
    (9, 1, 0.94, 1, 1, 1, False, True, False), (9, 1, 0.99, 0.95, 0.95, 0, False, False, True), (0, 1, 0.75, 0.9, 0.95, 0.85, False, True, True), (0, 1, 0.75, 0.9, 0.95, 0.85, False, False, False),
    (0, 5, 0.94, 0.91, 0.94, 0.95, True, False, True), (0, 1, 0.91, 0.91, 0.94, 0.98, True, False, True), (0, 1, 0.96, 0.93, 0.92, 0.1, True, False, False), (0, 1, 0.95, 0.93, 0.91, 0, False, False, True),
    (0, 5, 0.95, 0.93, 0.91, 0, False, False, False), (0, 5, 0.98, 0.96, 0.95, 0, False, False, True),
]


def test_duplicate_rules(spark):
    from reelframe.plans.reconstruct import is_duplicate

    rows = [(float(a), float(g), float(v), float(la), float(p), float(t), 0.0, h, w, x) for a, g, v, la, p, t, h, w, x in TREE]
    df = spark.createDataFrame(rows, "hash_distance double, gap double, visual double, layout double, profile double, tokens double, ocr double, text_heavy boolean, either_weak boolean, want boolean")
    for r in df.withColumn("got", scores.is_duplicate(scores.features(), 2)).collect():
        assert r.got == r.want == is_duplicate(r.asDict(), 2), r


def _quality(spark, rows):
    """Pages (start, end, score, changes) with the usual features of a good page."""
    base = {"page_coverage": 0.82, "rectangularity": 0.92, "single_page_score": 0.95, "background_intrusion_ratio": 0.02, "transition_penalty": 0.02, "readability_score": 0.88, "stability_score": 0.95, "rejected": False}
    out = [base | {"job": 1, "id": i, "ord": i, "start": a, "end": b, "score": s} | more for i, (a, b, s, more) in enumerate(rows)]
    return spark.createDataFrame(out)


@pytest.mark.parametrize(
    ("rows", "winner"),
    [
        ([(1.0, 1.4, 0.78, {"transition_penalty": 0.16}), (1.5, 1.9, 0.94, {"transition_penalty": 0.03}), (1.95, 2.25, 0.81, {"transition_penalty": 0.17})], 1),
        ([(3.0, 3.4, 0.7, {"rejected": True, "transition_penalty": 0.35}), (3.45, 3.9, 0.93, {}), (4.0, 4.3, 0.72, {"rejected": True, "transition_penalty": 0.32})], 1),
    ],
)
def test_sequence_representatives(spark, rows, winner):
    p = sequence.sequence_clusters(_quality(spark, rows), F.lit(0.95))
    q = scores.features()
    got = sequence.cluster_representatives(p, scores.sequence_rank(q), scores.weak(q, "sequence")).collect()
    assert [r.id for r in got] == [winner] and got[0].page_number == 1


def test_gates(spark):
    good = {n: 0.9 for n in ("sharpness_score", "readability_score", "page_coverage", "rectangularity", "single_page_score", "contour_confidence")} | {"text_density": 0.03, "found": True, "normalized": True}
    good |= {n: 0.02 for n in ("transition_penalty", "occlusion_ratio", "background_intrusion_ratio", "border_touch_ratio", "gutter_ratio", "opposing_page_ratio")}
    cases = [good, good | {"transition_penalty": 0.56}, good | {"background_intrusion_ratio": 0.28, "contour_confidence": 0.54}, good | {"found": False}]
    got = [r[0] for r in spark.createDataFrame(cases).select(scores.rejection_reasons(scores.features(), True)).collect()]
    assert got == [[], ["transition_motion"], ["background_clutter", "weak_page_isolation"], ["no_page_detected"]]


def test_selection_prefers_the_clean_page(spark):
    base = {"readability_score": 0.88, "stability_score": 0.95, "transition_penalty": 0.02, "occlusion_ratio": 0.0, "border_touch_ratio": 0.02, "rectangularity": 0.9, "text_density": 0.03, "rejected": False, "change_ratio": 0.02, "job": 1}
    rows = [base | {"idx": 5, "t": 1.0, "score": 0.9, "single_page_score": 0.28, "page_coverage": 0.48, "background_intrusion_ratio": 0.26}, base | {"idx": 6, "t": 1.5, "score": 0.84, "single_page_score": 0.96, "page_coverage": 0.86, "background_intrusion_ratio": 0.02}]
    rank = scores.selection_score(scores.features(), F.col("t"), F.lit(0.8), F.lit(2.0), True)
    assert selection.top_one(spark.createDataFrame(rows), ["job"], rank, "idx").first().idx == 6


def test_text_functions(spark):
    df = spark.createDataFrame([(-1.0, "abc", "abd"), (75.29, "", "x")], "s double, a string, b string")
    got = df.select(text.format_time(F.col("s")), text.text_ratio("a", "b"), text.normalize_text(F.lit(" A-b  C! "))).collect()
    assert [tuple(r) for r in got] == [("0:00.0", 2 / 3, "a b c"), ("1:15.2", 0.0, "a b c")]
    top = spark.createDataFrame([("ffffffffffffffff", "0000000000000001"), ("8000000000000000", "8")], "a string, b string")
    assert [r[0] for r in top.select(grid.hex_distance(F.col("a"), F.col("b"))).collect()] == [63, 62]
    flat = spark.createDataFrame([([1.0] * 4, [1.0, 2.0, 3.0, 4.0])], "a array<double>, b array<double>")
    assert flat.select(grid.correlation(F.col("a"), F.col("b"))).first()[0] == 1.0


def test_sampling(spark):
    f = spark.createDataFrame([(1, i, i / 10) for i in range(50)], "job long, idx long, t double")
    assert sampling.sample_frames(f, F.lit(10.0), F.lit(4.0)).count() == 25  # 2.5 rounds to 2
    with pytest.raises(ValueError, match="no frames"):
        sampling.require_frames(f.where("false"))
    assert mode_settings(spark).count() == 2
    with pytest.raises(ValueError, match="mode"):
        from reelframe.config import DEFAULT

        DEFAULT.mode("phone")


def test_state_changes(spark):
    p = spark.createDataFrame([(1, "a", 0, 0, False), (1, "b", 1, 0, False), (2, "c", 0, 90, True)], "job long, id string, order_index long, rotation long, deleted boolean")
    patch = spark.createDataFrame([(1, "a", -90, None)], "job long, id string, rotation long, deleted boolean")
    got = {r.id: r for r in state.update_pages(p, patch).collect()}
    assert got["a"].rotation == 270 and got["b"].touched and not got["c"].touched
    bulk = spark.createDataFrame([(1, ["a", "x"], 90, True), (2, ["c"], None, False)], "job long, ids array<string>, rotation long, deleted boolean")
    got = {r.id: r for r in state.bulk_update(p, bulk).collect()}
    assert (got["a"].rotation, got["a"].deleted, got["c"].deleted, got["c"].rotation) == (0, False, False, 90)
    order = spark.createDataFrame([(1, ["b", "a"]), (2, ["c", "c"])], "job long, ids array<string>")
    got = {r.id: r for r in state.reorder_pages(p, order).collect()}
    assert (got["b"].order_index, got["a"].order_index, got["c"].applied) == (0, 1, False)
    new = spark.createDataFrame([(1, "m"), (3, "n")], "job long, id string")
    assert {r.id: r.order_index for r in state.append_page(p, new).collect()} == {"a": 0, "b": 1, "c": 0, "m": 2, "n": 0}
    jobs = spark.createDataFrame([(1, "processing", "processing", 2), (2, "ready", "idle", 1)], "job long, status string, export_status string, revision long")
    got = {r.job: r for r in state.recover_jobs(jobs).collect()}
    assert (got[1].status, got[1].export_status, got[2].status) == ("failed", "failed", "ready")
    done = spark.createDataFrame([(1, 2, "u"), (2, 0, "v")], "job long, revision long, url string")
    got = {r.job: r for r in state.finish_exports(jobs.withColumn("export_url", F.lit(None).cast("string")), done).collect()}
    assert (got[1].export_status, got[1].export_url, got[2].export_url) == ("ready", "u", None)
    st = spark.createDataFrame([(1, "a", 0, "complete"), (1, "b", 1, "processing"), (1, "c", 2, "processing")], "job long, key string, place long, status string")
    assert {r.key: r.status for r in state.fail_stages(st).collect()} == {"a": "complete", "b": "failed", "c": "processing"}


def test_report(spark):
    cases = spark.createDataFrame([("a", 3, 8, 0), ("b", 1, None, None), ("c", 1, 2, 1)], "name string, min_pages long, max_pages long, max_weak long")
    res = spark.createDataFrame([("a", 2, 1), ("b", 9, 9)], "name string, pages long, weak long")
    got = {r.name: r for r in report.evaluate_cases(cases, res).collect()}
    assert got["a"].detail == "pages=2 weak_pages=1 failures=pages 2 < min 3, weak_pages 1 > max 0" and got["b"].passed and got["c"].skipped
    assert tuple(report.summarize(report.evaluate_cases(cases, res)).first()) == (3, 2, 1)
    assert ModeSettings(4.0, 0.5, 0.008, 3, 0.012, 2) == SCREEN


def test_runs_of_suppression_equal_one_fold(spark):
    rng = random.Random(6)
    rows = []
    for j in range(30):
        gap = rng.randint(0, 9)
        rows += [(j, i, rng.choice([0.1, 0.2, 0.3]), rng.random() < 0.4, gap) for i in range(rng.randint(1, 120))]
    df = spark.createDataFrame(rows, "job long, idx long, transition_score double, is_transition boolean, min_frames long")
    want = {(j, i) for j in range(30) for i in _suppress([(r[1], r[2]) for r in rows if r[0] == j and r[3]], max(1, next(r[4] for r in rows if r[0] == j)))}
    assert {(r.job, r.idx) for r in segments.nms_splits(df).collect()} == want
    marked = segments.with_splits(df).collect()
    assert len(marked) == len(rows) and {(r.job, r.idx) for r in marked if r.is_split} == want


def test_a_long_job_is_segmented_in_linear_time(spark):
    import time

    def took(n):
        df = spark.range(n).select(F.lit(1).alias("job"), F.col("id").alias("idx"), (F.col("id") * 0.25).alias("t"), F.pmod(F.hash("id"), F.lit(97)).cast("double").alias("transition_score"), (F.col("id") % 3 == 0).alias("is_transition"), F.lit(4).cast("long").alias("min_frames"))
        wanted = df.select("job", (F.col("t") + 0.1).alias("wanted_t"))
        start = time.time()
        splits = segments.with_splits(df).where("is_split").count()
        hits = sampling.nearest_frame(df, wanted).where("idx is not null").count()
        assert n // 20 < splits < n // 3 and hits == n
        return time.time() - start

    took(1000)
    assert took(200_000) < 12 * took(20_000) + 15


def test_both_duplicate_decisions_agree(spark):
    """The rules on columns and on plain values, around all their limits."""
    from reelframe.plans.reconstruct import is_duplicate

    rng = random.Random(12)
    some = {"hash_distance": [0, 8, 9, 20], "gap": [0.0, 2.4, 2.5], "visual": [0.71, 0.72, 0.9, 0.93, 0.94, 0.95, 0.975, 0.98, 1.0], "layout": [0.88, 0.89, 0.9, 0.92, 0.94, 0.95], "profile": [0.89, 0.9, 0.92, 0.93, 0.94], "tokens": [0.83, 0.84, 0.9, 0.97], "ocr": [0.0, 0.9], "text_heavy": [True, False], "either_weak": [True, False]}
    rows = [{k: rng.choice(v) for k, v in some.items()} for _ in range(4000)]
    df = spark.createDataFrame(rows, "hash_distance long, gap double, visual double, layout double, profile double, tokens double, ocr double, text_heavy boolean, either_weak boolean")
    got = [r.d for r in df.select(scores.is_duplicate(F.col, 2).alias("d")).collect()]
    want = [is_duplicate(r, 2) for r in rows]
    assert got == want and 100 < sum(want) < 3900


def test_long_jobs_fold_in_blocks_as_in_a_loop(spark, tmp_path):
    """8,000 pages of one job (interpreted columns took minutes), across blocks, batches and slot steps."""
    import time

    from reelframe.plans.page_queries import dedup_greedy

    rng = random.Random(13)
    vectors = [[rng.random() for _ in range(64)] for _ in range(8000)]
    spark.createDataFrame([(7, i, v) for i, v in enumerate(vectors)], "label int, vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    start = time.time()
    got = {r.slot: r.id for r in dedup_greedy(spark, str(tmp_path)).collect()}
    assert time.time() - start < 40
    rows = spark.read.parquet(str(tmp_path / "embeddings.parquet")).select("vec_id", F.element_at("embedding", 1).alias("rank"), grid.dhash(F.col("embedding")).alias("h")).orderBy("vec_id").collect()
    kept = []
    for r in rows:
        at = next((i for i, k in enumerate(kept) if (k.h ^ r.h).bit_count() <= 19), None)
        if at is None:
            kept.append(r)
        elif r.rank > kept[at].rank:
            kept[at] = r
    assert got == {s: k.vec_id for s, k in enumerate(kept, 1)} and len(kept) > dedup.FIRST_SLOTS


def test_the_block_fold_has_the_orders_of_sql(spark):
    """Null and NaN ranks, ties, null fields and jobs, text ids; against the fold on columns."""
    rng = random.Random(14)
    rank = lambda: rng.choice([None, float("nan"), float("inf"), -0.0, 0.0, -1.5, 1.0, 2.0])
    rows = [(rng.choice([None, "a", "b", "c"]), f"p{i:05}", i, rng.choice([None, 0.0, 1.0]), rng.choice([None, *range(60)]), rank()) for i in range(3000)]
    df = spark.createDataFrame(rows, "job string, id string, ord long, start double, x long, rank double")
    want = dedup.greedy_dedup(df, lambda k, p: F.abs(k["x"] - p["x"]) <= 2, ["x"])
    got = dedup.greedy_dedup_blocks(df, lambda k, p: abs(k["x"] - p["x"]) <= 2, ["x"])
    rows = lambda d: sorted(map(str, d.collect()))
    assert got.schema.simpleString() == want.schema.simpleString() and rows(got) == rows(want)


def test_all_duplicate_decisions_agree_on_arrays(spark):
    import numpy as np

    from reelframe.plans.reconstruct import is_duplicate

    rng = random.Random(15)
    some = {"hash_distance": [0, 8, 9, 20], "gap": [0.0, 2.4, 2.5], "visual": [0.71, 0.72, 0.9, 0.93, 0.94, 0.95, 0.975, 0.98, 1.0], "layout": [0.88, 0.89, 0.9, 0.92, 0.94, 0.95], "profile": [0.89, 0.9, 0.92, 0.93, 0.94], "tokens": [0.83, 0.84, 0.9, 0.97], "ocr": [0.0, 0.9], "text_heavy": [True, False], "either_weak": [True, False]}
    rows = [{k: rng.choice(v) for k, v in some.items()} for _ in range(4000)]
    got = scores.is_duplicate_arrays({k: np.array([r[k] for r in rows]) for k in some}, 2)
    assert got.tolist() == [is_duplicate(r, 2) for r in rows]


def test_windows_in_a_row_share_their_sorts(spark, sf_dir):
    """Each sort of a task holds all its rows: best_frame had eleven."""
    from reelframe.plans.frame_queries import QUERIES

    sorts = lambda name: QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().count("Sort [")
    # two branches by time, frames with splits, segments, ranks
    assert 0 < sorts("best_frame") <= 5 and sorts("stable_segments") <= 4 and sorts("adaptive_thresholds") == 1 and sorts("transition_rows") == 1


def test_frames_of_a_task_are_bounded(spark, sf_dir, monkeypatch):
    """A large table is dealt over more partitions than the session has, once and with the same rows."""
    from reelframe.plans import views
    from reelframe.plans.frame_queries import QUERIES

    want = sorted(map(str, QUERIES["best_frame"](spark, sf_dir).collect()))
    monkeypatch.setattr(views, "FRAMES_A_TASK", 100)
    df = QUERIES["best_frame"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == plan.count("Exchange hashpartitioning(job#") == 2 and f", {-(-views.table(spark, sf_dir, 'events').count() // 100)}), REPARTITION_BY_NUM" in plan
    assert sorted(map(str, df.collect())) == want
