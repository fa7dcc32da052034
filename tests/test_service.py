import json

import pytest

from reelframe.service import JobService, NotFound
from reelframe.sources import state_store
from reelframe.streaming import ingest


def _page(i, **more):
    return {"id": i, "order_index": int(i[1:]), "rotation": 0, "deleted": False, "manual": False, "status": "active", "image_path": None, "thumbnail_path": None, "segment_start": 0.0, "segment_end": 1.0} | more


def test_life_of_a_job(spark, tmp_path):
    s = JobService(spark, str(tmp_path), run=lambda job, stage: [_page("p0"), _page("p1")], export=lambda job, pages, progress: f"/artifacts/exports/{job['id']}.pdf")
    job = s.create("a.mp4")
    s.wait()
    assert s.get(job["id"])["status"] == "ready" and all(x["status"] == "complete" for x in s.get(job["id"])["stages"])
    s.update_pages(job["id"], ["p0"], rotation=-90)
    s.update_pages(job["id"], ["p0", "p1"], deleted=True)
    assert [p["rotation"] for p in s.get(job["id"])["pages"]] == [270, 0]
    s.export(job["id"])
    s.wait()
    assert s.get(job["id"])["export"]["error"] == "No active pages available for export."
    s.update_pages(job["id"], ["p1"], deleted=False)
    assert s.get(job["id"])["export"]["status"] == "idle"
    s.reorder(job["id"], ["p1", "p0"])
    s.add_page(job["id"], segment_start=0.8)
    assert [p["order_index"] for p in s.get(job["id"])["pages"]] == [0, 1, 2] and s.get(job["id"])["pages"][0]["id"] == "p1"
    for bad in (["p1"], ["p1", "p1", "p0"]):
        with pytest.raises(ValueError, match="once"):
            s.reorder(job["id"], bad)
    with pytest.raises(NotFound):
        s.update_pages(job["id"], ["p0", "zz"], rotation=90)
    with pytest.raises(NotFound):
        s.get("none")
    with pytest.raises(ValueError, match="mode"):
        s.create("b", mode="phone")
    s.export(job["id"])
    s.wait()
    assert s.get(job["id"])["export"]["status"] == "ready"
    again = JobService(spark, str(tmp_path))
    assert json.dumps(again.get(job["id"]), sort_keys=True) == json.dumps(s.get(job["id"]), sort_keys=True)
    assert [r.page_number for r in again.active_pages(job["id"]).orderBy("page_number").collect()] == [1, 2]


def test_restart_fails_what_was_running(spark, tmp_path):
    s = JobService(spark, str(tmp_path))
    job = s.create("a.mp4")
    s.start_stage(job["id"], "sample")
    got = JobService(spark, str(tmp_path)).get(job["id"])
    assert got["status"] == "failed" and got["stages"][0]["status"] == "failed" and "re-uploaded" in got["notes"][0]


def test_failed_run_and_stale_export(spark, tmp_path):
    def broken(job, stage):
        raise RuntimeError("no frames")

    s = JobService(spark, str(tmp_path), run=broken)
    job = s.create("a.mp4")
    s.wait()
    assert s.get(job["id"])["status"] == "failed" and s.get(job["id"])["stages"][0]["status"] == "failed"
    s.add_page(job["id"])
    old = s.get(job["id"])["revision"]
    s.add_page(job["id"])
    s._finish_export(job["id"], old)
    assert s.get(job["id"])["export"]["status"] == "idle"


def test_tolerant_state(spark, tmp_path):
    assert state_store.read_jobs(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "bad.json").write_text("{nonsense")
    assert state_store.read_jobs(spark, f"{tmp_path}/bad.json").count() == 0
    (tmp_path / "part.json").write_text('{"jobs": [{"id": "x"}]}')
    row = state_store.read_jobs(spark, f"{tmp_path}/part.json").first()
    assert (row.status, row.mode, row.pages) == ("queued", "screen", [])
    (tmp_path / "manifest.json").write_text('{"cases": [{"name": "a", "input_path": "v/a.mp4", "min_pages": 3}]}')
    case = state_store.read_manifest(spark, f"{tmp_path}/manifest.json").first()
    assert (case.input_path, case.processing_mode, case.min_pages, case.max_pages) == (f"{tmp_path}/v/a.mp4", "camera", 3, None)


def test_stream_equals_batch(spark, tmp_path, sf_dir):
    from reelframe.plans.frame_queries import deltas

    raw = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id AS job", "cast(ts AS timestamp) AS ts", "value", "event_type = 'error' AS rejected").where("job < 6")
    for i in range(2):  # two micro-batches in time order
        half = raw.where(f"(ts < timestamp'2024-01-16') = {'true' if i == 0 else 'false'}")
        half.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = []
    stream = ingest.stream_events(spark, f"{tmp_path}/in", raw.schema)
    ingest.run_once(ingest.stream_deltas(stream.select("job", "ts", "value")), lambda df, n: got.extend(df.collect()), f"{tmp_path}/ck", "append")
    want = {(r.job, r.idx): r.change_ratio for r in deltas(spark, sf_dir).where("job < 6").collect()}
    assert {(r.job, r.idx): r.change or 0.0 for r in got} == pytest.approx(want)


def test_export_without_a_writer_fails(spark, tmp_path):
    s = JobService(spark, str(tmp_path), run=lambda job, stage: [_page("p0")])
    job = s.create("a.mp4")
    s.wait()
    s.export(job["id"])
    s.wait()
    assert s.get(job["id"])["export"]["status"] == "failed" and s.get(job["id"])["export"]["url"] is None


def test_stages_are_told_as_they_begin(spark, tmp_path):
    seen = []

    def run(job, stage):
        for key in ("segment", "select"):
            stage(key)
            now = s.get(job["id"])
            seen.append(([x["status"] for x in now["stages"]], now["percent"]))
        return []

    s = JobService(spark, str(tmp_path), run=run)
    s.create("a.mp4")
    s.wait()
    assert seen[0][0] == ["complete", "processing", "pending", "pending", "pending"] and seen[1][0][:3] == ["complete", "complete", "processing"]
    assert 5 < seen[0][1] < seen[1][1] < 100


def test_recording_to_pages_to_file_over_routes(spark, tmp_path):
    """Upload, reconstruction, manual page, order, rotation and export through the routes, with a real recording."""
    from reelframe import api, workflow
    from reelframe.sources import images as src
    from reelframe.sources import sinks

    from .test_images import alt_page, page

    folder = str(tmp_path / "store")
    recording = lambda job: src.read_frames(spark, f"file://{tmp_path}/frames", 4.0)
    s = JobService(spark, folder, run=lambda job, stage: workflow.runner(recording, 4.0, folder)(job, stage), export=workflow.exporter(spark, folder))
    call = lambda *a: api.handle(s, *a, frames_of=recording)
    assert call("GET", "/health") == (200, {"status": "ok"}) and call("GET", "/jobs") == (200, [])
    real, s._run = s._run, None
    job = call("POST", "/jobs/upload", {"filename": "rec.mp4"})[1]["id"]
    for i, shot in enumerate([page()] * 8 + [alt_page()] * 8):
        sinks.write_file(f"{tmp_path}/frames/{job}/{i}.png", src.png(shot))
    s._run = real
    s._process(job)
    status, got = call("GET", f"/jobs/{job}")
    assert status == 200 and got["status"] == "ready" and [p["order_index"] for p in got["pages"]] == [0, 1], got["message"]
    assert all(open(p["image_path"], "rb").read(4) == b"\x89PNG" for p in got["pages"])
    status, got = call("POST", f"/jobs/{job}/pages/manual", {"timestamp": 2.6})
    manual = got["pages"][2]
    assert status == 200 and manual["manual"] and manual["segment_start"] == 2.5 and open(manual["thumbnail_path"], "rb").read(4) == b"\x89PNG"
    ids = [p["id"] for p in got["pages"]]
    assert call("POST", f"/jobs/{job}/pages/reorder", {"page_ids": ids[::-1]})[0] == 200 and call("POST", f"/jobs/{job}/pages/reorder", {"page_ids": ids[:1]})[0] == 400
    assert call("PATCH", f"/jobs/{job}/pages/{ids[0]}", {"rotation": 90})[0] == 200 and call("PATCH", f"/jobs/{job}/pages", {"page_ids": [ids[1]], "deleted": True})[0] == 200
    assert call("POST", f"/jobs/{job}/export")[1]["status"] == "processing"
    s.wait()
    done = s.get(job)["export"]
    data = open(f"{folder}/exports/{job}.pdf", "rb").read()
    assert done["status"] == "ready" and done["url"] == f"/artifacts/exports/{job}.pdf" and data.startswith(b"%PDF") and data.count(b"/Type /Page ") == 2
    assert [call(*a)[0] for a in (("GET", "/jobs/none"), ("POST", "/jobs/none/export"), ("PATCH", f"/jobs/{job}/pages/zz"), ("PATCH", "/jobs/none/pages"), ("POST", "/jobs/none/pages/manual"), ("POST", "/jobs/none/pages/reorder"))] == [404, 404, 404, 404, 400, 400]
    assert call("POST", "/jobs/upload", {})[0] == 422 and call("POST", "/jobs/upload", {"filename": "a", "mode": "phone"})[0] == 422 and call("GET", "/other")[0] == 404 and call("DELETE", f"/jobs/{job}")[0] == 405
    assert call("POST", f"/jobs/{job}/pages/manual", {})[0] == 400


def test_stream_ties_late_state_and_windows(spark, tmp_path):
    """Ties go by event_id, idle jobs start anew, windowed counts appear once the watermark has passed."""
    schema = "job long, event_id long, ts timestamp, value double, rejected boolean"
    batches = [
        [(1, 2, "2024-01-01 00:00:00", 20.0, False), (1, 1, "2024-01-01 00:00:00", 10.0, True), (2, 3, "2024-01-01 00:00:00", 5.0, False)],
        [(2, 4, "2024-01-03 00:00:00", 6.0, False)],
        [(2, 5, "2024-01-05 00:00:00", 7.0, True)],
        [(1, 6, "2024-01-05 01:00:00", 30.0, False)],
    ]
    from datetime import datetime

    for b in batches:
        rows = [(j, e, datetime.fromisoformat(t), v, r) for j, e, t, v, r in b]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    import glob
    import os

    for i, f in enumerate(sorted(glob.glob(f"{tmp_path}/in/*.parquet"), key=os.path.getmtime)):
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    got = []
    stream = ingest.stream_events(spark, f"{tmp_path}/in", schema)
    ingest.run_once(ingest.stream_deltas(stream, 1.0, late="1 hour", idle=3_600_000), lambda df, n: got.extend(df.collect()), f"{tmp_path}/ck", "append")
    by = {(r.job, r.ts.day, r.value): (r.idx, r.change) for r in got}
    assert by[1, 1, 10.0] == (0, None) and by[1, 1, 20.0] == (1, 10.0)
    assert by[1, 5, 30.0] == (0, None)  # its state had gone
    counts = []
    ingest.run_once(ingest.windowed_counts(ingest.stream_events(spark, f"{tmp_path}/in", schema)), lambda df, n: counts.extend(df.select("window.start", "job", "n", "n_rejected").collect()), f"{tmp_path}/ck2", "append")
    assert {(r.start.day, r.job, r.n, r.n_rejected) for r in counts} == {(1, 1, 2, 1), (1, 2, 1, 0), (3, 2, 1, 0)}


def test_files_by_address(spark, tmp_path):
    """Paths and addresses name the same files; a file is replaced whole and nothing is left beside it."""
    from reelframe.sources import sinks

    for data in (b"one", b"two"):
        sinks.write_file(f"file://{tmp_path}/a/b.bin", data)
        assert (tmp_path / "a" / "b.bin").read_bytes() == data and [p.name for p in (tmp_path / "a").iterdir()] == ["b.bin"]
    sinks.write_file(f"{tmp_path}/a/b.bin", b"three")
    assert (tmp_path / "a" / "b.bin").read_bytes() == b"three"
    address = f"file://{tmp_path}/state/jobs.json"
    assert state_store.read_jobs(spark, address).count() == 0
    state_store.write_jobs([{"id": "j1", "mode": "camera"}], address)
    assert [(r.id, r.mode, r.status) for r in state_store.read_jobs(spark, address).collect()] == [("j1", "camera", "queued")]
