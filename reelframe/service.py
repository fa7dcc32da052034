"""Job service: the store of jobs and pages with its review operations.

State is small (jobs and page lists, no pixels): it lives in one JSON document, written atomically,
and is served as tables to the operators. A lock keeps writers of one process apart; every change of
a job raises its revision, and an export is published only if the revision is still the one exported.
"""

from __future__ import annotations

import os
import shutil
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import MODES, SAID
from .functions import document, images
from .operators.sampling import nearest_frame
from .operators.state import STAGES
from .sources.images import png, to_array
from .sources.sinks import write_file
from .sources.state_store import read_jobs

LABELS = {"sample": "Sample frames", "segment": "Find stable segments", "select": "Choose best frames", "dedupe": "Remove duplicates", "preview": "Write previews"}


class NotFound(KeyError):
    """No such job or page."""


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


class JobService:
    """``run(job, stage) -> pages`` reconstructs a job and calls ``stage(key)`` as each stage begins;
    ``export(job, pages, progress) -> url`` writes its file and may report percents. Without ``export`` an
    export fails: nothing is said to be ready that nobody wrote.
    """

    def __init__(self, spark: SparkSession, folder: str, run: Callable[[dict, Callable[[str], None]], list[dict]] | None = None, export: Callable[[dict, list[dict], Callable[[int], None]], str] | None = None, workers: int = 2):
        self.spark, self.folder, self._run, self._export = spark, folder, run, export
        self.path = f"{folder}/jobs_state.json"
        self._lock, self._pool = threading.RLock(), ThreadPoolExecutor(workers)
        self._jobs = {r.id: r.asDict(recursive=True) for r in read_jobs(spark, self.path).collect()}
        self.recover()

    # -- state

    def _save(self) -> None:
        from .sources.state_store import write_jobs

        write_jobs(list(self._jobs.values()), self.path)

    def _touch(self, job: dict) -> None:
        job["revision"] += 1
        job["updated_at"] = _now()

    def _reset_export(self, job: dict) -> None:
        job["export"] = {"status": "idle", "progress": 0, "filename": None, "url": None, "error": None}

    def _job(self, job_id: str) -> dict:
        if job_id not in self._jobs:
            raise NotFound(job_id)
        return self._jobs[job_id]

    def recover(self) -> None:
        """Fail what a restart interrupted."""
        with self._lock:
            for job in self._jobs.values():
                if job["status"] in ("queued", "processing"):
                    job |= {"status": "failed", "percent": 100, "message": SAID["restart"]}
                    job["notes"].append(SAID["restart_note"])
                    for s in job["stages"]:
                        s["status"] = "failed" if s["status"] == "processing" else s["status"]
                if (job["export"] or {}).get("status") == "processing":
                    job["export"] |= {"status": "failed", "error": SAID["export_restart"]}
            self._save()

    # -- jobs

    def create(self, filename: str, source: str | None = None, mode: str = "screen") -> dict:
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        job_id = uuid.uuid4().hex[:12]
        if source:
            os.makedirs(f"{self.folder}/uploads", exist_ok=True)
            shutil.copyfile(source, f"{self.folder}/uploads/{job_id}-{os.path.basename(filename)}")
        stages = [{"key": k, "label": LABELS[k], "status": "pending", "progress_percent": 0, "started_at": None, "completed_at": None} for k in STAGES]
        job = {"id": job_id, "filename": filename, "mode": mode, "status": "queued", "percent": 2, "message": "Queued", "created_at": _now(), "updated_at": _now(), "revision": 0, "notes": [], "stages": stages, "pages": []}
        self._reset_export(job)
        with self._lock:
            self._jobs[job_id] = job
            self._save()
        if self._run:
            self._pool.submit(self._process, job_id)
        return job

    def _process(self, job_id: str) -> None:
        try:
            with self._lock:
                self._job(job_id)["status"] = "processing"
                self.advance(job_id, STAGES[0])
            pages = self._run(self.get(job_id), lambda key: self.advance(job_id, key))
            with self._lock:
                job = self._job(job_id)
                for s in STAGES:
                    self.complete_stage(job_id, s)
                job |= {"status": "ready", "percent": 100, "message": f"{len(pages)} pages", "pages": pages}
                self._touch(job)
                self._save()
        except Exception as e:  # the job fails, the service goes on
            with self._lock:
                job = self._job(job_id)
                job |= {"status": "failed", "percent": 100, "message": str(e)[:500]}
                running = next((s for s in job["stages"] if s["status"] == "processing"), None)
                if running:
                    running["status"] = "failed"
                self._save()

    def advance(self, job_id: str, key: str) -> None:
        """Begin a stage; those before it are complete by then, and the job's percent follows."""
        at = STAGES.index(key)
        with self._lock:
            job = self._job(job_id)
            for s in job["stages"][:at]:
                if s["status"] != "complete":
                    self.complete_stage(job_id, s["key"])
            self.start_stage(job_id, key)
            job |= {"percent": max(job["percent"], 5 + 90 * at // len(STAGES)), "message": LABELS[key], "updated_at": _now()}
            self._save()

    def list(self) -> list[dict]:
        """Newest first."""
        return sorted(self._jobs.values(), key=lambda j: (j["created_at"], j["id"]), reverse=True)

    def get(self, job_id: str) -> dict:
        """The job with its pages in order."""
        job = self._job(job_id)
        return job | {"pages": sorted(job["pages"], key=lambda p: p["order_index"])}

    def table(self) -> DataFrame:
        """The stored jobs as a table."""
        return read_jobs(self.spark, self.path)

    def start_stage(self, job_id: str, key: str) -> None:
        with self._lock:
            for s in self._job(job_id)["stages"]:
                if s["key"] == key:
                    s |= {"status": "processing", "started_at": s["started_at"] or _now(), "progress_percent": max(s["progress_percent"], 5)}
                elif s["status"] not in ("complete", "failed"):
                    s |= {"status": "pending", "progress_percent": 0}
            self._save()

    def complete_stage(self, job_id: str, key: str) -> None:
        with self._lock:
            for s in self._job(job_id)["stages"]:
                if s["key"] == key:
                    s |= {"status": "complete", "progress_percent": 100, "completed_at": _now()}
            self._save()

    # -- review

    def update_pages(self, job_id: str, ids: list[str], rotation: int | None = None, deleted: bool | None = None) -> dict:
        """Patch all named pages, or none if any is unknown; resets the export."""
        with self._lock:
            job = self._job(job_id)
            pages = {p["id"]: p for p in job["pages"]}
            if unknown := [i for i in ids if i not in pages]:
                raise NotFound(unknown[0])
            for i in ids:
                if rotation is not None:
                    pages[i]["rotation"] = rotation % 360
                if deleted is not None:
                    pages[i] |= {"deleted": deleted, "status": "deleted" if deleted else "active"}
            self._reset_export(job)
            self._touch(job)
            self._save()
            return self.get(job_id)

    def reorder(self, job_id: str, ids: list[str]) -> dict:
        """New order of all pages; ValueError unless each is named exactly once."""
        with self._lock:
            job = self._job(job_id)
            if sorted(ids) != sorted(p["id"] for p in job["pages"]):
                raise ValueError("the order must name every page once")
            at = {i: n for n, i in enumerate(ids)}
            for p in job["pages"]:
                p["order_index"] = at[p["id"]]
            self._reset_export(job)
            self._touch(job)
            self._save()
            return self.get(job_id)

    def add_page(self, job_id: str, **fields) -> dict:
        """Append a manual page."""
        with self._lock:
            job = self._job(job_id)
            last = max((p["order_index"] for p in job["pages"]), default=-1)
            page = {"id": f"manual-{uuid.uuid4().hex[:8]}", "order_index": last + 1, "rotation": 0, "deleted": False, "manual": True, "status": "active", "image_path": None, "thumbnail_path": None, "segment_start": None, "segment_end": None}
            job["pages"].append(page | fields)
            self._reset_export(job)
            self._touch(job)
            self._save()
            return self.get(job_id)

    def add_page_at(self, job_id: str, seconds: float, frames: DataFrame) -> dict:
        """Append the frame of the recording nearest to a time (``frames`` as ``read_frames`` gives them) as a manual page.

        Camera frames are corrected and finished first. ValueError if the job has no frame.
        """
        job = self._job(job_id)
        own = frames.where(F.col("job") == job_id)
        wanted = self.spark.createDataFrame([(job_id, float(seconds))], "job string, wanted_t double")
        hit = nearest_frame(own.select("job", "idx", "t"), wanted).first()
        row = own.where(F.col("idx") == hit.idx).first() if hit else None
        if row is None:
            raise ValueError(SAID["no_manual"])
        image = to_array(row.height, row.width, row.data)
        if job["mode"] == "camera":
            image = document.finish(document.detect(image)["corrected"])
        page_id = f"manual-{uuid.uuid4().hex[:8]}"
        paths = [f"{self.folder}/jobs/{job_id}/{kind}/{page_id}.png" for kind in ("pages", "thumbnails")]
        for path, shown in zip(paths, (image, images.thumbnail(image))):
            write_file(path, png(shown))
        return self.add_page(job_id, id=page_id, image_path=paths[0], thumbnail_path=paths[1], segment_start=row.t, segment_end=row.t)

    # -- export

    def export(self, job_id: str) -> dict:
        """Start an export; a running one is left alone."""
        with self._lock:
            job = self._job(job_id)
            if job["export"]["status"] != "processing":
                job["export"] = {"status": "processing", "progress": 5, "filename": None, "url": None, "error": None}
                self._save()
                self._pool.submit(self._finish_export, job_id, job["revision"])
            return dict(job["export"])

    def _finish_export(self, job_id: str, revision: int) -> None:
        try:
            pages = [p for p in self.get(job_id)["pages"] if not p["deleted"]]
            if not pages:
                raise ValueError(SAID["no_pages"])
            if not self._export:
                raise ValueError("This service has no writer of export files.")
            self._export_progress(job_id, revision, 35)
            url = self._export(self.get(job_id), pages, lambda percent: self._export_progress(job_id, revision, percent))
            result = {"status": "ready", "progress": 100, "filename": f"{job_id}.pdf", "url": url, "error": None}
        except Exception as e:
            result = {"status": "failed", "progress": 0, "filename": None, "url": None, "error": str(e)[:500]}
        with self._lock:
            job = self._job(job_id)
            if job["revision"] == revision:  # else the pages changed meanwhile: the export stays reset
                job["export"] = result
                self._save()

    def _export_progress(self, job_id: str, revision: int, percent: int) -> None:
        with self._lock:
            job = self._job(job_id)
            if job["revision"] == revision and job["export"]["status"] == "processing":
                job["export"]["progress"] = max(job["export"]["progress"], min(int(percent), 99))
                self._save()

    def wait(self) -> None:
        """Until all work handed in so far has ended."""
        self._pool.shutdown(wait=True)
        self._pool = ThreadPoolExecutor(2)

    def active_pages(self, job_id: str) -> DataFrame:
        from .operators.state import active_pages
        from .sources.state_store import pages_of

        return active_pages(pages_of(self.table().where(F.col("id") == job_id)))
