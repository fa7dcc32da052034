"""Routes of the job service as plain functions: (method, path, body) in, (status, answer) out.

No web framework is needed: any server can hand its requests to ``handle``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from .config import SAID
from .service import JobService, NotFound

Answer = tuple[int, object]


def _patch(service: JobService, job: str, ids: list[str], body: dict, missing: str) -> Answer:
    try:
        return 200, service.update_pages(job, ids, body.get("rotation"), body.get("deleted"))
    except NotFound:
        return 404, {"detail": missing}


def handle(service: JobService, method: str, path: str, body: dict | None = None, frames_of: Callable[[dict], DataFrame] | None = None) -> Answer:
    """Answer of a request. ``frames_of(job)`` gives the recording that manual pages are taken from."""
    body, path = body or {}, path.rstrip("/")
    if (method, path) == ("GET", "/health"):
        return 200, {"status": "ok"}
    if (method, path) == ("GET", "/jobs"):
        return 200, service.list()
    if (method, path) == ("POST", "/jobs/upload"):
        if not body.get("filename"):
            return 422, {"detail": "filename is required"}
        try:
            return 200, service.create(body["filename"], body.get("source"), body.get("mode", "screen"))
        except ValueError as e:
            return 422, {"detail": str(e)}
    found = re.fullmatch(r"/jobs/([^/]+)(?:/(export|pages|pages/manual|pages/reorder|pages/([^/]+)))?", path)
    if not found:
        return 404, {"detail": "Not Found"}
    job, rest, page = found[1], found[2], found[3]
    try:
        service.get(job)
    except NotFound:
        if rest == "pages/manual":
            return 400, {"detail": SAID["no_manual"]}
        if rest == "pages/reorder":
            return 400, {"detail": SAID["bad_order"]}
        return 404, {"detail": SAID["no_page"] if page else SAID["no_pages_named"] if rest == "pages" else SAID["no_job"]}
    if (method, rest) == ("GET", None):
        return 200, service.get(job)
    if (method, rest) == ("POST", "export"):
        return 200, service.export(job)
    if (method, rest) == ("PATCH", "pages"):
        return _patch(service, job, body.get("page_ids", []), body, SAID["no_pages_named"])
    if (method, rest) == ("POST", "pages/reorder"):
        try:
            return 200, service.reorder(job, body.get("page_ids", []))
        except ValueError:
            return 400, {"detail": SAID["bad_order"]}
    if (method, rest) == ("POST", "pages/manual"):
        try:
            return 200, service.add_page_at(job, float(body["timestamp"]), frames_of(service.get(job)))
        except (ValueError, KeyError, TypeError):
            return 400, {"detail": SAID["no_manual"]}
    if method == "PATCH" and page:
        return _patch(service, job, [page], body, SAID["no_page"])
    return 405, {"detail": "Method Not Allowed"}
