"""Job and page state as table-to-table transforms.

Jobs have job, status, created_at, export_status; pages have job, id, order_index, rotation, deleted.
Every transform returns a new table; nothing is read on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SAID

#: Stages of a job, in order.
STAGES = ("sample", "segment", "select", "dedupe", "preview")


def page_status(deleted: Column) -> Column:
    return F.when(deleted, "deleted").otherwise("active")


def active_pages(pages: DataFrame) -> DataFrame:
    """Pages that are not deleted, with a dense page_number by order_index."""
    n = F.row_number().over(Window.partitionBy("job").orderBy("order_index", "id")).cast("long")
    return pages.where(~F.col("deleted")).withColumn("page_number", n)


def update_pages(pages: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply one patch (job, id, rotation, deleted) a page; null fields change nothing.

    Adds ``touched``, which says that the job's export is to be reset.
    """
    p = patches.select("job", "id", F.col("rotation").alias("_rotation"), F.col("deleted").alias("_deleted"), F.lit(True).alias("_hit"))
    out = pages.join(p, ["job", "id"], "left")
    hit = F.max(F.coalesce(F.col("_hit").cast("int"), F.lit(0))).over(Window.partitionBy("job")) == 1
    return out.withColumns({
        "rotation": F.when(F.col("_rotation").isNull(), F.col("rotation")).otherwise(F.pmod("_rotation", F.lit(360))),
        "deleted": F.coalesce("_deleted", "deleted"), "touched": hit,
    }).drop("_rotation", "_deleted", "_hit")


def bulk_update(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Apply requests (job, ids, rotation, deleted), one a job, each wholly or, if any id is unknown, not at all."""
    asked = requests.select("job", F.explode(F.array_distinct("ids")).alias("id"), "rotation", "deleted")
    known = pages.select("job", "id", F.lit(1).alias("_known"))
    bad = asked.join(known, ["job", "id"], "left").groupBy("job").agg((F.count("*") > F.count("_known")).alias("bad")).where("bad").select("job")
    return update_pages(pages, asked.join(bad, "job", "left_anti"))


def reorder_pages(pages: DataFrame, orders: DataFrame) -> DataFrame:
    """Renumber jobs by orders (job, ids); an order must name every page of its job exactly once.

    Adds ``applied``. A list with a repeated id is refused, like one with a missing or unknown id.
    """
    have = pages.groupBy("job").agg(F.array_sort(F.collect_list("id")).alias("have"))
    good = orders.join(have, "job").where(F.array_sort("ids") == F.col("have"))
    place = good.select("job", F.posexplode("ids").alias("_at", "id"))
    out = pages.join(place, ["job", "id"], "left")
    return out.withColumn("applied", F.col("_at").isNotNull()).withColumn("order_index", F.coalesce(F.col("_at").cast("long"), "order_index")).drop("_at")


def page_order(pages: DataFrame) -> DataFrame:
    """Adds ``place``: the whole order that a review sends, active pages first, then the deleted ones, each by order_index."""
    w = Window.partitionBy("job").orderBy("deleted", "order_index", "id")
    return pages.withColumn("place", (F.row_number().over(w) - 1).cast("long"))


def move_pages(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """Orders after one move a job (job, id, to): the page is taken out of the active ones and put in at place ``to``.

    A place before the first or behind the last is the first or the last; an unknown or deleted page moves
    nothing. A shift by one is a move to its place plus or minus one. Deleted pages stay behind the active ones.
    """
    m = moves.select("job", F.col("id").alias("_id"), F.col("to").cast("long").alias("_to"))
    out = page_order(pages).join(m, "job", "left")
    job = Window.partitionBy("job")
    at = F.max(F.when((F.col("id") == F.col("_id")) & ~F.col("deleted"), F.col("place"))).over(job)
    out = out.withColumns({"_at": at, "_last": F.count_if(~F.col("deleted")).over(job) - 1})
    to = F.least(F.greatest("_to", F.lit(0)), F.col("_last"))
    own = (F.col("id") == F.col("_id")) & F.col("_at").isNotNull()
    # pages between the old and the new place close up by one
    moved = F.when(own, to).when((F.col("place") > F.col("_at")) & (F.col("place") <= to), F.col("place") - 1).when((F.col("place") < F.col("_at")) & (F.col("place") >= to), F.col("place") + 1)
    return out.withColumn("place", F.when(F.col("deleted") | F.col("_at").isNull(), F.col("place")).otherwise(F.coalesce(moved, F.col("place")))).drop("_id", "_to", "_at", "_last")


def append_page(pages: DataFrame, new: DataFrame) -> DataFrame:
    """Add manual pages (job, id): last in their job, unrotated, active."""
    last = pages.groupBy("job").agg(F.max("order_index").alias("_last"))
    n = F.row_number().over(Window.partitionBy("job").orderBy("id"))
    rows = new.join(last, "job", "left").select("job", "id", (F.coalesce("_last", F.lit(-1)) + n).cast("long").alias("order_index"), F.lit(0).cast("long").alias("rotation"), F.lit(False).alias("deleted"))
    return pages.select("job", "id", "order_index", "rotation", "deleted").unionByName(rows)


def upsert_jobs(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace jobs present in ``updates``, add the new ones; both have the same columns."""
    both = jobs.withColumn("_v", F.lit(0)).unionByName(updates.withColumn("_v", F.lit(1)))
    top = F.row_number().over(Window.partitionBy("job").orderBy(F.desc("_v")))
    return both.withColumn("_top", top).where("_top = 1").drop("_v", "_top")


def recover_jobs(jobs: DataFrame) -> DataFrame:
    """Fail what a restart interrupted: queued or running jobs, running exports."""
    stopped = F.col("status").isin("queued", "processing")
    exporting = F.col("export_status") == "processing"
    return jobs.withColumns({
        "status": F.when(stopped, "failed").otherwise(F.col("status")), "export_status": F.when(exporting, "failed").otherwise(F.col("export_status")),
        "export_error": F.when(exporting, SAID["export_restart"]), "message": F.when(stopped, SAID["restart"]),
    })


def export_jobs(jobs: DataFrame, active: DataFrame) -> DataFrame:
    """Start exports: running ones stay, jobs without an active page fail, others run at 5 percent."""
    n = active.groupBy("job").agg(F.count("*").alias("_n"))
    out = jobs.join(n, "job", "left")
    empty = F.coalesce("_n", F.lit(0)) == 0
    return out.withColumns({
        "export_status": F.when(empty, "failed").otherwise("processing"), "export_error": F.when(empty, SAID["no_pages"]),
        "export_progress": F.when(empty, 0).when(F.col("export_status") == "processing", F.col("export_progress")).otherwise(5),
    }).drop("_n")


def finish_exports(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Publish finished exports (job, revision, url) of jobs whose revision is still the one exported."""
    d = done.select("job", F.col("revision").alias("_rev"), F.col("url").alias("_url"))
    out = jobs.join(d, "job", "left")
    ok = F.coalesce(F.col("_rev") == F.col("revision"), F.lit(False))
    return out.withColumns({"export_status": F.when(ok, "ready").otherwise(F.col("export_status")), "export_url": F.when(ok, F.col("_url")).otherwise(F.col("export_url"))}).drop("_rev", "_url")


def fail_stages(stages: DataFrame) -> DataFrame:
    """Fail the first running stage of each job in (job, key, place, status)."""
    first = F.min(F.when(F.col("status") == "processing", F.col("place"))).over(Window.partitionBy("job"))
    return stages.withColumn("_first", first).withColumn("status", F.when(F.col("place") == F.col("_first"), "failed").otherwise(F.col("status"))).drop("_first")


def stage_states(events: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """State of every stage after a job's events (job, at, seq, stage, kind 'start' or 'complete').

    A start runs its stage (first start time kept, progress at least 5) and sets every stage that is
    neither complete nor failed back to pending; a completion ends its stage. A fold in event order
    over a job's few events.
    """
    item = F.struct("at", "seq", "stage", "kind")
    listed = events.groupBy("job").agg(F.array_sort(F.collect_list(item)).alias("events"))
    kind = "array<struct<key: string, status: string, progress: bigint, started: double, completed: double>>"
    none = F.lit(None).cast("double")
    state = lambda k, s, p, a, c: F.struct(k.alias("key"), s.alias("status"), p.alias("progress"), a.alias("started"), c.alias("completed"))
    start = F.array(*[state(F.lit(s), F.lit("pending"), F.lit(0).cast("long"), none, none) for s in stages]).cast(kind)

    def step(all_: Column, e: Column) -> Column:
        def one(s: Column) -> Column:
            own, starts = s["key"] == e["stage"], e["kind"] == "start"
            return (
                F.when(own & starts, state(s["key"], F.lit("processing"), F.greatest(s["progress"], F.lit(5).cast("long")), F.coalesce(s["started"], e["at"]), s["completed"]))
                .when(own, state(s["key"], F.lit("complete"), F.lit(100).cast("long"), s["started"], e["at"]))
                .when(starts & ~s["status"].isin("complete", "failed"), state(s["key"], F.lit("pending"), F.lit(0).cast("long"), s["started"], s["completed"]))
                .otherwise(s)
            )

        return F.transform(all_, one)

    return listed.select("job", F.posexplode(F.aggregate("events", start, step)).alias("place", "s")).select("job", F.col("place").cast("long").alias("place"), "s.*")


def job_documents(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Jobs with their pages nested in order, as the service shows them."""
    page = F.struct("order_index", F.col("id").alias("id"), "rotation", "deleted", page_status(F.col("deleted")).alias("status"))
    nested = pages.groupBy("job").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    return jobs.join(nested, "job", "left").withColumn("pages", F.coalesce("pages", F.array().cast(nested.schema["pages"].dataType)))
