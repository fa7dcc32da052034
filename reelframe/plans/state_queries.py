"""State and report queries over orders and line items, conversations, pages and benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import artifact_path, artifact_url, resolve_url
from ..operators import report, state
from .views import table

STATUS = {"O": "queued", "P": "processing", "F": "ready"}


def jobs(spark, sf_dir) -> DataFrame:
    s = F.coalesce(*[F.when(F.col("o_orderstatus") == k, v) for k, v in STATUS.items()], F.lit("failed"))
    export = F.when(F.col("o_orderkey") % 4 == 0, "processing").when(F.col("o_orderkey") % 4 == 1, "ready").otherwise("idle")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), s.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"), export.alias("export_status"))


def job_pages(spark, sf_dir) -> DataFrame:
    """Line items as pages; a line number that repeats within an order is numbered on."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.col("l_orderkey").alias("job"), F.col("l_linenumber").cast("long").alias("id"))
    p = g.agg(F.max("l_returnflag").alias("flag"), F.max("l_quantity").cast("long").alias("q"))
    return p.select("job", "id", (F.col("id") - 1).alias("order_index"), F.pmod(F.col("q") * 90, F.lit(360)).alias("rotation"), (F.col("flag") == "R").alias("deleted"), (F.col("flag") == "A").alias("manual"))


_JOBS = f"""j AS (SELECT o_orderkey AS job, CASE o_orderstatus {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items())} ELSE 'failed' END AS status, o_orderdate AS created_at,
  CASE o_orderkey % 4 WHEN 0 THEN 'processing' WHEN 1 THEN 'ready' ELSE 'idle' END AS export_status FROM orders)"""
_PAGES = """p0 AS (SELECT l_orderkey AS job, CAST(l_linenumber AS BIGINT) AS id, max(l_returnflag) AS flag, CAST(trunc(max(l_quantity)) AS BIGINT) AS q FROM lineitem GROUP BY ALL),
p AS (SELECT job, id, id - 1 AS order_index, q * 90 % 360 AS rotation, flag = 'R' AS deleted, flag = 'A' AS manual FROM p0)"""


def job_document(spark, sf_dir):
    d = state.job_documents(jobs(spark, sf_dir), job_pages(spark, sf_dir))
    shown = F.transform("pages", lambda p: F.concat_ws(":", p["id"].cast("string"), p["rotation"].cast("string"), p["status"]))
    return d.select("job", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.size("pages").cast("long").alias("n_pages"), F.array_join(shown, ",").alias("pages"))


def active_pages(spark, sf_dir):
    return state.active_pages(job_pages(spark, sf_dir)).select("job", "id", "page_number", "rotation")


def page_update(spark, sf_dir):
    p = job_pages(spark, sf_dir)
    turn = F.when(F.col("job") % 2 == 0, F.col("rotation") - 450)
    patch = p.where((F.col("job") + F.col("id")) % 5 == 0).select("job", "id", turn.alias("rotation"), F.when(F.col("job") % 3 == 0, ~F.col("deleted")).alias("deleted"))
    return state.update_pages(p, patch).select("job", "id", "rotation", "deleted", "touched")


def bulk_update(spark, sf_dir):
    p = job_pages(spark, sf_dir)
    ids = F.when(F.col("job") % 3 == 1, F.array(F.lit(1), F.lit(99))).otherwise(F.array(F.lit(1), F.lit(1))).cast("array<bigint>")
    asked = p.select("job").distinct().where(F.col("job") % 3 < 2).select("job", ids.alias("ids"), F.lit(-90).cast("long").alias("rotation"), F.lit(True).alias("deleted"))
    return state.bulk_update(p, asked).select("job", "id", "rotation", "deleted", "touched")


def _turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job"), F.col("turn").alias("id"), F.col("turn").alias("order_index"))


def page_reorder(spark, sf_dir):
    t = _turns(spark, sf_dir)
    back = F.sort_array(F.collect_list("id"), asc=False)
    order = t.groupBy("job").agg(back.alias("ids")).withColumn("ids", F.when(F.col("job") % 4 == 0, F.concat(F.slice("ids", 1, 1), F.slice("ids", 1, F.size("ids") - 1))).otherwise(F.col("ids")))
    return state.reorder_pages(t, order).select("job", "id", "order_index", "applied")


def upsert_jobs(spark, sf_dir):
    j = jobs(spark, sf_dir).select("job", "status", "export_status")
    changed = j.where(F.col("job") % 10 == 0).withColumn("status", F.lit("failed"))
    new = j.where(F.col("job") % 50 == 1).withColumn("job", -F.col("job")).withColumn("status", F.lit("queued"))
    return state.upsert_jobs(j, changed.unionByName(new))


def stage_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stage = F.element_at(F.array(*map(F.lit, state.STAGES)), (F.col("event_id") % 5 + 1).cast("int"))
    kind = F.when(F.col("event_id") % 3 == 0, "complete").otherwise("start")
    log = e.select(F.col("user_id").alias("job"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("seq"), stage.alias("stage"), kind.alias("kind"))
    zero = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 3).alias(c)
    return state.stage_states(log).select("job", "place", F.col("key").alias("stage"), "status", "progress", zero("started"), zero("completed"))


def recover_jobs(spark, sf_dir):
    r = state.recover_jobs(jobs(spark, sf_dir))
    return r.select("job", "status", "export_status", F.coalesce("export_error", F.lit("")).alias("export_error"), F.coalesce("message", F.lit("")).alias("message"))


def export_jobs(spark, sf_dir):
    j = jobs(spark, sf_dir).withColumn("export_progress", F.when(F.col("export_status") == "processing", 35).otherwise(0))
    x = state.export_jobs(j, state.active_pages(job_pages(spark, sf_dir)))
    return x.select("job", "export_status", F.coalesce("export_error", F.lit("")).alias("export_error"), F.col("export_progress").cast("long").alias("export_progress"))


def workspace_stats(spark, sf_dir):
    return report.workspace_stats(jobs(spark, sf_dir), job_pages(spark, sf_dir))


def _cases(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    b = table(spark, sf_dir, "benchmark")
    name = F.concat(F.lit("case-"), F.col("item_id"))
    cases = b.select(name.alias("name"), (F.col("item_id") % 3).alias("min_pages"), F.when(F.col("item_id") % 6 > 0, 3 + F.col("item_id") % 5).alias("max_pages"), (F.col("item_id") % 2).alias("max_weak"))
    results = b.where(F.col("item_id") % 11 != 0).select(name.alias("name"), (F.length("text") % 9).cast("long").alias("pages"), (F.length("text") % 3).cast("long").alias("weak"))
    return cases, results


def benchmark_eval(spark, sf_dir):
    return report.evaluate_cases(*_cases(spark, sf_dir))


def benchmark_summary(spark, sf_dir):
    return report.summarize(benchmark_eval(spark, sf_dir))


def page_order(spark, sf_dir):
    return state.page_order(job_pages(spark, sf_dir)).select("job", "id", "place", "deleted")


def page_move(spark, sf_dir):
    """The first active page shifts by one, jumps to the end or, in every third job, an unknown page is named."""
    p = job_pages(spark, sf_dir)
    k = F.col("job") % 3
    first = p.where("not deleted").groupBy("job").agg(F.min("id").alias("id"))
    moves = first.select("job", F.when(k == 2, 99).otherwise(F.col("id")).alias("id"), F.when(k == 0, 1).otherwise(50).alias("to"))
    return state.move_pages(p, moves).select("job", "id", "place")


def job_counters(spark, sf_dir):
    return report.job_counters(job_pages(spark, sf_dir))


def _urls(spark, sf_dir) -> DataFrame:
    k, tail = F.col("page_id") % 5, F.regexp_replace("url", "^https?://", "")
    url = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("/artifacts/"), tail)).when(k == 2, F.concat(F.lit("artifacts/"), tail)).when(k == 3, F.lit("")).otherwise(tail)
    return table(spark, sf_dir, "pages").select("page_id", url.alias("u"))


def resolve(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", F.coalesce(resolve_url(F.col("u"), "http://api", "http://api/artifacts"), F.lit("-")).alias("resolved"))


def paths(spark, sf_dir):
    p = _urls(spark, sf_dir).withColumn("path", artifact_path(F.col("u"), "/data/storage"))
    return p.select("page_id", F.coalesce("path", F.lit("-")).alias("path"), F.coalesce(artifact_url(F.col("path"), "/data/storage"), F.lit("-")).alias("back"))


def jobs_recent(spark, sf_dir):
    """Jobs, newest first, with their place in that order."""
    w = Window.partitionBy("status").orderBy(F.desc("created_at"), "job")
    return jobs(spark, sf_dir).select("job", "status", F.row_number().over(w).cast("long").alias("place"))


def export_rows(spark, sf_dir):
    p = job_pages(spark, sf_dir).withColumn("image_path", F.format_string("/data/%d/%d.png", "job", "id"))
    return report.export_rows(p).select("job", "id", "rotation", "image_path", "page_coverage", "gutter_ratio", "phash", "rejected")


QUERIES = {
    "jobs_recent": jobs_recent, "export_rows": export_rows,
    "job_document": job_document, "active_pages": active_pages, "page_update": page_update, "bulk_update": bulk_update, "page_reorder": page_reorder, "upsert_jobs": upsert_jobs,
    "page_order": page_order, "page_move": page_move, "job_counters": job_counters, "stage_state": stage_state, "recover_jobs": recover_jobs, "export_jobs": export_jobs, "workspace_stats": workspace_stats, "benchmark_eval": benchmark_eval,
    "benchmark_summary": benchmark_summary, "resolve_url": resolve, "artifact_paths": paths,
}

_U = """u AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS tail, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '/artifacts/' || regexp_replace(url, '^https?://', '')
  WHEN 2 THEN 'artifacts/' || regexp_replace(url, '^https?://', '') WHEN 3 THEN '' ELSE regexp_replace(url, '^https?://', '') END AS u FROM pages)"""
_EVAL = """c AS (SELECT 'case-' || item_id AS name, item_id % 3 AS mn, CASE WHEN item_id % 6 > 0 THEN 3 + item_id % 5 END AS mx, item_id % 2 AS mw,
  CASE WHEN item_id % 11 <> 0 THEN length(text) % 9 END AS pages, CASE WHEN item_id % 11 <> 0 THEN length(text) % 3 END AS weak FROM benchmark),
x AS (SELECT *, list_filter([CASE WHEN pages < mn THEN 'pages ' || pages || ' < min ' || mn END, CASE WHEN pages > mx THEN 'pages ' || pages || ' > max ' || mx END, CASE WHEN weak > mw THEN 'weak_pages ' || weak || ' > max ' || mw END], lambda y: y IS NOT NULL) AS fails FROM c),
v AS (SELECT name, pages IS NULL AS skipped, pages IS NOT NULL AND len(fails) = 0 AS passed, CASE WHEN pages IS NULL THEN 'skipped' ELSE 'pages=' || pages || ' weak_pages=' || weak || CASE WHEN len(fails) > 0 THEN ' failures=' || array_to_string(fails, ', ') ELSE '' END END AS detail FROM x)"""
_S = ", ".join(f"{{'key': '{s}', 'status': 'pending', 'progress': 0::BIGINT, 'started': NULL::DOUBLE, 'completed': NULL::DOUBLE}}" for s in state.STAGES)
_NEXT = """list_transform(st, lambda s: CASE
  WHEN s.key = e.stage AND e.kind = 'start' THEN {'key': s.key, 'status': 'processing', 'progress': greatest(s.progress, 5), 'started': coalesce(s.started, e.at_s), 'completed': s.completed}
  WHEN s.key = e.stage THEN {'key': s.key, 'status': 'complete', 'progress': 100::BIGINT, 'started': s.started, 'completed': e.at_s}
  WHEN e.kind = 'start' AND s.status NOT IN ('complete', 'failed') THEN {'key': s.key, 'status': 'pending', 'progress': 0::BIGINT, 'started': s.started, 'completed': s.completed} ELSE s END)"""
_TOUCH = "bool_or(hit) OVER (PARTITION BY p.job)"
ORACLE_SQL = {
    "jobs_recent": f"WITH {_JOBS} SELECT job, status, row_number() OVER (PARTITION BY status ORDER BY created_at DESC, job) AS place FROM j",
    "export_rows": f"WITH {_PAGES} SELECT job, id, rotation, '/data/' || job || '/' || id || '.png' AS image_path, 1.0::DOUBLE AS page_coverage, 0.0::DOUBLE AS gutter_ratio, '0' AS phash, false AS rejected FROM p WHERE NOT deleted",
    "job_document": f"""WITH {_JOBS}, {_PAGES}, n AS (SELECT job, count(*) AS n, string_agg(id || ':' || rotation || ':' || CASE WHEN deleted THEN 'deleted' ELSE 'active' END, ',' ORDER BY order_index) AS pages FROM p GROUP BY job)
SELECT j.job, status, strftime(created_at, '%Y-%m-%d') AS created, coalesce(n.n, 0) AS n_pages, coalesce(n.pages, '') AS pages FROM j LEFT JOIN n USING (job)""",
    "active_pages": f"WITH {_PAGES} SELECT job, id, row_number() OVER (PARTITION BY job ORDER BY order_index, id) AS page_number, rotation FROM p WHERE NOT deleted",
    "page_update": f"""WITH {_PAGES}, q AS (SELECT *, (job + id) % 5 = 0 AS hit FROM p)
SELECT job, id, CASE WHEN hit AND job % 2 = 0 THEN (rotation - 450 + 720) % 360 ELSE rotation END AS rotation, CASE WHEN hit AND job % 3 = 0 THEN NOT deleted ELSE deleted END AS deleted, bool_or(hit) OVER (PARTITION BY job) AS touched FROM q""",
    "bulk_update": f"""WITH {_PAGES}, q AS (SELECT *, job % 3 = 0 AND id = 1 AND bool_or(id = 1) OVER (PARTITION BY job) AS hit FROM p)
SELECT job, id, CASE WHEN hit THEN 270 ELSE rotation END AS rotation, hit OR deleted AS deleted, bool_or(hit) OVER (PARTITION BY job) AS touched FROM q""",
    "page_reorder": """WITH t AS (SELECT conv_id AS job, turn AS id, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS place FROM conversations)
SELECT job, id, CASE WHEN job % 4 <> 0 OR n < 1 THEN place ELSE id END AS order_index, job % 4 <> 0 AS applied FROM t""",
    "page_order": f"WITH {_PAGES} SELECT job, id, row_number() OVER (PARTITION BY job ORDER BY deleted, order_index, id) - 1 AS place, deleted FROM p",
    "page_move": f"""WITH {_PAGES}, o AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY deleted, order_index, id) - 1 AS at_, count(*) FILTER (NOT deleted) OVER (PARTITION BY job) AS n FROM p),
k AS (SELECT *, CASE WHEN deleted THEN at_ + 1000 WHEN at_ = 0 AND job % 3 = 0 THEN 1.5 WHEN at_ = 0 AND job % 3 = 1 THEN 500 ELSE at_ END AS key FROM o)
SELECT job, id, row_number() OVER (PARTITION BY job ORDER BY key) - 1 AS place FROM k""",
    "job_counters": f"WITH {_PAGES} SELECT job, count(*) FILTER (NOT deleted) AS active_pages, count(*) FILTER (deleted) AS deleted_pages, count(*) FILTER (manual) AS manual_pages, count(*) FILTER (rotation <> 0) AS rotated_pages FROM p GROUP BY job",
    "upsert_jobs": f"""WITH {_JOBS} SELECT job, CASE WHEN job % 10 = 0 THEN 'failed' ELSE status END AS status, export_status FROM j UNION ALL SELECT -job, 'queued', export_status FROM j WHERE job % 50 = 1""",
    "stage_state": f"""WITH RECURSIVE e AS (SELECT user_id AS job, epoch_us(ts) / 1e6 AS at_s, ['sample', 'segment', 'select', 'dedupe', 'preview'][event_id % 5 + 1] AS stage,
  CASE WHEN event_id % 3 = 0 THEN 'complete' ELSE 'start' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
w AS (SELECT job, 0::BIGINT AS rn, any_value(n) AS n, [{_S}] AS st FROM e GROUP BY job UNION ALL SELECT w.job, e.rn, w.n, {_NEXT} FROM w JOIN e ON e.job = w.job AND e.rn = w.rn + 1),
l AS (SELECT job, unnest(range(0, 5)) AS place, st FROM w WHERE rn = n)
SELECT job, place, st[place + 1].key AS stage, st[place + 1].status AS status, st[place + 1].progress AS progress, round(coalesce(st[place + 1].started, 0), 3) AS started, round(coalesce(st[place + 1].completed, 0), 3) AS completed FROM l""",
    "recover_jobs": f"""WITH {_JOBS} SELECT job, CASE WHEN status IN ('queued', 'processing') THEN 'failed' ELSE status END AS status, CASE WHEN export_status = 'processing' THEN 'failed' ELSE export_status END AS export_status,
  CASE WHEN export_status = 'processing' THEN 'Export interrupted by server restart.' ELSE '' END AS export_error, CASE WHEN status IN ('queued', 'processing') THEN 'Processing interrupted by server restart.' ELSE '' END AS message FROM j""",
    "export_jobs": f"""WITH {_JOBS}, {_PAGES}, a AS (SELECT DISTINCT job FROM p WHERE NOT deleted)
SELECT j.job, CASE WHEN a.job IS NULL THEN 'failed' ELSE 'processing' END AS export_status, CASE WHEN a.job IS NULL THEN 'No active pages available for export.' ELSE '' END AS export_error,
  CAST(CASE WHEN a.job IS NULL THEN 0 WHEN export_status = 'processing' THEN 35 ELSE 5 END AS BIGINT) AS export_progress FROM j LEFT JOIN a ON a.job = j.job""",
    "workspace_stats": f"""WITH {_JOBS}, {_PAGES} SELECT (SELECT count(*) FROM j) AS sessions, (SELECT count(*) FROM j WHERE status = 'ready') AS ready_jobs,
  count(*) FILTER (NOT deleted) AS visible_pages, count(*) FILTER (deleted) AS deleted_pages, count(*) FILTER (manual) AS manual_pages FROM p""",
    "benchmark_eval": f"WITH {_EVAL} SELECT * FROM v",
    "benchmark_summary": f"WITH {_EVAL} SELECT count(*) AS cases, count(*) FILTER (NOT skipped) AS executed, count(*) FILTER (passed AND NOT skipped) AS passed FROM v",
    "resolve_url": f"""WITH {_U} SELECT page_id, CASE page_id % 5 WHEN 0 THEN u WHEN 1 THEN 'http://api/artifacts/' || tail WHEN 2 THEN 'http://api/artifacts/' || tail WHEN 3 THEN '-' ELSE tail END AS resolved FROM u""",
    "artifact_paths": f"""WITH {_U} SELECT page_id, CASE WHEN page_id % 5 = 1 THEN '/data/storage/' || tail ELSE '-' END AS path, CASE WHEN page_id % 5 = 1 THEN u ELSE '-' END AS back FROM u""",
}
