"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised text (``repartitionByRange`` over a byte prefix and
a hash of the rest, so that splitters stay short), an external sort within each partition places
equal texts next to each other, and one pass compares every text with
its neighbour in full. The identifier and the row's position are the last splitters, so a group of
copies of any size, equal or null identifiers included, is spread over as many partitions as it needs.
Runs are cut after CHUNK rows; those that touch a cut or a partition's edge are closed by a second,
small aggregation over at most two rows a partition and one for each CHUNK rows, keyed by the full text.

Defined results for odd input: null text counts as empty; texts of any length are compared whole; null
identifiers sort first (they stay only where no other row of the group has one, and ``keep_id`` is then
null); of rows with equal text and identifier one stays; an empty table gives an empty result; other
columns are carried untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_small, nest, shared

#: Rows of a run that a task holds (their identifiers) before it cuts the run.
CHUNK = 100_000


@F.arrow_udf(T.StringType())
def _ascii_lower(text: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(text, ""))


def normalised(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return _ascii_lower(text)


def _runs(largest: bool, carry: bool, schema: pa.Schema):
    """Neighbour comparison over one sorted partition.

    Emits the survivor of each run (``carry``: with its whole row) or else every row, with the run's
    surviving id and size and, for the first and the last run of the partition and the parts of one
    that was cut, an edge number; the last row of an edge run also has the text. Of a run only the ids
    and one row are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        text: bytes | None = None
        ids: list[int | None] = []
        row: pa.Array | None = None
        first, cut, edges = True, False, 0
        out: dict[str, list] = {f.name: [] for f in schema if f.name != "row"}
        rows: list[pa.Array] = []

        def close(last: bool, more: bool = False) -> None:
            nonlocal first, cut, edges
            # sorted ascending, nulls first: the survivor is the last row, or the first that has an id
            nulls = next((i for i, x in enumerate(ids) if x is not None), len(ids))
            at = len(ids) - 1 if largest or nulls == len(ids) else nulls
            edge = (part << 32) + edges if first or last or cut or more else None
            shown = [ids[at]] if carry else ids
            n = len(shown)
            out["id"] += shown
            out["keep_id"] += [ids[at]] * n
            out["group_size"] += [len(ids)] * n
            out["stays"] += [True] if carry else [i == at for i in range(n)]
            out["sha256"] += [hashlib.sha256(text).hexdigest()] * n
            out["edge"] += [edge] * n
            out["edge_text"] += [None] * (n - 1) + [text.decode() if edge is not None else None]
            if carry:
                rows.append(row)
            first, cut, edges = False, more, edges + (edge is not None)

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(v, schema.field(k).type) for k, v in out.items()]
            if carry:
                arrays.append(pa.concat_arrays(rows))
            batch = pa.RecordBatch.from_arrays(arrays, names=[*out, *["row"] * carry])
            for v in (*out.values(), rows):
                v.clear()
            return batch

        for batch in batches:
            texts = batch.column("norm").cast(pa.large_binary())
            keys = batch.column("id").to_pylist()
            whole = batch.column("row") if carry else None
            for i, t in enumerate(texts):
                t = t.as_py()
                if t != text:
                    if ids:
                        close(False)
                    text, ids, row = t, [], None
                elif len(ids) >= CHUNK:
                    close(False, more=True)
                    ids, row = [], None
                ids.append(keys[i])
                if carry and (largest or row is None or (keys[i] is not None and ids[-2:-1] == [None])):
                    row = whole.slice(i, 1)
            if row is not None:
                row = pa.concat_arrays([row])  # lets the batch go
            if out["id"]:
                yield flush()
        if ids:
            close(True)
            yield flush()

    return run


def exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "max", carry: bool = False) -> DataFrame:
    """Group rows with equal normalised text.

    Returns a row per document: id, keep_id, group_size, kept, sha256; with ``carry`` only survivors
    of runs, with their whole row as struct ``row``.
    ``keep``: 'min' (smallest identifier stays) or 'max'.
    """
    cols = [F.col(f"`{id_col}`").cast("long").alias("id"), normalised(F.col(f"`{text_col}`")).alias("norm")]
    if carry:
        cols.append(nest(docs).alias("row"))
    # The splitters are short: a prefix of the bytes, then a hash of all of them, then the identifier.
    place = [F.substring("norm", 1, 64), F.xxhash64("norm")]
    ordered = docs.select(*cols).withColumns({"prefix": place[0], "hash": place[1]})
    ordered = ordered.withColumn("at", F.monotonically_increasing_id()).repartitionByRange("prefix", "hash", "id", "at").drop("at").sortWithinPartitions("prefix", "hash", "norm", "id").drop("prefix", "hash")
    fields = [("id", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("stays", pa.bool_()), ("sha256", pa.string()), ("edge", pa.int64()), ("edge_text", pa.string())]
    sql = "id long, keep_id long, group_size long, stays boolean, sha256 string, edge long, edge_text string"
    schema = T._parse_datatype_string(sql)
    if carry:
        schema = schema.add("row", ordered.schema["row"].dataType)
        fields.append(("row", pa.null()))
    runs = shared(ordered.mapInArrow(_runs(keep == "max", carry, pa.schema(fields)), schema), "exact-runs")

    # Which of the edge runs are the same text?
    best = F.max if keep == "max" else F.min
    size = runs.where("edge is not null").groupBy("edge").agg(F.max("edge_text").alias("edge_text"), F.max("group_size").alias("n"), best("keep_id").alias("k"))
    groups = size.groupBy("edge_text").agg(F.sum("n").alias("total"), best("k").alias("all_keep"), F.collect_list(F.struct("edge", "k")).alias("members"))
    # the survivor's run: the first edge that holds the surviving id (nulls: the last edge)
    owner = F.coalesce(
        F.array_min(F.transform(F.filter("members", lambda m: m["k"] == F.col("all_keep")), lambda m: m["edge"])) if keep != "max" else F.array_max(F.transform(F.filter("members", lambda m: m["k"] == F.col("all_keep")), lambda m: m["edge"])),
        F.array_max(F.transform("members", lambda m: m["edge"])),
    )
    closed = groups.select("total", "all_keep", owner.alias("owner"), F.explode("members").alias("m")).select(F.col("m.edge").alias("edge"), "total", "all_keep", "owner")
    out = join_small(runs, shared(closed, "exact-edges"), "edge")
    met = F.col("total").isNotNull()
    cols = [
        "id",
        F.when(met, F.col("all_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(met, F.col("total")).otherwise(F.col("group_size")).alias("group_size"),
        (F.col("stays") & (~met | (F.col("edge") == F.col("owner")))).alias("kept"),
        "sha256",
    ]
    return out.select(*cols, *(["row"] if carry else []))


def drop_exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    return exact_duplicates(docs, text_col, id_col, keep, carry=True).where("kept").select("row.*")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""


def query(docs: DataFrame) -> DataFrame:
    found = exact_duplicates(docs, keep="max")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))
