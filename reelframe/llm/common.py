"""Shared helpers of the corpus operators: shared storage, word patterns, row carrying."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Sides with at most so many rows may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 20_000


_HERE = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session wins. Where it is unset, a local master gets a temporary
    folder (tests) and a cluster a folder in its warehouse, unless that lies on each machine's own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            base = "file://" + tempfile.mkdtemp(prefix="reelframe-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_reelframe"
            if base.startswith(("file:", "/")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    files, target = _file_system(spark, path)
    files.delete(target, True)


def shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage ends there.

    A lost executor costs a re-read, not a recomputation, and non-deterministic columns are fixed.
    The files go when the enclosing ``freed`` block or else the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/reelframe-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, target = _file_system(spark, path)
    files.deleteOnExit(target)
    for block in getattr(_HERE, "blocks", [])[-1:]:
        block.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._reelframe_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables of ``shared`` that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._reelframe_path)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what ``shared`` wrote within: for results that have been written elsewhere by then."""
    blocks = _HERE.__dict__.setdefault("blocks", [])
    blocks.append([])
    try:
        yield
    finally:
        for path in blocks.pop():
            remove(spark, path)


def numbered(df: DataFrame, order: list[Column], number: str, name: str) -> DataFrame:
    """``df`` with its gapless place in the order, from 0: ranges are sorted apart, then offset by their counts.

    The driver holds one row a partition.
    """
    cols = {"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    local = shared(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(cols), name)
    at, before = 0, []
    for r in local.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        before.append((r["_part"], at))
        at += r["n"]
    start = df.sparkSession.createDataFrame(before, "_part int, _before long")
    return local.join(F.broadcast(start), "_part").withColumn(number, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left", rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``small`` to ``big``; broadcast only if ``small`` is counted to be within ``most`` rows.

    Beyond that it is an ordinary shuffled join, whose skewed keys adaptive execution splits.
    """
    n = small.count() if rows is None else rows
    return big.join(F.broadcast(small) if n <= most else small, on, how)


#: Bits of a membership filter: 2,048 bitmaps of 4 KB, 8 MB at any corpus size.
FILTER_BITS = 26


def may_be_in(big: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``big`` whose 64-bit ``key`` may be among ``keys``: none of those is lost.

    A bitmap of fixed size is broadcast, so its bound holds whatever ``keys`` holds; the more keys,
    the more other rows pass too, and the join that follows drops them.
    """
    place = F.pmod(F.col(key), F.lit(1 << FILTER_BITS))
    maps = keys.select(place.alias("_p")).groupBy(F.shiftright("_p", 15).alias("_bucket")).agg(F.bitmap_construct_agg(F.col("_p").bitwiseAND(F.lit(32767))).alias("_map"))
    # eight bytes of a bitmap as a long, the last byte lowest
    words = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.conv(F.hex(F.substring("_map", i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    maps = shared(maps.select("_bucket", words.alias("_words")), "filter")
    found = big.withColumn("_p", place).withColumn("_bucket", F.shiftright("_p", 15)).withColumn("_bit", F.col("_p").bitwiseAND(F.lit(32767)).cast("int"))
    word = F.element_at("_words", F.shiftright("_bit", 6) + 1)
    at = F.lit(56) - F.shiftright("_bit", 3).bitwiseAND(F.lit(7)) * 8 + F.col("_bit").bitwiseAND(F.lit(7))
    hit = F.call_function("shiftright", word, at.cast("int")).bitwiseAND(F.lit(1)) == 1
    return found.join(F.broadcast(maps), "_bucket").where(hit).select(*big.columns)


def words_array(text: Column) -> Column:
    """Words of ``text`` in order; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    """Number of words of ``text`` as a long; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def nest(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that helper columns can't clash with them."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
