"""Session helpers: the shared folder, cutting lineage, skew-safe look-ups."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 8
# Rows of a look-up table that is broadcast, and bytes of its keys.
MAX_LOOKUP_ROWS, MAX_LOOKUP_BYTES = 1_000_000, 64 << 20
# Spark's limit for the buckets of a table.
MAX_PARTITIONS = 100_000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    The driver serves the archive, so its folder need not be shared.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="tagloom-")) / root.name
        spark.sparkContext.addPyFile(shutil.make_archive(str(archive), "zip", root.parent, root.name))
        _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can read, as the cluster names it.

    Only a local session may fall back to a folder of its own.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="tagloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Spark's option to drop the shuffle files of an action when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pin(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` at a reliable checkpoint.

    The rows survive the loss of executors and do not change if a task is rerun. Shuffle files go as soon as the rows
    are written, not when the driver next collects its garbage: no other action runs the plan that made them.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        # A plan takes the option as it is when the plan is made.
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet files in the shared folder, for rows that cost much to make and are used more than once."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def task_partitions(spark: SparkSession, groups: int) -> int:
    """Partitions for groups that mean much work on little data.

    As many as the data has groups, if that is more than keeps the cores busy. Given to
    ``repartition`` as a number, they are not merged for being small.
    """
    cores = 4 * spark.sparkContext.defaultParallelism
    return min(4 * groups, max(cores, groups), MAX_PARTITIONS)


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """Keys that ``repartition(n, key)`` puts into ``n`` partitions of their own, for few groups of much work each.

    Only the balance hangs on it: the result would be the same if some met.
    """
    tried = spark.range(n * (int(n).bit_length() + 10) * 2).repartition(n, "id")
    firsts = tried.groupBy(F.spark_partition_id().alias("at")).agg(F.min("id").alias("id")).collect()
    found = [row.id for row in firsts][:n]
    return found + [-1 - i for i in range(n - len(found))]


def store_bucketed(df: DataFrame, key: str, buckets: int, name: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, bucketed by ``key``.

    Reading it back needs no shuffle to group or co-group by the key, however
    often that is done. Buckets are written by one task each.
    """
    spark, name = df.sparkSession, name or f"tagloom_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key)
    writer.option("path", scratch_path(spark, "bucketed")).saveAsTable(name)
    return spark.table(name)


@contextmanager
def stored_bucketed(df: DataFrame, key: str, buckets: int) -> Iterator[DataFrame]:
    """``store_bucketed`` while the block runs; then the catalog forgets the table, so pin what is to outlive it."""
    name = f"tagloom_{uuid.uuid4().hex}"
    try:
        yield store_bucketed(df, key, buckets, name)
    finally:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def spread(df: DataFrame) -> DataFrame:
    """Give a small input, such as a single-split file, a partition per core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if ``df``, which should be pinned, has few rows."""
    return F.broadcast(df) if df.count() <= max_rows else df


def counted(table: DataFrame, key: str) -> dict[str, int]:
    """The bounds for ``lookup_join`` of a pinned or stored table, by one job."""
    size = F.coalesce(F.sum(F.octet_length(key).cast("long")), F.lit(0))
    rows, size = table.agg(F.count(F.lit(1)), size).first()
    return {"bound": rows, "bound_bytes": size}


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: list[str],
    how: str,
    bound: int,
    bound_bytes: int = 0,
    salts: int = SALTS,
    most: int | None = None,
) -> DataFrame:
    """Join ``left``, where one key may hold a large share of the rows, with
    ``right``, where ``key`` is unique and which has at most ``bound`` rows with keys of ``bound_bytes``.

    A small right side (``MAX_LOOKUP_ROWS``, or ``most`` if that is less) is broadcast.
    Otherwise the rows of every key go to ``salts`` tasks, chosen by a hash of the
    ``spread`` columns, and each right row is copied to all of them.
    """
    limit = MAX_LOOKUP_ROWS if most is None else min(most, MAX_LOOKUP_ROWS)
    if bound <= limit and bound_bytes <= MAX_LOOKUP_BYTES:
        return left.join(F.broadcast(right), key, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Spark guesses sizes from compressed files and without the copies: it would broadcast what was counted as too large.
    return salted.join(copies.hint("merge"), [key, "_salt"], how).drop("_salt")
