"""Written tables that cut lineage, and row positions without a single-task window."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

import pyarrow.fs as pafs
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: list[str] = []
#: Paths that this process wrote and has not deleted yet.
_written: set[str] = set()
#: Schemes that Hadoop and Arrow name differently.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the session leaves it unset and all runs on one machine (tests)
    is a local temporary folder made, and set as the context's checkpoint
    folder; on a cluster an unset folder is an error. The path always has a
    scheme, so that Spark and Arrow take it for the same place.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return qualified(spark, told.rstrip("/"))
    master = spark.sparkContext.master or ""
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="linkloom-"))
        atexit.register(_forget, _fallback[0])
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_fallback[0])
    return _fallback[0]


def _forget(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority that Hadoop's configuration gives it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def arrow_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and path for a qualified path; usable in tasks."""
    scheme, mark, rest = uri.partition("://")
    if not mark:
        raise ValueError(f"{uri} has no scheme")
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")


def _delete(jvm, conf, path: str) -> None:
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)
    _written.discard(path)


@atexit.register
def _delete_all() -> None:
    """What lazy results still read cannot go before the process ends; it goes then."""
    try:
        jvm = SparkContext._jvm
        conf = jvm.org.apache.hadoop.conf.Configuration() if SparkContext._active_spark_context is None else SparkContext._active_spark_context._jsc.hadoopConfiguration()
        for path in list(_written):
            _delete(jvm, conf, path)
    except Exception:  # the JVM is gone
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; deleted when the process ends."""
    path = f"{shared_dir(spark)}/linkloom/{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back.

    The written table survives the loss of executors; reading it starts a plan
    with no lineage before it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._linkloom_path = path
    return out


def drop_table(df: DataFrame | None) -> None:
    """Delete the files of a table that ``materialize`` wrote and nothing reads any more."""
    path = getattr(df, "_linkloom_path", None)
    if path:
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what lies at a path that ``new_path`` gave."""
    _delete(spark._jvm, spark._jsc.hadoopConfiguration(), path)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of steps that are over.

    It does so when the driver's garbage is collected: those of the step that
    has just ended mostly at the second time only, a moment later.
    """
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.3)
    spark._jvm.System.gc()


def with_position(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """Append the 0-based rank of each row in the total order ``order``.

    Rows are range-partitioned and sorted in parallel; only one count per
    partition is gathered, so no task ever sees all rows. ``order`` must be
    unique for the ranks to be the same on every run.
    """
    mid = "__mid"
    ranged = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(mid, F.monotonically_increasing_id()),
        name,
    )
    part = F.shiftright(F.col(mid), 33)
    counts = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n")).collect()  # a row per partition
    offset, rows = 0, []
    for r in sorted(counts, key=lambda r: r["__part"]):
        rows.append((r["__part"], offset))
        offset += r["__n"]
    spark = df.sparkSession
    starts = spark.createDataFrame(rows, "__part long, __start long")
    out = (
        ranged.withColumn("__part", part)
        .join(F.broadcast(starts), "__part")  # one row per partition
        .withColumn(name, F.col("__start") + F.col(mid).bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__part", "__start", mid)
    )
    out._linkloom_total = offset
    return out
