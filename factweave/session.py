"""Session helpers: shared scratch space, checkpoints, task counts and checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest side, in estimated bytes, that this library ever broadcasts by hint.
BROADCAST_LIMIT = 32 << 20

_own: dict[int, str] = {}
_shipped: set[str] = set()
_scratch: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else a fresh local one (tests, single machine)."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    key = id(spark.sparkContext)
    if key not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="factweave-")
        atexit.register(shutil.rmtree, path, True)
        _own[key] = path
    return _own[key]


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: the files live in the shared folder and outlast executors."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for a table that an operator writes and reads again. It goes when the application ends."""
    base = f"{shared_dir(spark)}/factweave-{spark.sparkContext.applicationId}"
    if base not in _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _scratch.add(base)
    return f"{base}/{label}-{uuid.uuid4().hex}"


def default_tasks(spark: SparkSession) -> int:
    """Tasks for a CPU-heavy stage: the shuffle setting, and no fewer than the cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once per application, for operators that run Python there."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="factweave-zip-")
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, "factweave_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for base, _, files in os.walk(here):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(base, f)
                        z.write(full, os.path.join(os.path.basename(here), os.path.relpath(full, here)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, limit_bytes: int = BROADCAST_LIMIT) -> bool:
    """Whether Catalyst's own upper estimate of the plan's size is within the limit."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit_bytes


def maybe_broadcast(df: DataFrame, limit_bytes: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only if the estimated size is within the limit; otherwise leave the choice to AQE."""
    return F.broadcast(df) if small(df, limit_bytes) else df


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns of an input can never clash with an operator's own."""
    return df.select(*(df[n] for n in names))


def with_index(df: DataFrame, order: list[Column | str], name: str = "index") -> DataFrame:
    """df with the place of every row in an order, from 0, without gathering the rows in one task.

    The rows are range-partitioned by the order and checkpointed; the sizes of the ranges (one number a partition) give each
    range its first place, and within a range rows are numbered by a window.
    """
    ranges = checkpoint(df.repartitionByRange(default_tasks(df.sparkSession), *order).withColumn("_range", F.spark_partition_id()))
    first, at = [], 0
    for part, n in sorted(map(tuple, ranges.groupBy("_range").count().collect())):
        first.append((part, at))
        at += n
    starts = F.broadcast(df.sparkSession.createDataFrame(first, "_range int, _first long"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranges.withColumn("_n", place).join(starts, "_range").withColumn(name, F.col("_first") + F.col("_n")).drop("_range", "_n", "_first")
