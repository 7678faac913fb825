"""Session helpers: checkpoint folder, task spread, shipping the package to executors."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Tasks per core that a costly Python stage is cut into.
WAVES = 4
#: Bytes of an Arrow batch, so that long texts do not come by the ten thousand.
BATCH_BYTES = 64 << 20


def local_session(cores: str = "*", **settings: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("symloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors share one machine."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ensure_checkpoints(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the session names, else a temporary one, on one machine only.

    A temporary folder is removed when the driver's process ends.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not is_local(spark):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="symloom-checkpoints-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
        current = sc.getCheckpointDir()
    return current


def _folder(spark: SparkSession) -> str:
    """Where the tables of this application lie."""
    return f"{ensure_checkpoints(spark).rstrip('/')}/symloom-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Compute a frame once, as a table in the checkpoint folder, and go on from that table.

    A written table cuts the lineage as checkpoint() does, outlives any
    executor, and carries neither plans nor constraints from round to round.
    The tables of an application lie in one folder: forget() removes one that
    nothing reads any more, release() all of them.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def as_table(df: DataFrame) -> DataFrame:
    """cut(), unless the frame is a table already."""
    return df if hasattr(df, "_cut_path") else cut(df)


def cut_counting(df: DataFrame, condition: str = "true") -> tuple[DataFrame, int]:
    """cut(), and how many rows meet a condition, counted while the table is written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count_if(F.expr(condition)).alias("n")))
    return out, int(seen.get.get("n") or 0)


def forget(df: DataFrame) -> None:
    """Remove the table behind a frame that cut() gave, once nothing will read it again."""
    path = getattr(df, "_cut_path", None)
    if path:
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Remove all tables that operators of this application wrote; call it when their results are stored."""
    if spark.sparkContext.getCheckpointDir() is not None:
        _delete(spark, _folder(spark))


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, waves: int = WAVES) -> DataFrame:
    """Split a frame over enough tasks for a stage of Python on texts, and bound its batches.

    Nothing happens when the scan already has that many splits, as on large inputs.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "-1", str(2**31 - 1), "2147483647b"):
        # long texts must not come by the ten thousand; a bound of the session's own stands
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    want = cores(df.sparkSession) * waves
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def ship(spark: SparkSession) -> None:
    """Send this package to executors that do not share the driver's files."""
    sc = spark.sparkContext
    if is_local(spark):
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir() or getattr(sc, "_symloom_shipped", False):
        return
    sc._symloom_shipped = True
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*")):
            if path.is_file() and "__pycache__" not in path.parts:
                z.write(path, str(path.relative_to(root.parent)))
    folder = tempfile.mkdtemp(prefix="symloom-ship-")
    target = os.path.join(folder, "symloom_ship.zip")
    Path(target).write_bytes(buffer.getvalue())
    sc.addPyFile(target)
