"""Session set-up and the few decisions that need to look at the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "postlens", cores: int | None = None, **conf: str) -> SparkSession:
    """A session for local runs; on a cluster use the one spark-submit gives you."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if cores is not None:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.driver.memory", "6g")
            .config("spark.ui.enabled", "false")
        )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster a
    machine-local folder would not survive the loss of an executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for what is read more than once.

    Spark removes the files once the frame is out of use if the session sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``, as ``build_session`` does.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for one run's intermediate table."""
    _scratch.append(f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def remove_path(spark: SparkSession, path: str) -> None:
    """Removes a folder through Spark's own file systems."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clear_scratch(spark: SparkSession) -> int:
    """Removes all scratch folders of this process; call it when no result that reads them is needed any more."""
    done = len(_scratch)
    while _scratch:
        remove_path(spark, _scratch.pop())
    return done


def rules_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rules written in code: their size is the length of the list."""
    return F.broadcast(spark.createDataFrame(rows, schema))
