"""Where jobs put what they write between steps, and the local test session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver may do without the
    setting; elsewhere each machine would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.gettempdir()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share."""
    base = shared_folder(spark)
    return f"{base.rstrip('/')}/lodeseek/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str) -> DataFrame:
    """Write an intermediate result once and go on from its files.

    Later steps then neither repeat calls to an embedding server nor depend on
    the memory of executors that may be lost.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete intermediate files that no later step reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


# A scan of up to this many bytes may be dealt out anew; larger ones never are.
SPREAD_BYTES = 256 << 20


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a small scan dealt out evenly over the cores.

    A few row groups would leave most cores idle in the CPU-bound stage that
    follows. The planner's estimate of the scan's size decides, without running
    anything; a scan of more than ``SPREAD_BYTES`` is passed on as it is and never
    shuffled for this.
    """
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SPREAD_BYTES:
        return scan
    return scan.repartition(2 * scan.sparkSession.sparkContext.defaultParallelism)


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodeseek")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
