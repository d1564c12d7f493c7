"""Session defaults and the shared work folder."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_WORK: dict[str, str] = {}


def local_session(cpus: int = 8, app: str = "candlemill", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster bring your own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # call-site capture on every column costs more than planning a wide query
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Folder for tables that cut lineage.

    The cluster names a shared folder in ``spark.checkpoint.dir``. A machine-local
    folder is used only by a local master that has named none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_WORK:
        _LOCAL_WORK[app] = tempfile.mkdtemp(prefix="candlemill-")
    return _LOCAL_WORK[app]


def table_path(spark: SparkSession, name: str) -> str:
    return os.path.join(work_dir(spark), "candlemill", f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df: DataFrame, name: str = "stage", codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the work folder and read it back; ``codec`` names another Parquet compression.

    Unlike a checkpoint the result stays columnar, so later scans prune columns and push
    filters, and it carries file sizes, so Catalyst decides broadcasts from real sizes.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files whose plans nothing refers to any more; Spark drops them after collections, not the first one."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
