"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "sextant", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SEXTANT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it, each with one thread of linear algebra.

    On a cluster the package is installed or shipped; where it stands at the same path
    on every machine (one machine, a shared mount) this is enough. Tasks already fill the
    cores, so more threads in a worker would only wait for each other.
    """
    root = str(Path(__file__).resolve().parent.parent)
    workers = spark.sparkContext.environment
    known = workers.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        workers["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    for name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
        workers.setdefault(name, "1")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Where that setting is missing, a temporary folder of this process stands in, but only on a
    local master: executors of a cluster would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return _stand_in()


@functools.cache
def _stand_in() -> str:
    folder = tempfile.mkdtemp(prefix="sextant-shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_folder(spark)}/sextant-{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(hadoop)  # only what exists is marked for deletion
    system.deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts the lineage without tying the result to any executor: what is written
    survives the loss of the executors that wrote it.
    """
    spark = df.sparkSession
    path = f"{scratch(spark, name)}/rows"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
