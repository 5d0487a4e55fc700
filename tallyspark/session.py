"""Session defaults and the few settings that operators read from the running session."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Seconds between two sweeps of what no table refers to any more.
SWEEP = 5.0
_swept = 0.0


def local_session(cpus: int | str = "*", app: str = "tallyspark") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that they need no installation."""
    sc = spark.sparkContext
    if getattr(sc, "_tallyspark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tallyspark-"), "tallyspark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("tallyspark", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._tallyspark_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Only a session on one machine without the setting gets a temporary folder of its own; on a cluster
    the setting must be there.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = os.environ.get("TALLYSPARK_SHARED") or tempfile.mkdtemp(prefix="tallyspark-")
        os.environ["TALLYSPARK_SHARED"] = where
    return where.rstrip("/")


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of tables that nothing refers to any more.

    It does so only when the driver collects its garbage, and a driver with memory to spare never would.
    """
    global _swept
    if time.monotonic() - _swept >= SWEEP:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _swept = time.monotonic()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, which survives lost executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    sweep(spark)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=eager)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table that a later stage reads several times."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
