"""Session helpers: where shared files go, and how executors find this package."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(app: str = "sandpiper", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


#: Bytes of an Arrow batch between the JVM and Python workers, where the session doesn't set them: 10,000 long texts would make a large one.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started, and bound what reaches them at a time."""
    if BATCH_BYTES[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH_BYTES)
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{known}" if known else ROOT
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none and runs on one machine (tests) a temporary folder is set; a cluster has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="sandpiper-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df):
    """Cut the lineage: a reliable checkpoint in the shared folder.

    Sessions with spark.cleaner.referenceTracking.cleanCheckpoints drop its files once nothing refers to it.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders in a folder that were written to the end; none where there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    done = (f.getPath() for f in files.listStatus(path) if f.isDirectory())
    return [p.getName() for p in done if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
