"""Session construction and lineage control."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "panelweave", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PANELWEAVE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Call sites recorded for every column expression cost more than small queries themselves.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def _private_folder() -> str:
    """A folder of this process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="panelweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _checkpoint_ready(spark: SparkSession) -> bool:
    """True once the context has a checkpoint folder that outlives executors.

    The folder named by ``spark.checkpoint.dir`` is used where the cluster sets one. Only a local
    master without that setting gets a private folder; a cluster without it is never pointed at a
    folder of one machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return True
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
        return True
    if sc.master.startswith("local"):
        sc.setCheckpointDir(_private_folder())
        return True
    return False


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, beside the checkpoints."""
    if not _checkpoint_ready(spark):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once so that several passes over it do not repeat the work behind it.

    Writes a reliable checkpoint, which survives lost executors. A cluster that names no shared
    folder gets a cached frame instead, which Spark rebuilds from its lineage when blocks are lost.
    """
    if _checkpoint_ready(df.sparkSession):
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per Spark context.

    Functions that run inside tasks refer to it, and executors need not have it installed.
    """
    sc = spark.sparkContext
    if getattr(sc, "_panelweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(_private_folder(), "panelweave.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, os.path.join("panelweave", f.relative_to(root)))
    sc.addPyFile(target)
    sc._panelweave_shipped = True
