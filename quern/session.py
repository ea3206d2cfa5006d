"""Sessions, and the package on the workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def session(cores: str = "*", **conf) -> SparkSession:
    """A local session with the settings that tests and the bench use; a running one is taken as it is."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("quern")
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once a session.

    Where PYTHONPATH or the working folder already has it, nothing is sent.
    """
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False):
        return
    sc._quern_shipped = True
    parent = ROOT.parent
    seen = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if any(Path(p).resolve() == parent for p in seen) or Path.cwd() == parent:
        return
    folder = tempfile.mkdtemp(prefix="quern-")  # Spark serves the file from here for as long as the session lives
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/quern.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in ROOT.rglob("*.py"):
            z.write(f, f.relative_to(parent))
    sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); on one machine, where none is set, a temporary one."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="quern-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when this process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path that shared_path() gave."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made.remove((spark, path))


def _clean() -> None:
    for spark, path in list(_made):
        try:
            remove(spark, path)
        except Exception:  # the session has ended: the folder's owner clears it
            return


atexit.register(_clean)
