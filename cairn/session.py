"""Sessions, shared storage and shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_local_dirs: dict[str, str] = {}


def local_session(app: str = "cairn", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and small runs; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="cairn-ship-")
    archive = os.path.join(folder, "cairn_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    spark.sparkContext.addPyFile(archive)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors may ask for it as long as the application runs
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session that names none gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="cairn-shared-")
        spark.sparkContext.setCheckpointDir(_local_dirs[app])
    return "file://" + _local_dirs[app]


class Stored:
    """Tables written to the shared folder to cut lineage.

    ``drop`` deletes those that are no longer read, ``keep`` all but those that still are.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cairn-{uuid.uuid4().hex}"
        self._n = 0
        self._there: set[str] = set()

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:02d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cairn_path = path
        self._there.add(path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        self._delete({df._cairn_path for df in frames} & self._there)

    def keep(self, *frames: DataFrame) -> None:
        self._delete(self._there - {df._cairn_path for df in frames})

    def _delete(self, paths: set[str]) -> None:
        for path in paths:
            delete_path(self.spark, path)
        self._there -= paths


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
