"""Sessions, and sending this package to executors that can't import it."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", **more: str) -> SparkSession:
    """A session of this machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("sheafspark").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
    for k, v in {**SETTINGS, **more}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession, root: str) -> None:
    """Adds the package to the session's files, once, unless the workers' path or folder has it already."""
    sc = spark.sparkContext
    if getattr(sc, "_sheafspark_shipped", False):
        return
    sc._sheafspark_shipped = True
    root = os.path.realpath(root)
    places = [os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p]
    if root in places:
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "sheafspark")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    path = os.path.join(sc._temp_dir, "sheafspark.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(path)


@lru_cache(1)
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="sheafspark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, without it a folder in the warehouse; in a session of one process (master local) one of that process's own, made when it is first asked for and deleted with it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.split("[")[0] == "local":
        found = _local_folder()
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_sheafspark").rstrip("/")


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """A path and the file system it is in, as the JVM has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Stored:
    """Tables in the shared folder that cut lineage and outlive an executor; what isn't dropped before goes when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/sheafspark-{uuid.uuid4().hex}", 0

    def folder(self) -> str:
        """A new folder's path."""
        if not self.n:
            at, fs = hadoop_path(self.spark, self.base)
            fs.mkdirs(at)
            fs.deleteOnExit(at)
        self.n += 1
        return f"{self.base}/{self.n}"

    def cut(self, df: DataFrame) -> DataFrame:
        """df written and read back, with the schema it has."""
        path = self.folder()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stored_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            at, fs = hadoop_path(self.spark, t._stored_path)
            fs.delete(at, True)
