"""Session settings, table access and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def build(app: str = "fjordmill", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow transfer; the cluster's own settings win where set."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that no path has to be set on them."""
    sc = spark.sparkContext
    if getattr(sc, "_fjordmill_shipped", False):
        return
    fd, path = tempfile.mkstemp(prefix="fjordmill-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, Path(PACKAGE.name) / p.relative_to(PACKAGE))
    sc.addPyFile(path)
    sc._fjordmill_shipped = True
    atexit.register(lambda: os.path.exists(path) and os.remove(path))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where it is unset and all runs on this machine (tests) a folder of this
    application is made; on several machines it must be set, since what one writes locally the others can't read."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    sc = spark.sparkContext
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share: intermediate tables are written there")
    if not getattr(sc, "_fjordmill_folder", None):
        sc._fjordmill_folder = tempfile.mkdtemp(prefix="fjordmill-")
        sc.setCheckpointDir(sc._fjordmill_folder)
        atexit.register(shutil.rmtree, sc._fjordmill_folder, ignore_errors=True)
    return "file://" + sc._fjordmill_folder


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def application_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie; clear_tables() empties it, and so does the application's end."""
    return f"{shared_folder(spark)}/fjordmill-{spark.sparkContext.applicationId}"


def clear_tables(spark: SparkSession, application: str | None = None) -> None:
    """Delete all intermediate tables of this application, or of one that ended without doing so. DataFrames that were
    made before can't be read any more, so a long session calls this between queries."""
    _delete(spark, f"{shared_folder(spark)}/fjordmill-{application}" if application else application_folder(spark))


def side_by_side(jobs: list) -> list:
    """The results of several functions that run Spark jobs, in order; the first failure is raised."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


class Workspace:
    """Tables written to the shared folder. They cut lineage, survive the loss of executors, and go when the
    workspace is cleared (it is a context manager too), when clear_tables() is called or the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{application_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.kept: list[str] = []
        self.lock = threading.Lock()
        atexit.register(self._clear_quietly)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.clear()

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as a table and return it read back. The name may be used again: each write is a new folder."""
        with self.lock:
            path = f"{self.root}/{name}-{len(self.kept)}"
            self.kept.append(path)
        schema = df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def put_all(self, **tables: DataFrame) -> list[DataFrame]:
        """Several tables at once: their jobs run side by side, which pays where each is small."""
        return side_by_side([lambda n=name, df=df: self.put(df, n) for name, df in tables.items()])

    def drop(self, name: str, keep_last: int = 1) -> None:
        """Delete the older writes under a name, for loops that replace a table."""
        own = [p for p in self.kept if p and p.rsplit("/", 1)[1].rsplit("-", 1)[0] == name]
        for p in own[: len(own) - keep_last]:
            _delete(self.spark, p)
            self.kept[self.kept.index(p)] = ""

    def clear(self) -> None:
        _delete(self.spark, self.root)

    def _clear_quietly(self) -> None:
        try:
            self.clear()
        except Exception:
            pass
