"""Intermediate tables in a folder that the driver and all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``; where that
is unset, as in a local session, it is a hidden folder of the SQL warehouse.
Everything a session wrote here is removed when the driver's process ends.
"""

import atexit
import contextlib
import gc
import posixpath
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}
_passing: list[list[str]] = []


def hadoop(spark: SparkSession, path: str):
    """(the file system a path is on, the path) as Hadoop's own objects."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(conf), where


def root(spark: SparkSession) -> str:
    """The session's own folder below the shared one."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            shared = posixpath.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")
        _roots[app] = posixpath.join(shared, f"tables-{uuid.uuid4().hex}")
        files, where = hadoop(spark, _roots[app])
        atexit.register(files.delete, where, True)
    return _roots[app]


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path, not yet written."""
    path = posixpath.join(root(spark), f"{name}-{uuid.uuid4().hex}")
    if _passing:
        _passing[-1].append(path)
    return path


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Every folder made inside is removed at the end, and the shuffle files of its queries."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            remove(spark, path)
        release(spark)


def remove(spark: SparkSession, path: str) -> None:
    files, where = hadoop(spark, path)
    files.delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished queries, which otherwise stay until the
    driver's JVM happens to collect what refers to them."""
    gc.collect()  # frames that refer to one another hold their plans until then
    time.sleep(0.3)  # the JVM is told of them by a thread that looks each tenth of a second
    for _ in range(3):  # plans go first, then the shuffles that they held
        # the threads that hand out Spark's events hold the last query until the next one ends
        spark.range(1).collect()
        with contextlib.suppress(Py4JJavaError):  # after ten seconds: what is still held goes later
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        time.sleep(0.1)
        spark.sparkContext._jvm.System.gc()


def table(rows: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``rows`` computed once: written, and read back with its lineage cut."""
    return placed(rows, name, codec)[0]


def placed(rows: DataFrame, name: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """As ``table``, with the path, for a caller that removes it again."""
    spark = rows.sparkSession
    path = folder(spark, name)
    rows.write.option("compression", codec).parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path
