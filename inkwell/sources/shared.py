"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KNOWN: dict[tuple, object] = {}
_OWN: list[str] = []
_HERE = threading.local()


def folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir.

    Only where driver and executors are one process, as in tests, it may be unset; then a folder of this machine serves, until
    Python ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="inkwell-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        base = "file://" + _OWN[0]
    return f"{base.rstrip('/')}/inkwell-pages-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Deletes all tables that this application has stored; results that read them are void then."""
    _KNOWN.clear()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def kept_while(spark: SparkSession) -> Iterator[None]:
    """What is stored meanwhile by this thread is deleted at the end."""
    before, _HERE.place = getattr(_HERE, "place", None), f"{folder(spark)}/while-{uuid.uuid4().hex}"
    try:
        yield
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(_HERE.place)
        _HERE.place = before
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table under spark.checkpoint.dir: later steps read it instead of planning and computing all before it again, and it survives lost executors."""
    spark = df.sparkSession
    path = f"{getattr(_HERE, 'place', None) or folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt so that those of equal keys lie in one task.

    By a hash, as Spark leaves out a repartition by the very keys that a join beneath has shuffled by, and may then still turn that
    join into a broadcast one, whose rows stay where they were read.
    """
    return rows.repartition(F.xxhash64(*keys))


def fingerprint(spark: SparkSession, *paths: str) -> tuple:
    """What tells one content of files from another without reading them: names, sizes and times of change."""
    jvm, found = spark._jvm, []
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in [files.getFileStatus(path), *files.listStatus(path)]:
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(set(found)))


def remembered(spark: SparkSession, key: tuple, make: Callable[[], object]):
    """make()'s result, kept for the session under a key that names its inputs and parameters."""
    key = (folder(spark), *key)
    if key not in _KNOWN:
        _KNOWN[key] = make()
    return _KNOWN[key]
