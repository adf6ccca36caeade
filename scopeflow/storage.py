"""Tables written on the way: in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OPEN = threading.local()
_LOCAL: dict[str, str] = {}  # the folder of each application that has none to share


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``. Where that is unset and all runs on this machine (as in tests), below a local temporary folder;
    on a cluster that would be a folder of each executor's own, so it is an error there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is to name a folder that all of {master} share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="scopeflow-")
        base = _LOCAL[app]
    return f"{base.rstrip('/')}/scopeflow-{label}-{uuid.uuid4().hex}"


def _scopes() -> list[list[str]]:
    if not hasattr(_OPEN, "scopes"):
        _OPEN.scopes = []
    return _OPEN.scopes


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are ``written`` inside are removed at the end; those that are ``kept`` pass to the scope around it, if there is one."""
    own: list[str] = []
    _scopes().append(own)
    try:
        yield
    finally:
        _scopes().remove(own)
        remove(spark, *own)


def _write(df: DataFrame, label: str, scope: list[str] | None) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = shared_dir(spark, label)
    if scope is not None:
        scope.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, and survives the loss of any executor."""
    return _write(df, label, _scopes()[-1] if _scopes() else None)[0]


def kept_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The same for a result, and its path: it outlives the scope that it is made in."""
    return _write(df, label, _scopes()[-2] if len(_scopes()) > 1 else None)


def kept(df: DataFrame, label: str) -> DataFrame:
    return kept_at(df, label)[0]


def unused(columns: list[str], name: str) -> str:
    """``name``, or a longer one if a column is called so, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables through Hadoop's file system, wherever they are."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
