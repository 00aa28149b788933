"""Tables written on the way, in the folder that driver and executors share; the package for executors' Python."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Folders made so far by a session, by application.
_made: dict[str, list[str]] = {}
_local: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a local master and an error on a cluster.

    A cluster's executors would each write to a disk of their own, and rows would be missing without an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='wayfold-')}"
    return _local[context.applicationId]


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder on shared storage, deleted when the session ends or the `passing` block it was made in does."""
    path = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
    system, where = _folder(spark, path)
    system.deleteOnExit(where)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch folders made in this block at its end: what is kept of it must be written elsewhere by then."""
    made = _made.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    yield
    for path in made[before:]:
        system, where = _folder(spark, path)
        system.delete(where, True)
    del made[before:]


def stored(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table: cuts its lineage, and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python once a session, wherever the driver imported it from."""
    context = spark.sparkContext
    if getattr(context, "_wayfold_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    with tempfile.TemporaryDirectory() as tmp:
        pack = Path(tmp) / "pack" / root.name
        shutil.copytree(root, pack, ignore=shutil.ignore_patterns("__pycache__"))
        name = shutil.make_archive(f"{tempfile.mkdtemp(prefix='wayfold-')}/{root.name}-package", "zip", pack.parent)
    context.addPyFile(name)
    context._wayfold_shipped = True
