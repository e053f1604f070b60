"""Tables that cut lineage: written once into the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of this machine; on a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints", "lateview")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


_rooms: dict[str, str] = {}


def fresh_folder(spark: SparkSession, name: str = "table") -> str:
    """The path of a new folder in the shared one; what is still there goes when the application's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _rooms:
        room = f"{shared_folder(spark)}/lateview-{uuid.uuid4().hex}"
        store, where = _file_system(spark, room)
        store.mkdirs(where)
        store.deleteOnExit(where)
        _rooms[app] = room
    return f"{_rooms[app]}/{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage, is computed once, and survives the loss of executors.
    """
    spark = df.sparkSession
    path = fresh_folder(spark)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._shared_folder = path
    return back


def discard(*tables: DataFrame) -> None:
    """Remove what :func:`write_shared` wrote for these tables, once nothing that is still to run reads them."""
    for t in tables:
        store, where = _file_system(t.sparkSession, t._shared_folder)
        store.delete(where, True)
