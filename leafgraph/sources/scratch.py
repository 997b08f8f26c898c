"""Intermediate tables in the shared folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OPEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where it is unset a temporary one becomes it, on a single machine; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            folder = own.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            folder = tempfile.mkdtemp(prefix="leafgraph-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str, result: bool = False) -> str:
    """A path that nothing is at yet, in the innermost ``scratch``, or for its result in the one around it."""
    scopes = _OPEN[:-1] if result else _OPEN
    return "/".join([shared_folder(spark), *scopes[-1:], f"{name}-{uuid.uuid4().hex}"])


def kept(df: DataFrame, name: str = "kept", result: bool = False) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back: lineage ends here and no executor holds the only copy."""
    path = fresh_path(df.sparkSession, name, result)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are removed at the end; what shall stay is written with ``result`` or collected before."""
    _OPEN.append("/".join([*_OPEN[-1:], f"scratch-{uuid.uuid4().hex}"]))
    try:
        yield
    finally:
        remove(spark, f"{shared_folder(spark)}/{_OPEN.pop()}")
