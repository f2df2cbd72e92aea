"""Written tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The tables written within the innermost scope that drops them; none outside of any.
_OPEN: ContextVar[list[str] | None] = ContextVar("written_tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    set_by = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_by:
        return set_by.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        known = sc._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/accord-{uuid.uuid4().hex}"
    if (made := _OPEN.get()) is not None:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Drops the tables that are written within, at its end: `with scratch(spark) as kept: out = kept(...)`.

    kept writes a result that outlives the scope; nothing else made within may be used after it, as a plan reads its
    tables only when it runs. Scopes may lie in one another: what the inner one keeps, the outer one drops.
    """
    made: list[str] = []
    outer = _OPEN.get()
    token = _OPEN.set(made)

    def kept(df: DataFrame) -> DataFrame:
        inner = _OPEN.set(outer)
        try:
            return written(df)
        finally:
            _OPEN.reset(inner)

    try:
        yield kept
    finally:
        _OPEN.reset(token)
        _drop(spark, made)
