"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``, one level per application. Where that is
    unset, local mode gets a temporary folder, removed at exit; a cluster gets an error, as its
    executors would miss each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        found = f"file://{at}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
    """``df`` written once and read from there, whoever asks for it: several uses of a plan would run
    it several times. With ``by``, a column of few values, a filter on it reads its part alone."""
    path = folder(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def during(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Jobs herein run under these settings."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def tidy(spark: SparkSession):
    """What jobs herein shuffle is removed at the end of each, not when the driver happens to collect its
    garbage; for frames that are run once."""
    return during(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})
