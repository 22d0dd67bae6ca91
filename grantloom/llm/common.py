"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words in all contracts, as a regular-expression class.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``. Where it is
    unset, local mode gets a temporary folder of its own, removed at exit; a cluster gets an error,
    as its executors would write to their own disks and later reads would miss those files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as a table of the shared folder and read it again.
    Unlike cached blocks the files survive the loss of executors. Tables lie in one folder per
    application; :func:`release` removes those that no result needs any more. Where a bound on the
    rows is known, the last stage gets no more tasks than these rows (of ids) ask for."""
    spark = df.sparkSession
    if rows is not None and (tasks := rows // 200_000 + 1) < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(tasks)
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables made by :func:`written` that nothing will read again."""
    for t in tables:
        jvm, spark = t.sparkSession._jvm, t.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(t.table_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with an id of its own for every row, and (row, doc_id) to go back.

    Where no doc_id is null or occurs twice the rows stay as they are and the second is None.
    Else rows get numbers in the order of doc_id (nulls first), ties by their text's hash; they are
    written, so that every later step sees the same numbers.
    """
    docs = documents(docs)
    if docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        # never null, which spares joins their null filters, so that they can share one shuffle
        return docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(0))), None
    order = docs.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = written(order.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
    return rows.select(F.coalesce("row", F.lit(0)).alias("doc_id"), "text"), rows.select("row", "doc_id")


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


@contextmanager
def small_batches(df: DataFrame, size: str = "8m") -> Iterator[None]:
    """What is written meanwhile hands rows to Python by fewer at a time: long texts, or rows that hold many sets, take
    several times their size there and as much again in the JVM's buffers."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    old = conf.get(name)
    conf.set(name, size)
    try:
        yield
    finally:
        conf.set(name, old)
