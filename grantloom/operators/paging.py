"""Keyset pages for a table of requests: many cursors against one ordered table at once.

Rows and cursors are sorted together, cut into ranges, so a cursor's place is the number of rows before
it; a page is then an equality join on the rows' ranks. No cursor is compared with all rows, and no
task holds the whole order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantloom.tables import kept


def running_count(rows: DataFrame, keys: list[str], counted: str) -> DataFrame:
    """``rows`` with ``upto``, the sum of ``counted`` over all rows up to and with this one in the order of
    ``keys``: within ranges by a window, across them by the ranges' own sums, one row a range."""
    cut = kept(rows.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()), "ordered")
    sums = cut.groupBy("range").agg(F.sum(counted).alias("own"))
    before = kept(sums.withColumn("before", F.sum("own").over(Window.orderBy("range")) - F.col("own")).select("range", "before"), "ranges")
    within = F.sum(counted).over(Window.partitionBy("range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("within", within).join(before, "range").withColumn("upto", F.col("within") + F.col("before")).drop("range", "within", "before")


def keyset_pages(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, place, id, next_id): the rows after each request's cursor, ``size`` of them at most;
    ``next_id`` is the page's last row where more follow, else null. ``rows``: (late, k, id), sorted so;
    ``requests``: (request_id, late, k, id, size), the cursor null for a first page; it need not be a row."""
    keys = ["late", "k", "id", "kind"]
    own = rows.select("late", "k", "id", F.lit(0).alias("kind"), F.lit(1).alias("is_row"), F.lit(None).cast("long").alias("request_id"), F.lit(0).alias("size"))
    asked = requests.filter("id is not null").select("late", "k", "id", F.lit(1).alias("kind"), F.lit(0).alias("is_row"), "request_id", "size")
    placed = kept(running_count(own.unionByName(asked), keys, "is_row"), "placed")
    # ranks lie in a table of their own, which is as small as the rows are, however many requests there are
    ranks = kept(placed.filter("kind = 0").select(F.col("upto").alias("rank"), "id"), "ranks")
    total = ranks.agg(F.count("*").alias("total"))
    first = requests.filter("id is null").select("request_id", "size", F.lit(0).cast("long").alias("upto"))
    wanted = placed.filter("kind = 1").select("request_id", "size", "upto").unionByName(first).crossJoin(total).filter("size > 0 and upto < total")
    # a page's last row by its rank, so that no page is gathered again; ranks below zero are nobody's
    wanted = wanted.withColumn("last", F.expr("if(upto + size < total, upto + size, -1 - pmod(xxhash64(request_id), 1000000))")).join(ranks.select(F.col("rank").alias("last"), F.col("id").alias("next_id")), "last", "left")
    each = wanted.select("request_id", "upto", "next_id", F.explode(F.expr("sequence(upto + 1, least(upto + size, total))")).alias("rank"))
    return each.join(ranks, "rank").select("request_id", (F.col("rank") - F.col("upto")).cast("int").alias("place"), "id", "next_id")
