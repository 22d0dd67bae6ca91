"""One row with all that belongs to it: child lists of several kinds, nested by a single shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nested(children: dict[str, tuple[DataFrame, int]], key: str) -> DataFrame:
    """(key, <tag>, n_<tag>): per tag the first so many texts as an array, and how many there are in all.
    ``children``: tag to rows (key, place, text), places sorting as strings, and to its cap. The rows of
    all tags are dealt by key once; ranks and lists need no further shuffle, and no list is longer
    than its cap, however many rows a key has."""
    tagged = [df.select(key, F.lit(tag).alias("tag"), F.col("place").cast("string").alias("place"), F.col("text").cast("string").alias("text")) for tag, (df, _) in children.items()]
    rows = reduce(lambda a, b: a.unionByName(b), tagged).repartition(key)
    own = Window.partitionBy(key, "tag")
    rows = rows.withColumn("all", F.count("*").over(own)).withColumn("nth", F.row_number().over(own.orderBy("place", "text")))
    cap = reduce(lambda acc, x: F.when(F.col("tag") == x[0], x[1][1]).otherwise(acc), children.items(), F.lit(0))
    kept = rows.filter(F.col("nth") <= cap).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("tag", "nth", "text", "all"))).alias("rows"))
    one = lambda tag: F.filter("rows", lambda r: r["tag"] == tag)
    lists = [F.transform(one(tag), lambda r: r["text"]).alias(tag) for tag in children]
    sizes = [F.coalesce(F.get(one(tag), F.lit(0))["all"], F.lit(0)).alias(f"n_{tag}") for tag in children]
    return kept.select(key, *lists, *sizes)
