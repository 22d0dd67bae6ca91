"""Content-addressed versions, observations, staging and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or update by key: a row of ``rows`` replaces the target's. One full outer join."""
    values = [c for c in target.columns if c not in keys]
    new = rows.select(*keys, F.struct(*values).alias("new"))
    both = target.select(*keys, F.struct(*values).alias("old")).join(new, keys, "full_outer")
    return both.withColumn("v", F.coalesce("new", "old")).select(*keys, "v.*")


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows whose key the target lacks, the first of each key; target rows stay."""
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
    return target.unionByName(first.join(target.select(*keys), keys, "left_anti").select(target.columns))


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def observe(state: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """NEW, CHANGED or NOT_MODIFIED per record of the batch; unseen records are kept as UNSEEN.
    first_seen stays, last_seen moves. State and batch: keys, hash, day (state: first, last)."""
    s = state.select(*keys, F.col("hash").alias("old_hash"), "first_seen", F.col("last_seen").alias("old_last"))
    b = batch.select(*keys, F.col("hash").alias("new_hash"), "day")
    j = s.join(b, keys, "full_outer")
    action = F.when(F.col("new_hash").isNull(), "UNSEEN").when(F.col("old_hash").isNull(), "NEW").when(F.col("old_hash") != F.col("new_hash"), "CHANGED").otherwise("NOT_MODIFIED")
    return j.select(*keys, action.alias("action"), F.coalesce("first_seen", "day").alias("first_seen"), F.coalesce("day", "old_last").alias("last_seen"), F.coalesce("new_hash", "old_hash").alias("hash"))


def presence(state: DataFrame, seen: DataFrame, keys: list[str], allowed: Column) -> DataFrame:
    """Seen records reset; the others count up if the run may mark rows missing, and are confirmed
    missing at three. A degraded run leaves them as they were."""
    j = state.join(seen.select(*keys).distinct().withColumn("_seen", F.lit(True)), keys, "left")
    n = F.when(F.col("_seen"), 0).when(allowed, F.col("missing_run_count") + 1).otherwise(F.col("missing_run_count"))
    st = F.when(F.col("_seen"), "SEEN").when(~allowed | (F.col("presence_state") == "CONFIRMED_MISSING"), F.col("presence_state")).when(F.col("missing_run_count") + 1 >= 3, "CONFIRMED_MISSING").otherwise("MISSING_CANDIDATE")
    return j.select(*keys, st.alias("presence_state"), n.alias("missing_run_count"))


def publish(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """(call_id, hash, version_number, action): a known hash of a call reuses its version
    (REUSED), a new one gets the next number (CREATED). Both: call_id, hash; known: version_number;
    incoming: ord."""
    top = known.groupBy("call_id").agg(F.max("version_number").alias("top"))
    fresh = incoming.withColumn("_r", F.row_number().over(Window.partitionBy("call_id", "hash").orderBy("ord"))).filter("_r = 1").drop("_r")
    j = fresh.join(known.groupBy("call_id", "hash").agg(F.min("version_number").alias("had")), ["call_id", "hash"], "left").join(top, "call_id", "left")
    nth = F.sum(F.when(F.col("had").isNull(), 1).otherwise(0)).over(Window.partitionBy("call_id").orderBy("ord", "hash").rowsBetween(Window.unboundedPreceding, 0))
    return j.select("call_id", "hash", F.coalesce("had", F.coalesce("top", F.lit(0)) + nth).cast("long").alias("version_number"), F.when(F.col("had").isNull(), "CREATED").otherwise("REUSED").alias("action"))
