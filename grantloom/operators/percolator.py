"""Watches found by the versions that they ask for: stored intents, probed by what has changed.

Searches go from one text to many documents; here a changed document looks up the many intents.
An intent's token of three letters or more matches any word that begins with it, so a version probes
with its words and their beginnings, by equality: no version meets an intent without a common token.
Watches of one intent share its row until the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantloom.operators.changes import watch_status
from grantloom.operators.search import ACTIVE, hybrid, tokens

FIRST, PREFIX = 20, 3


def intent_index(watches: DataFrame, first: int = FIRST) -> DataFrame:
    """(token, intent, n): the distinct intents of enabled watches by their first tokens; ``n`` is an
    intent's number of tokens, equal ones counted each."""
    own = watches.filter("enabled").select("intent").distinct().withColumn("ts", F.slice(tokens(F.col("intent")), 1, first))
    each = own.select("intent", F.size("ts").alias("n"), F.explode("ts").alias("token"))
    return each.groupBy("intent", "n", "token").agg(F.count("*").alias("times")).select("token", "intent", "n", "times")


def probes(versions: DataFrame, *more: str) -> DataFrame:
    """(call_id, version_number, token): distinct words of each searchable version and their
    beginnings; all within the row; with its columns ``more``."""
    words = F.array_distinct(tokens(F.col("text")))
    begins = F.transform(words, lambda w: F.when(F.length(w) < PREFIX, F.array(w)).otherwise(F.transform(F.sequence(F.lit(PREFIX), F.greatest(F.length(w), F.lit(PREFIX))), lambda k: F.substring(w, F.lit(1), k))))
    rows = versions.filter(F.col("status").isin(ACTIVE))
    return rows.select("call_id", "version_number", *more, F.explode(F.array_distinct(F.flatten(begins))).alias("token"))


def found(versions: DataFrame, index: DataFrame, *more: str) -> DataFrame:
    """(intent, call_id, version_number, coverage) of every intent with any hit, with the versions' columns
    ``more``; coverage is the share of the intent's tokens that hit."""
    each = probes(versions, *more).join(index, "token").groupBy("intent", "call_id", "version_number", *more)
    return each.agg(F.round(F.sum("times") / F.first("n"), 6).alias("coverage"))


def fanned(matches: DataFrame, watches: DataFrame, *more: str) -> DataFrame:
    """``matches`` of intents told to every enabled watch of the intent, with the watch's columns ``more``.
    They are by far more rows than before, so what is to be known of a watch is to come along here:
    a join by watch afterwards would deal them all."""
    return matches.join(watches.filter("enabled").select("watch_id", "intent", *more), "intent").drop("intent")


def percolate(versions: DataFrame, watches: DataFrame, index: DataFrame, *more: str) -> DataFrame:
    """(watch_id, call_id, version_number, coverage) of every enabled watch with any hit, with the
    watches' columns ``more``."""
    return fanned(found(versions, index), watches, *more).select("watch_id", "call_id", "version_number", "coverage", *more)


def watched(watches: DataFrame, now: DataFrame) -> DataFrame:
    """``watches`` (watch_id, enabled, intent) that are still there, with ``now``, a struct of enabled and
    minimum_band as they are when hits are judged."""
    return watches.select("watch_id", "enabled", "intent").join(now.select("watch_id", F.struct("enabled", "minimum_band").alias("now")), "watch_id")


def once(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` whose ``columns`` are worked out once a row; as plain columns they would be put into each
    expression and filter that reads them."""
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*columns))))


def match_key() -> Column:
    return F.concat(F.lit("watch:"), "watch_id", F.lit(":call:"), "call_id", F.lit(":version:"), "version_number", F.lit(":status:"), "status")


def judged(hits: DataFrame) -> DataFrame:
    """Hits (watch_id, call_id, version_number, coverage, eligibility, finance, now) with band, status,
    reasons, candidate, whether a user is told, and the match's key; row by row."""
    df = hybrid(hits.select("*", "now.*").withColumns({"lexical": F.col("coverage"), "ontology": F.lit(0.0), "semantic": F.lit(None).cast("double")})).drop("reasons")
    return watch_status(df).withColumn("dedupe_key", match_key()).drop("enabled", "minimum_band", "lexical", "ontology", "semantic", "score")


def action(before: str, now: str) -> Column:
    """CREATED where there is no key before, UNCHANGED where it is the same, else UPDATED."""
    return F.when(F.col(before).isNull(), "CREATED").when(F.col(before) == F.col(now), "UNCHANGED").otherwise("UPDATED")


def actions(now: DataFrame, last: DataFrame) -> DataFrame:
    """``now`` with ``action``: CREATED without an earlier match of watch and call, UNCHANGED where the
    latest one has the same key, else UPDATED. ``last``: (watch_id, call_id, place, dedupe_key), of
    which the greatest place counts."""
    latest = last.groupBy("watch_id", "call_id").agg(F.max_by("dedupe_key", F.struct("place", "dedupe_key")).alias("before"))
    return now.join(latest, ["watch_id", "call_id"], "left").withColumn("action", action("before", "dedupe_key")).drop("before")


def notifications(acted: DataFrame) -> DataFrame:
    """One row per new or changed match that a user is told of."""
    kind = F.when(F.col("status") == "MATCHED", "NEW_MATCHING_GRANT").otherwise("MATCH_NEEDS_INFORMATION")
    severity = F.when(F.col("status") == "MATCHED", "IMPORTANT").otherwise("INFO")
    return acted.filter("candidate and action <> 'UNCHANGED'").select("watch_id", "call_id", "version_number", kind.alias("kind"), severity.alias("severity"), F.concat(F.lit("watch-match:"), "dedupe_key").alias("dedupe_base"))
