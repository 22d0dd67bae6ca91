"""Differences of consecutive versions, watches and notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantloom.functions.normalize import stable_id

SEVERITY = {"CRITICAL": 0, "IMPORTANT": 1, "INFORMATIONAL": 2, "EDITORIAL": 3}
#: field path, new column, old column, change type, severity
SCALARS = [
    ("deadlines.application_open", "open_at", "old_open_at", "DEADLINE_CHANGED", "CRITICAL"),
    ("deadlines.application_close", "close_at", "old_close_at", "DEADLINE_CHANGED", "CRITICAL"),
    ("eligibility.applicant_rules", "rules", "old_rules", "APPLICANT_RULE_CHANGED", "CRITICAL"),
    ("title", "title", "old_title", "OTHER", "EDITORIAL"),
    ("summary", "summary", "old_summary", "OTHER", "EDITORIAL"),
    ("funding.support_rate_max_bps", "rate_bps", "old_rate_bps", "FUNDING_CHANGED", "CRITICAL"),
    ("funding.grant_amount_max_minor", "cap_minor", "old_cap_minor", "FUNDING_CHANGED", "CRITICAL"),
]


def scalar_changes() -> Column:
    """An array of what changed in a step (new columns beside ``old_`` ones), a struct per field."""
    event = lambda path, kind, severity, old, new: F.when(~old.eqNullSafe(new), F.struct(F.lit(path).alias("field_path"), F.lit(kind).alias("change_type"), severity.alias("severity"), old.cast("string").alias("old_value"), new.cast("string").alias("new_value")))
    status = F.when(F.col("status").isin("PAUSED", "CLOSED", "CANCELLED"), "CRITICAL").otherwise("IMPORTANT")
    all_ = [event("status", "STATUS_CHANGED", status, F.col("old_status"), F.col("status"))]
    all_ += [event(path, kind, F.lit(sev), F.col(old), F.col(new)) for path, new, old, kind, sev in SCALARS]
    return F.array_compact(F.array(*all_))


def event_id() -> Column:
    """What an event is called; it follows from its other columns."""
    return stable_id(F.col("call_id"), F.col("version_number"), F.col("field_path"), F.col("change_type"))


def scalar_events(steps: DataFrame, *more: str) -> DataFrame:
    """One row per changed field of each step, with its columns ``more``."""
    out = steps.filter("old_number is not null").select("call_id", "version_number", *more, F.explode(scalar_changes()).alias("e")).select("call_id", "version_number", "e.*", *more)
    return out.withColumn("event_id", event_id())


def event_order(steps: DataFrame) -> DataFrame:
    """(call_id, version_number, field_path, place): a step's events by severity and field. A field
    changes once a step, so they are sorted within the step's row."""
    at = F.array_sort(F.transform(scalar_changes(), lambda e: F.struct(severity_rank(e["severity"]).alias("rank"), e["field_path"].alias("field_path"))))
    out = steps.filter("old_number is not null").select("call_id", "version_number", F.posexplode(at).alias("pos", "e"))
    return out.select("call_id", "version_number", "e.field_path", (F.col("pos") + 1).alias("place"))


def keyed_steps(rows: DataFrame, newest: DataFrame, key: str, value: str) -> DataFrame:
    """(call_id, version_number, <key>, change, old_value, new_value): what each version adds, removes
    or changes against the one before. ``rows``: (call_id, version_number, <key>, <value>), one per
    thing a version has; ``newest``: (call_id, newest), versions being numbered from 1. A thing's
    own versions tell all, so its rows are sorted once and nothing is joined with itself."""
    w = Window.partitionBy("call_id", key).orderBy("version_number")
    at = F.struct(F.col("version_number").alias("v"), F.col(value).alias("x"))
    step = rows.join(newest, "call_id").select("call_id", key, "newest", at.alias("at"), F.lag(at).over(w).alias("old"), F.lead("version_number").over(w).alias("following"))
    event = lambda kind, v, old, new: F.struct(F.lit(kind).alias("change"), v.alias("version_number"), old.cast("string").alias("old_value"), new.cast("string").alias("new_value"))
    v, none = F.col("at.v"), F.lit(None)
    before, after = F.coalesce(F.col("old.v") == v - 1, F.lit(False)), F.coalesce(F.col("following") == v + 1, F.lit(False))
    events = [
        F.when(~before & (v > 1), event("ADDED", v, none, F.col("at.x"))),
        F.when(before & ~F.col("old.x").eqNullSafe(F.col("at.x")), event("CHANGED", v, F.col("old.x"), F.col("at.x"))),
        F.when(~after & (v < F.col("newest")), event("REMOVED", v + 1, F.col("at.x"), none)),
    ]
    out = step.select("call_id", key, F.explode(F.array_compact(F.array(*events))).alias("event"))
    return out.select("call_id", "event.version_number", key, "event.change", "event.old_value", "event.new_value")


def drift_row(field: Column, before: Column, after: Column) -> Column:
    return F.struct(field.alias("field"), before.cast("string").alias("before"), after.cast("string").alias("after"))


def keyed_drift(old: Column, new: Column, key: str, value: str, prefix: str, removed: bool) -> Column:
    """An array of rows (field, before, after): what ``new``, an array of structs with ``key`` and ``value``, adds or
    changes against ``old`` and, where ``removed`` is to be told, what it lacks. A key stands once in each."""
    none, name = F.lit(None), lambda x: F.concat(F.lit(prefix), x[key])
    of = lambda rows, x: F.filter(rows, lambda y: y[key] == x[key])
    added = F.transform(F.filter(new, lambda x: F.size(of(old, x)) == 0), lambda x: drift_row(name(x), none, x[value]))
    differs = lambda x: F.exists(old, lambda y: (y[key] == x[key]) & ~y[value].eqNullSafe(x[value]))
    changed = F.transform(F.filter(new, differs), lambda x: drift_row(name(x), of(old, x)[0][value], x[value]))
    gone = F.transform(F.filter(old, lambda y: F.size(of(new, y)) == 0), lambda y: drift_row(name(y), y[value], none))
    return F.concat(added, changed, gone) if removed else F.concat(added, changed)


def version_drift(versions: DataFrame) -> DataFrame:
    """(workspace_id, call_id, baseline, current, source, field, before, after) where a call has a newer
    version than a workspace was begun on: the events recorded between these two versions, else the
    differences of close date, status and requirements. A requirement that the newer version lacks is
    never told as removed, as a source may have left it out.

    ``versions``: (call_id, version_number, workspaces, close_at, status, requirements, told), one row
    each: the ids of the workspaces begun on it, an array of (requirement_id, title, necessity), and of the
    events (field, before, after) against the version before. A call's versions are dealt by call
    once, and the newest of them goes along with every other; nothing is joined."""
    col = F.col
    call = Window.partitionBy("call_id")
    newest = F.max_by(F.struct("version_number", "close_at", "status", "requirements", "told"), "version_number").over(call)
    moved = versions.withColumn("new", newest).filter("version_number <> new.version_number and size(workspaces) > 0")
    recorded = F.when(col("new.version_number") == col("version_number") + 1, col("new.told"))
    fields = [F.when(~col(c).eqNullSafe(col(f"new.{c}")), drift_row(F.lit(name), col(c), col(f"new.{c}"))) for c, name in (("close_at", "submissionCloseAt"), ("status", "status"))]
    old = lambda x: F.filter(col("requirements"), lambda y: y["requirement_id"] == x["requirement_id"])
    need = lambda x: F.when(F.size(old(x)) == 0, drift_row(F.lit("requirementAddedUnverified"), F.lit(None), x["title"])).when(old(x)[0]["necessity"] != x["necessity"], drift_row(F.lit("requirementNecessityUnverified"), old(x)[0]["necessity"], x["necessity"]))
    plain = F.array_compact(F.concat(F.array(*fields), F.transform("new.requirements", need)))
    known = F.coalesce(F.size(recorded) > 0, F.lit(False))
    out = moved.select("call_id", col("version_number").alias("baseline"), col("new.version_number").alias("current"), "workspaces", F.when(known, "RECORDED").otherwise("FALLBACK").alias("source"), F.explode(F.when(known, recorded).otherwise(plain)).alias("diff"))
    return out.select(F.explode("workspaces").alias("workspace_id"), "call_id", "baseline", "current", "source", "diff.field", "diff.before", "diff.after")


def severity_rank(c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), c)


BANDS = {"WEAK": 0, "POSSIBLE": 1, "VERY_GOOD": 2}


def band_rank(c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in BANDS.items() for x in kv]), c)


def watch_status(df: DataFrame) -> DataFrame:
    """Relevance first, then eligibility, then finance; with reasons and the candidate flag."""
    e, f = F.col("eligibility"), F.col("finance")
    status = (
        F.when(~F.col("enabled"), "NOT_RELEVANT").when(band_rank(F.col("band")) < band_rank(F.col("minimum_band")), "NOT_RELEVANT")
        .when(e == "INELIGIBLE", "NOT_ELIGIBLE").when(e == "NEEDS_REVIEW", "NEEDS_REVIEW").when(e.isNull() | (e == "NEEDS_INFORMATION"), "NEEDS_INFORMATION")
        .when(f == "SCENARIO_NOT_APPLICABLE", "NOT_FINANCIALLY_COMPATIBLE").when(f.isin("ERROR", "INSTRUMENT_NOT_SUPPORTED"), "NEEDS_REVIEW").when(f.isNull() | (f == "NEEDS_INFORMATION"), "NEEDS_INFORMATION")
        .otherwise("MATCHED")
    )
    df = df.withColumn("status", status)
    reasons = F.array(F.concat(F.lit("RELEVANCE_"), "band"), F.concat(F.lit("WATCH_STATUS_"), "status"), F.coalesce(F.concat(F.lit("ELIGIBILITY_"), e), F.lit("ELIGIBILITY_NOT_EVALUATED")), F.coalesce(F.concat(F.lit("FINANCE_"), f), F.lit("FINANCE_NOT_EVALUATED")))
    return df.withColumn("reasons", F.array_distinct(reasons)).withColumn("candidate", F.col("status").isin("MATCHED", "NEEDS_INFORMATION"))
