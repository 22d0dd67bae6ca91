"""Funding arithmetic in integer minor units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(df: DataFrame) -> DataFrame:
    """Status, reasons and amounts per (project, scenario). The first failing check wins; missing
    amounts ask for information and are never taken as zero; grants are rounded down."""
    d = lambda c: F.col(c).cast("decimal(38,0)")
    gap = lambda c, name: F.when(F.col(c).isNull(), f"MISSING_{name}")
    missing = F.array_compact(F.array(gap("eligible_minor", "ELIGIBLE_COSTS"), gap("ineligible_minor", "INELIGIBLE_COSTS"), gap("vat_minor", "NONRECOVERABLE_VAT"), gap("total_minor", "TOTAL_PROJECT_COST"), gap("rate_bps", "SUPPORT_RATE_MAX")))
    raw = F.floor(d("eligible_minor") * F.col("rate_bps") / F.lit(10_000)).cast("bigint")
    df = df.withColumn("missing", missing).withColumn("grant", F.least(raw, "cap_minor"))  # least skips nulls
    info, err, off = "NEEDS_INFORMATION", "ERROR", "SCENARIO_NOT_APPLICABLE"
    checks = [
        (F.col("has_group") & F.col("group_result").isNull(), info, F.lit("SCENARIO_CONDITION_GROUP_RESULT_MISSING")),
        (F.col("has_group") & (F.col("group_result") == "UNKNOWN"), info, F.lit("SCENARIO_APPLICABILITY_UNKNOWN")),
        (F.col("has_group") & (F.col("group_result") == "FAIL"), off, F.lit("SCENARIO_CONDITIONS_FAIL")),
        (F.col("instrument") != "GRANT", "INSTRUMENT_NOT_SUPPORTED", F.concat(F.lit("INSTRUMENT_"), "instrument", F.lit("_REQUIRES_SPECIALIZED_ENGINE"))),
        (F.col("currency") != F.col("scenario_currency"), err, F.lit("CURRENCY_MISMATCH")),
        (F.col("applicability") == "FAIL", off, F.lit("SCENARIO_CONDITIONS_FAIL")),
        (F.col("applicability") == "UNKNOWN", info, F.lit("SCENARIO_APPLICABILITY_UNKNOWN")),
        (F.size("missing") > 0, info, F.array_join("missing", ",")),
        (d("eligible_minor") + d("ineligible_minor") + d("vat_minor") != d("total_minor"), err, F.lit("PROJECT_COST_COMPONENTS_DO_NOT_SUM_TO_TOTAL")),
        (F.col("total_minor") < F.col("cost_min_minor"), off, F.lit("PROJECT_COST_BELOW_MINIMUM")),
        (F.col("total_minor") > F.col("cost_max_minor"), off, F.lit("PROJECT_COST_ABOVE_MAXIMUM")),
        (F.col("grant") < F.col("min_minor"), off, F.lit("CALCULATED_GRANT_BELOW_MINIMUM")),
    ]
    status, reason = F.lit("COMPLETE"), F.when(F.col("payment_mode") == "UNKNOWN", "PREFINANCING_RULE_UNKNOWN").otherwise("")
    for when, s, r in reversed(checks):
        status, reason = F.when(when, s).otherwise(status), F.when(when, r).otherwise(reason)
    df = df.withColumn("status", status).withColumn("reasons", reason)
    ok = F.col("status") == "COMPLETE"
    own = F.col("eligible_minor") - F.col("grant")
    return df.withColumns({
        "max_grant": F.when(ok, F.col("grant")),
        "own_eligible": F.when(ok, own),
        "minimum_cash": F.when(ok, own + F.col("ineligible_minor") + F.col("vat_minor")),
        "prefinancing": F.when(ok & (F.col("payment_mode") == "REIMBURSEMENT") & ~F.col("advance_allowed"), F.col("total_minor")),
    })


def choose(df: DataFrame, by: list[str]) -> DataFrame:
    """One decision per ``by`` over its scenarios. A scenario's stored applicability is combined
    with its condition group's result where it has a group (FAIL before UNKNOWN before PASS; a
    missing result is UNKNOWN). Duplicate ids are an error, more than one pass or any unknown needs
    information, exactly one pass is complete, none is not applicable."""
    group = F.when(F.col("has_group"), F.coalesce("group_result", F.lit("UNKNOWN"))).otherwise("PASS")
    either = lambda r: (F.col("applicability") == r) | (group == r)
    a = F.when(either("FAIL"), "FAIL").when(either("UNKNOWN"), "UNKNOWN").otherwise("PASS")
    out = df.withColumn("a", a).groupBy(*by).agg(
        F.count("*").alias("n"), F.countDistinct("scenario_id").alias("ids"), F.count_if(F.col("a") == "PASS").alias("passed"), F.count_if(F.col("a") == "UNKNOWN").alias("unknown"),
        F.bool_or(F.col("has_group") & F.col("group_result").isNull()).alias("missing_group"), F.min(F.when(F.col("a") == "PASS", F.col("scenario_id"))).alias("only"),
    )
    ladder = [
        (F.col("ids") < F.col("n"), "ERROR", F.lit("DUPLICATE_SCENARIO_ID")),
        (F.col("passed") > 1, "NEEDS_INFORMATION", F.lit("MULTIPLE_APPLICABLE_SCENARIOS")),
        (F.col("unknown") > 0, "NEEDS_INFORMATION", F.when(F.col("missing_group"), "SCENARIO_CONDITION_GROUP_RESULT_MISSING").otherwise("SCENARIO_APPLICABILITY_UNKNOWN")),
        (F.col("passed") == 1, "COMPLETE", F.lit("")),
    ]
    status, reason = F.lit("SCENARIO_NOT_APPLICABLE"), F.lit("NO_APPLICABLE_SCENARIO")
    for when, s, r in reversed(ladder):
        status, reason = F.when(when, s).otherwise(status), F.when(when, r).otherwise(reason)
    return out.withColumn("status", status).withColumn("reason", reason).withColumn("scenario_id", F.when(F.col("status") == "COMPLETE", F.col("only"))).select(*by, "status", "reason", "scenario_id", "passed", "unknown")
