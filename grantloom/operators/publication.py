"""From staged candidates to published versions: gates, conflicts, pointers, evidence, quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(ladder: list[tuple[Column, str]], rest: str | None = None) -> Column:
    """The word of the first condition that holds."""
    out = F.lit(rest).cast("string")
    for when, word in reversed(ladder):
        out = F.when(when, word).otherwise(out)
    return out


def all_of(rules: list[tuple[Column, str]]) -> Column:
    """The words of all conditions that hold, in order; unknown ones do not."""
    return F.array_compact(F.array(*[F.when(when, F.lit(word)) for when, word in rules]))


def artifact_state(observed: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, state, sha, previous_sha. Observed rows have (answer: MODIFIED, NOT_MODIFIED or GONE;
    sha); NOT_MODIFIED without a cached row, or MODIFIED without content, is an ERROR."""
    df = observed.join(cache.select(*keys, F.col("sha").alias("previous_sha"), F.lit(True).alias("had")), keys, "left")
    had, a = F.coalesce("had", F.lit(False)), F.col("answer")
    state = first_of([((a == "NOT_MODIFIED") & ~had, "ERROR"), (a == "NOT_MODIFIED", "REUSED"), (a == "GONE", "GONE"), (F.col("sha").isNull(), "ERROR")], "MODIFIED")
    df = df.withColumn("state", state)
    return df.select(*keys, "state", F.when(F.col("state") == "REUSED", F.col("previous_sha")).when(F.col("state") == "MODIFIED", F.col("sha")).alias("sha"), "previous_sha")


def staging_gate(candidates: DataFrame, staged: DataFrame, identity: list[str]) -> DataFrame:
    """``identity``, state, error: the first candidate of an identity counts (by ``ord``). What is PUBLISHED
    stays so; VALID needs provenance to be READY, INVALID is REJECTED, anything else is STAGED."""
    once = candidates.withColumn("nth", F.row_number().over(Window.partitionBy(*identity).orderBy("ord"))).filter("nth = 1")
    df = once.join(staged.filter("state = 'PUBLISHED'").select(*identity).distinct().withColumn("out", F.lit(True)), identity, "left")
    lacking = (F.col("validation") == "VALID") & (F.col("provenance") == "MISSING")
    state = first_of([(F.coalesce("out", F.lit(False)), "PUBLISHED"), (lacking, "STAGED"), (F.col("validation") == "VALID", "READY"), (F.col("validation") == "INVALID", "REJECTED")], "STAGED")
    return df.select(*identity, state.alias("state"), F.when(lacking & F.col("out").isNull(), "PROVENANCE_MISSING").alias("error"))


def quarantined(rows: DataFrame, reasons: list[tuple[Column, str]], created: str) -> tuple[DataFrame, DataFrame]:
    """The rows without a reason, and the others with their first reason and their place in the
    order of ``created`` among those of the reason."""
    df = rows.withColumn("reason", first_of(reasons))
    bad = df.filter("reason is not null").withColumn("place", F.row_number().over(Window.partitionBy("reason").orderBy(created, *[c for c in rows.columns if c != created])))
    return df.filter("reason is null").drop("reason"), bad


def conflicts(candidates: DataFrame, calls: DataFrame, programmes: DataFrame, records: DataFrame, legacy: list[tuple[str, str]]) -> DataFrame:
    """(candidate_id, error): why a candidate must not be published, null if it may. Candidates:
    (candidate_id, state, call_id, slug, programme_id, source_id, external_id, sha, title);
    calls: (call_id, slug, programme_id); records: (source_id, external_id, sha). A programme may
    change along the ``legacy`` pairs of prefixes only."""
    owner = calls.select("slug", F.col("call_id").alias("owner"))
    own = calls.select("call_id", F.col("slug").alias("old_slug"), F.col("programme_id").alias("old_programme"))
    df = candidates.join(owner, "slug", "left").join(own, "call_id", "left").join(programmes.select("programme_id", F.lit(True).alias("known")), "programme_id", "left")
    df = df.join(records.select("source_id", "external_id", F.col("sha").alias("record_sha"), F.lit(True).alias("seen")), ["source_id", "external_id"], "left")
    moved = reduce(lambda a, b: a | b, [F.col("old_programme").startswith(x) & F.col("programme_id").startswith(y) for x, y in legacy], F.lit(False))
    error = first_of([
        (F.col("state") != "READY", "CANDIDATE_NOT_READY"), (F.trim("title") == "", "PAYLOAD_INVALID"), (F.col("seen").isNull(), "SOURCE_RECORD_MISSING"), (~F.col("record_sha").eqNullSafe(F.col("sha")), "SOURCE_RECORD_MISMATCH"),
        (F.col("known").isNull(), "PROGRAMME_MISSING"), (F.col("owner") != F.col("call_id"), "IDENTITY_CONFLICT"), (F.col("old_slug") != F.col("slug"), "IDENTITY_CONFLICT"), ((F.col("old_programme") != F.col("programme_id")) & ~moved, "IDENTITY_CONFLICT"),
    ])
    return df.select("candidate_id", error.alias("error"))


def pointers(observed: DataFrame) -> DataFrame:
    """(call_id, ord, sha, version_number, action, changed, activation): observed contents of calls in
    order (ord). A new hash gets the next version number, a known one its own; the current version
    moves with each row, back to an older version too (REACTIVATED). ``activation`` counts how often
    the version has become the current one."""
    call = Window.partitionBy("call_id").orderBy("ord")
    df = observed.withColumn("first", F.min("ord").over(Window.partitionBy("call_id", "sha"))).withColumn("new", F.col("first") == F.col("ord"))
    df = df.withColumn("made", F.count_if("new").over(call.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.lag("sha").over(call))
    df = df.withColumn("version_number", F.min(F.when(F.col("new"), F.col("made"))).over(Window.partitionBy("call_id", "sha")))
    action = first_of([(F.col("new"), "CREATED"), (F.col("before") == F.col("sha"), "UNCHANGED")], "REACTIVATED")
    df = df.withColumn("action", action).withColumn("changed", F.col("action") != "UNCHANGED")
    return df.withColumn("activation", F.count_if("changed").over(Window.partitionBy("call_id", "sha").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))).select("call_id", "ord", "sha", "version_number", "action", "changed", "activation")


def outbox(moves: DataFrame) -> DataFrame:
    """(call_id, version_number, kind, dedupe_key): two jobs for every move of a pointer; the key of
    a version that comes back has its activation at the end."""
    kind = F.explode(F.array(F.lit("SEARCH_REINDEX"), F.lit("CHANGE_DETECTION"))).alias("kind")
    each = moves.filter("changed").select("call_id", "version_number", "activation", kind)
    key = F.concat_ws(":", "kind", "call_id", "version_number", F.when(F.col("activation") > 1, F.concat(F.lit("activation-"), F.col("activation").cast("string"))))
    return each.select("call_id", "version_number", "kind", key.alias("dedupe_key"))


def evidence(rows: DataFrame, keys: list[str], fields: dict[str, str], normalisation: Column) -> DataFrame:
    """``keys``, field_path, normalisation, label: a row per present field; of a field's automatic
    evidence only the newest normalisation is CURRENT, older ones are SUPERSEDED."""
    items = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.struct(F.lit(p).alias("field_path"), F.col(c).cast("string").alias("value"))) for p, c in fields.items()]))
    df = rows.select(*keys, normalisation.alias("normalisation"), F.explode(items).alias("x")).select(*keys, "normalisation", "x.field_path", "x.value")
    newest = F.max("normalisation").over(Window.partitionBy(*keys, "field_path"))
    return df.withColumn("label", F.when(F.col("normalisation") < newest, "SUPERSEDED").otherwise("CURRENT"))


def gate(df: DataFrame) -> DataFrame:
    """A run's gate: ``violations``, ``status`` and ``destructive``; a rate without attempts is unknown
    and breaks nothing. Over structure_changed, n, median, seen, http_errors, http_requests,
    parse_failures, parse_attempts, validation_failures, validation_attempts."""
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    rules = [
        (F.col("structure_changed"), "UNEXPECTED_STRUCTURE_CHANGE"), ((F.col("n") >= 3) & (F.col("median") > 0) & (F.col("seen") < F.col("median") * 0.35), "RECORD_COUNT_COLLAPSE"),
        (rate("http_errors", "http_requests") > 0.20, "HTTP_ERROR_RATE_HIGH"), (1 - rate("parse_failures", "parse_attempts") < 0.85, "PARSE_SUCCESS_LOW"), (1 - rate("validation_failures", "validation_attempts") < 0.85, "VALIDATION_SUCCESS_LOW"),
    ]
    df = df.withColumn("violations", all_of(rules))
    return df.withColumn("status", F.when(F.size("violations") > 0, "DEGRADED").otherwise("HEALTHY")).withColumn("destructive", F.size("violations") == 0)


HARD = ["DIRECT_HEALTHCHECK_UNAVAILABLE", "LAST_SUCCESS_STALE", "NEVER_SUCCEEDED"]


def health(df: DataFrame, now: Column, interval_days: int, after: int, grace_days: int) -> DataFrame:
    """A source's ``reasons`` and ``health`` over probe_ok, expected, last_run, last_success (dates) and
    degraded."""
    old = F.date_sub(now, interval_days * after + grace_days)
    missed = (now > F.date_add("expected", grace_days)) & (F.col("last_run").isNull() | (F.col("last_run") < F.col("expected")))
    stale = F.when(F.col("last_success").isNull(), F.col("last_run").isNotNull()).otherwise(F.col("last_success") < old)
    rules = [
        (~F.col("probe_ok"), HARD[0]), (F.col("last_run").isNull(), "NEVER_RUN"), (F.col("last_run").isNotNull() & F.col("last_success").isNull(), HARD[2]),
        (missed, "SCHEDULED_RUN_MISSED"), (stale, HARD[1]), (F.col("degraded"), "QUALITY_GATE_DEGRADED"),
    ]
    df = df.withColumn("reasons", all_of(rules))
    return df.withColumn("health", F.when(F.arrays_overlap("reasons", F.array(*[F.lit(h) for h in HARD])), "UNAVAILABLE").when(F.size("reasons") > 0, "DEGRADED").otherwise("HEALTHY"))


def ontology_issues(terms: DataFrame, synonyms: DataFrame, edges: DataFrame, hops: int = 16) -> DataFrame:
    """(issue, subject): repeated codes and synonyms, edges with an unknown end or a weight (percent)
    outside (0, 100], and terms that a path of at most ``hops`` BROADER edges leads back to. Paths
    are doubled, each step one equi-join on distinct ends."""
    twice = lambda df, c, issue: df.groupBy(F.col(c).alias("subject")).count().filter("count > 1").select(F.lit(issue).alias("issue"), "subject")
    known = terms.select(F.col("code").alias("end")).distinct()
    name = F.concat_ws(">", "src", "dst").alias("subject")
    ends = edges.select("src", "dst", F.explode(F.array("src", "dst")).alias("end")).join(known, "end", "left_anti").select(F.lit("DANGLING_EDGE").alias("issue"), name).distinct()
    weight = edges.filter("pct is null or pct <= 0 or pct > 100").select(F.lit("WEIGHT_OUT_OF_RANGE").alias("issue"), name).distinct()
    reach = edges.filter("relation = 'BROADER'").select("src", "dst").distinct()
    for _ in range((hops - 1).bit_length()):
        further = reach.join(reach.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").select("src", F.col("end").alias("dst"))
        reach = reach.union(further).distinct()
    cycle = reach.filter("src = dst").select(F.lit("BROADER_CYCLE").alias("issue"), F.col("src").alias("subject"))
    return twice(terms, "code", "DUPLICATE_TERM").union(twice(synonyms, "name", "DUPLICATE_SYNONYM")).union(ends).union(weight).union(cycle)


def awards(grants: DataFrame, decisions: DataFrame, recipients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Historical awards, and rejects with a reason. Grants: (grant_id, title, recipient_id);
    decisions: (grant_id, amount_minor, returnable, year, decided_at); recipients: (recipient_id,
    name, ord), the last of an id counts. Only non-returnable decisions are summed."""
    who = recipients.groupBy("recipient_id").agg(F.max_by("name", "ord").alias("recipient"))
    money = decisions.groupBy("grant_id").agg(F.count_if(~F.col("returnable")).alias("n"), F.sum(F.when(~F.col("returnable"), F.col("amount_minor"))).alias("amount_minor"), F.max(F.when(~F.col("returnable"), F.col("year"))).alias("year"), F.max(F.when(~F.col("returnable"), F.col("decided_at"))).alias("decided_at"), F.count("*").alias("decisions"))
    df = grants.join(who, "recipient_id", "left").join(money, "grant_id", "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    df = df.withColumn("reason", first_of([(F.col("grant_id").isNull(), "MISSING_ID"), (blank("title"), "MISSING_TITLE"), (blank("recipient"), "MISSING_RECIPIENT"), (F.coalesce("decisions", F.lit(0)) == 0, "NO_DECISION"), (F.col("n") == 0, "RETURNABLE_AID_ONLY")]))
    good = df.filter("reason is null").select("grant_id", "title", "recipient", "amount_minor", "year", "decided_at")
    return good, df.filter("reason is not null").select("grant_id", "reason")


STATUSES = "DRAFT ANNOUNCED PLANNED OPEN PAUSED CLOSED CANCELLED ARCHIVED".split()


def validated(calls: DataFrame) -> DataFrame:
    """``calls`` (of all sources) with ``reasons`` and ``valid``: status, verification, content hash,
    retrieval mode and currency, each of its known form (fixed values)."""
    known = lambda c, *words: F.coalesce(F.col(c).isin(*words), F.lit(False))
    rules = [
        (~known("status", *STATUSES), "STATUS"), (~known("verification", "VERIFIED", "PARTIALLY_VERIFIED", "UNVERIFIED"), "VERIFICATION"), (~F.coalesce(F.col("sha").rlike("^[0-9a-f]{64}$"), F.lit(False)), "CONTENT_HASH"),
        (~known("mode", "HTML", "API", "FILE"), "RETRIEVAL_MODE"), (~known("currency", "CZK", "EUR"), "CURRENCY"),
    ]
    return calls.withColumn("reasons", all_of(rules)).withColumn("valid", F.size("reasons") == 0)


def projection(versions: DataFrame, calls: DataFrame, programmes: DataFrame, providers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(call_id, version_number, status, title, summary, keywords) of current versions: joined with
    programme and provider, and with the newest published payload (by ``ord``), JSON with a summary
    and keywords. Versions: (call_id, version_number, status); older ones are dropped."""
    now = versions.groupBy("call_id").agg(F.max_by(F.struct("version_number", "status"), "version_number").alias("v")).select("call_id", "v.version_number", "v.status")
    new = payloads.groupBy("call_id").agg(F.max_by("payload", "ord").alias("payload"))
    df = now.join(calls, "call_id").join(programmes, "programme_id").join(providers, "provider_id").join(new, "call_id")
    own = lambda key: F.get_json_object("payload", f"$.{key}")
    return df.select("call_id", "version_number", "status", "title", F.coalesce(own("summary"), F.lit("")).alias("summary"), F.concat_ws(" ", own("keywords"), "code", "programme", "provider").alias("keywords"))
