"""Queries of awards (C), publication (D) and quality (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantloom.operators import publication as P
from grantloom.operators import rules as R
from grantloom.plans.upkeep import BASE, baselines
from grantloom.views import duck, sql, view

QUERIES: dict = {}
SQL: dict = {}
col = F.col


def add(name, query, oracle):
    QUERIES[name] = query
    SQL[name] = duck(oracle)


# --- awards: orders are grants, their lines are decisions, customers are recipients

GRANTS = """select case when o_orderkey % 31 = 0 then null else o_orderkey end as grant_id, case when o_orderkey % 17 = 0 then ' ' else concat('Grant ', o_orderpriority) end as title, o_custkey as recipient_id from {orders}"""
DECISIONS = """select l_orderkey as grant_id, cast(round(l_extendedprice * 100) as bigint) as amount_minor, l_returnflag = 'R' as returnable, cast(date_part('year', l_shipdate) as bigint) as year, cast(cast(l_shipdate as date) as string) as decided_at from {lineitem}"""
RECIPIENTS = """select c_custkey as recipient_id, case when c_custkey % 13 = 0 then '' else c_name end as name, 2 as ord from {customer} union all select c_custkey, concat('old ', c_name), 1 from {customer}"""
awarded = lambda s, d: P.awards(sql(s, d, GRANTS), sql(s, d, DECISIONS), sql(s, d, RECIPIENTS))
AWARDED = f"""with g as ({GRANTS}), x as ({DECISIONS}), w as (select c_custkey as recipient_id, case when c_custkey % 13 = 0 then '' else c_name end as recipient from {{customer}}),
    m as (select grant_id, count(*) as decisions, count(*) filter (not returnable) as n, sum(amount_minor) filter (not returnable) as amount_minor, max(year) filter (not returnable) as year, max(decided_at) filter (not returnable) as decided_at from x group by grant_id),
    a as (select g.*, w.recipient, m.n, m.amount_minor, m.year, m.decided_at, case when g.grant_id is null then 'MISSING_ID' when trim(title) = '' then 'MISSING_TITLE' when coalesce(recipient, '') = '' then 'MISSING_RECIPIENT' when decisions is null then 'NO_DECISION' when n = 0 then 'RETURNABLE_AID_ONLY' end as reason
      from g left join w using (recipient_id) left join m on m.grant_id = g.grant_id)"""
add("C5_historical_awards", lambda s, d: awarded(s, d)[0], AWARDED + " select grant_id, title, recipient, amount_minor::bigint as amount_minor, year, decided_at from a where reason is null")
add("C6_award_rejects", lambda s, d: awarded(s, d)[1], AWARDED + " select grant_id, reason from a where reason is not null")

# --- publication

SEEN = """select user_id, event_type, max(event_id) as event_id from {events} group by user_id, event_type"""
OBSERVED = f"""select user_id, event_type, case event_id % 5 when 0 then 'GONE' when 1 then 'NOT_MODIFIED' else 'MODIFIED' end as answer, case when event_id % 11 = 2 then null else sha2(concat('e', cast(event_id as string)), 256) end as sha from ({SEEN}) t"""
CACHE = """select distinct user_id, event_type, sha2(concat('u', cast(user_id as string)), 256) as sha from {events} where user_id % 3 > 0"""
plain = lambda t: t.replace("sha2(", "sha256(").replace(", 256)", ")")
add(
    "D3_artifact_state",
    lambda s, d: P.artifact_state(sql(s, d, OBSERVED), sql(s, d, CACHE), ["user_id", "event_type"]),
    plain(f"""with o as ({OBSERVED}), c as ({CACHE}), x as (select o.*, c.sha as previous_sha, case when answer = 'NOT_MODIFIED' and c.user_id is null then 'ERROR' when answer = 'NOT_MODIFIED' then 'REUSED' when answer = 'GONE' then 'GONE' when o.sha is null then 'ERROR' else 'MODIFIED' end as state from o left join c using (user_id, event_type))
    select user_id, event_type, state, case state when 'REUSED' then previous_sha when 'MODIFIED' then sha end as sha, previous_sha from x"""),
)
STAGED = """select concat('p', cast(p_partkey % 400 as string)) as external_id, p_type as entity_type, cast(p_size % 3 as string) as sha, p_partkey as ord, case p_partkey % 4 when 0 then 'VALID' when 1 then 'VALID' when 2 then 'INVALID' else 'PENDING' end as validation, case when p_size % 5 = 0 then 'MISSING' else 'COMPLETE' end as provenance from {part}"""
OUT = """select concat('p', cast(p_partkey % 400 as string)) as external_id, p_type as entity_type, cast(p_size % 3 as string) as sha, case when p_partkey % 7 = 0 then 'PUBLISHED' else 'READY' end as state from {part}"""
KEY = ["external_id", "entity_type", "sha"]
add(
    "D4_staging_gate",
    lambda s, d: P.staging_gate(sql(s, d, STAGED), sql(s, d, OUT), KEY),
    f"""with c as (select * from (select *, row_number() over (partition by external_id, entity_type, sha order by ord) as n from ({STAGED})) where n = 1), o as (select distinct external_id, entity_type, sha, true as done from ({OUT}) where state = 'PUBLISHED')
    select external_id, entity_type, sha, case when done then 'PUBLISHED' when validation = 'VALID' and provenance = 'MISSING' then 'STAGED' when validation = 'VALID' then 'READY' when validation = 'INVALID' then 'REJECTED' else 'STAGED' end as state,
        case when done is null and validation = 'VALID' and provenance = 'MISSING' then 'PROVENANCE_MISSING' end as error from c left join o using (external_id, entity_type, sha)""",
)
BAD = ["eligible_minor < 0 or total_minor is null|VALIDATION_FAILED", "currency <> 'CZK' and vat_minor is null|SCHEMA_MISMATCH", "project_id % 29 = 0|QUALITY_GATE", "project_id % 23 = 0|DUPLICATE_AMBIGUOUS", "priority like '1%' and project_id % 19 = 0|SECURITY_REJECTED", "eligible_minor is null and vat_minor is null|OTHER"]
bad = [tuple(x.split("|")) for x in BAD]
add(
    "D5_quarantine",
    lambda s, d: P.quarantined(view(s, d, "projects").select("due_at", "project_id", "currency", "total_minor", "eligible_minor", "vat_minor", "priority"), [(F.expr(c), r) for c, r in bad], "due_at")[1].select("project_id", "reason", "place"),
    f"select project_id, reason, row_number() over (partition by reason order by due_at, project_id) as place from (select *, case {' '.join(f'when {c} then {chr(39)}{r}{chr(39)}' for c, r in bad)} end as reason from {{projects}}) where reason is not null",
)
MOVES = "select call_id, version_number as ord, sha256(concat(status, '|', title, '|', summary)) as sha from {versions}"
moves = lambda s, d: P.pointers(view(s, d, "versions").select("call_id", col("version_number").alias("ord"), F.sha2(F.concat_ws("|", "status", "title", "summary"), 256).alias("sha")))
MOVED = f"""with o as ({MOVES}), f as (select call_id, sha, min(ord) as first_ord from o group by call_id, sha), r as (select *, row_number() over (partition by call_id order by first_ord) as version_number from f),
    a as (select o.*, r.version_number, case when o.ord = r.first_ord then 'CREATED' when lag(sha) over (partition by o.call_id order by o.ord) = sha then 'UNCHANGED' else 'REACTIVATED' end as action from o join r using (call_id, sha)),
    m as (select *, action <> 'UNCHANGED' as changed, count(*) filter (action <> 'UNCHANGED') over (partition by call_id, sha order by ord) as activation from a)"""
add("D6_publish_versions", moves, MOVED + " select call_id, ord, sha, version_number, action, changed, activation from m")
add("D9_outbox_rows", lambda s, d: P.outbox(moves(s, d)), MOVED + " select call_id, version_number, kind, concat_ws(':', kind, call_id, version_number, case when activation > 1 then 'activation-' || activation end) as dedupe_key from m, (values ('SEARCH_REINDEX'), ('CHANGE_DETECTION')) t(kind) where changed")
KNOWN = """select p_partkey as call_id, concat('slug-', cast(p_partkey as string)) as slug, concat(case when p_partkey % 3 = 0 then 'legacy:' else 'programme:' end, cast(p_size as string)) as programme_id from {part} where p_partkey % 5 < 4"""
WANTED = """select p_partkey as candidate_id, case when p_partkey % 17 = 3 then 'STAGED' else 'READY' end as state, p_partkey as call_id, concat('slug-', cast(case when p_partkey % 13 = 2 then p_partkey + 1 when p_partkey % 13 = 5 then -p_partkey else p_partkey end as string)) as slug, concat('programme:', cast(case when p_partkey % 11 = 4 then p_size + 1 when p_partkey % 11 = 7 then 900 else p_size end as string)) as programme_id,
    's' as source_id, p_partkey as external_id, cast(p_size as string) as sha, case when p_partkey % 19 = 6 then ' ' else p_name end as title from {part}"""
PROGRAMMES = "select distinct concat('programme:', cast(p_size as string)) as programme_id from {part}"
RECORDS = "select 's' as source_id, p_partkey as external_id, cast(case when p_partkey % 23 = 8 then -1 else p_size end as string) as sha from {part} where p_partkey % 29 <> 9"
add(
    "D7_publish_conflicts",
    lambda s, d: P.conflicts(sql(s, d, WANTED), sql(s, d, KNOWN), sql(s, d, PROGRAMMES), sql(s, d, RECORDS), [("legacy:", "programme:")]),
    f"""with w as ({WANTED}), k as ({KNOWN}), p as ({PROGRAMMES}), r as ({RECORDS}) select candidate_id, case when state <> 'READY' then 'CANDIDATE_NOT_READY' when trim(title) = '' then 'PAYLOAD_INVALID'
        when not exists (select 1 from r where r.external_id = w.external_id) then 'SOURCE_RECORD_MISSING' when not exists (select 1 from r where r.external_id = w.external_id and r.sha = w.sha) then 'SOURCE_RECORD_MISMATCH' when w.programme_id not in (select programme_id from p) then 'PROGRAMME_MISSING'
        when exists (select 1 from k where k.slug = w.slug and k.call_id <> w.call_id) then 'IDENTITY_CONFLICT' when exists (select 1 from k where k.call_id = w.call_id and k.slug <> w.slug) then 'IDENTITY_CONFLICT'
        when exists (select 1 from k where k.call_id = w.call_id and k.programme_id <> w.programme_id and not starts_with(k.programme_id, 'legacy:')) then 'IDENTITY_CONFLICT' end as error from w""",
)
FACTS = """select call_id, version_number, case when quantity % 6 = 0 then ' ' else title end as title, status, case when quantity % 5 = 0 then null else summary end as summary, case when quantity % 7 = 0 then null else cast(close_at as string) end as close_at, n as normalisation from {versions} cross join (select 1 as n union all select 2) t where n = 1 or quantity % 2 = 0"""
PATHS = {"/title": "title", "/status": "status", "/summary": "summary", "/submission_close_at": "close_at"}
add(
    "D8_evidence_rows",
    lambda s, d: P.evidence(sql(s, d, FACTS), ["call_id", "version_number"], PATHS, col("normalisation")),
    f"with f as ({FACTS}), e as (" + " union all ".join(f"select call_id, version_number, '{p}' as field_path, {c} as value, normalisation from f where trim({c}) <> ''" for p, c in PATHS.items()) + ") select *, case when normalisation < max(normalisation) over (partition by call_id, version_number, field_path) then 'SUPERSEDED' else 'CURRENT' end as label from e",
)

# --- quality

RUN = {"structure_changed": "seen % 23 = 0", "http_errors": "errors * 2", "http_requests": "case when seen % 7 = 0 then 0 else seen end", "parse_failures": "bad", "parse_attempts": "seen", "validation_failures": "errors", "validation_attempts": "case when seen % 5 = 0 then 0 else seen end"}
add(
    "E2_quality_gate",
    lambda s, d: P.gate(baselines(s, d).withColumns({k: F.expr(v) for k, v in RUN.items()})).select("source_id", col("day").cast("string").alias("day"), "hour", "status", "destructive", F.array_join("violations", ",").alias("violations")),
    f"""with r as (select *, {', '.join(f'{v} as {k}' for k, v in RUN.items())} from ({BASE})), v as (select *, concat_ws(',', case when structure_changed then 'UNEXPECTED_STRUCTURE_CHANGE' end, case when n >= 3 and median > 0 and seen < median * 0.35 then 'RECORD_COUNT_COLLAPSE' end,
        case when http_requests > 0 and http_errors * 5 > http_requests then 'HTTP_ERROR_RATE_HIGH' end, case when parse_attempts > 0 and (parse_attempts - parse_failures) * 100 < parse_attempts * 85 then 'PARSE_SUCCESS_LOW' end,
        case when validation_attempts > 0 and (validation_attempts - validation_failures) * 100 < validation_attempts * 85 then 'VALIDATION_SUCCESS_LOW' end) as violations from r)
    select source_id, cast(day as varchar) as day, hour, case when violations <> '' then 'DEGRADED' else 'HEALTHY' end as status, violations = '' as destructive, violations from v""",
)
SOURCES = """select s_suppkey as source_id, s_suppkey % 11 <> 3 as probe_ok, case when s_suppkey % 7 = 1 then null else date '2024-01-20' end as expected, case when s_suppkey % 9 = 2 then null else date '2024-01-25' - cast(s_suppkey % 13 as int) end as last_run,
    case when s_suppkey % 9 = 2 or s_suppkey % 6 = 4 then null else date '2024-01-24' - cast(s_suppkey % 17 as int) end as last_success, s_suppkey % 5 = 0 as degraded from {supplier}"""
add(
    "E4_source_health",
    lambda s, d: P.health(sql(s, d, SOURCES), F.lit("2024-01-25").cast("date"), 3, 3, 2).select("source_id", F.array_join("reasons", ",").alias("reasons"), "health"),
    f"""with x as (select *, concat_ws(',', case when not probe_ok then 'DIRECT_HEALTHCHECK_UNAVAILABLE' end, case when last_run is null then 'NEVER_RUN' end, case when last_run is not null and last_success is null then 'NEVER_SUCCEEDED' end,
        case when date '2024-01-25' > expected + 2 and (last_run is null or last_run < expected) then 'SCHEDULED_RUN_MISSED' end, case when (last_success is null and last_run is not null) or last_success < date '2024-01-14' then 'LAST_SUCCESS_STALE' end, case when degraded then 'QUALITY_GATE_DEGRADED' end) as reasons from ({SOURCES}))
    select source_id, reasons, case when regexp_matches(reasons, 'UNAVAILABLE|STALE|NEVER_SUCCEEDED') then 'UNAVAILABLE' when reasons <> '' then 'DEGRADED' else 'HEALTHY' end as health from x""",
)
TERMS = "select concat('t', cast(p_partkey % 1900 as string)) as code from {part}"
NAMES = "select concat('s', cast(p_partkey * 7 % 1997 as string)) as name from {part}"
LINKS = """select concat('t', cast(p_partkey as string)) as src, concat('t', cast(case when p_partkey % 50 = 9 then p_partkey - 4 else p_partkey + 1 end as string)) as dst, case when p_partkey % 5 = 4 and p_partkey % 50 <> 9 then 'RELATED' else 'BROADER' end as relation, cast(case when p_size = 7 then 0 when p_size = 8 then 101 else p_size end as bigint) as pct from {part} where p_partkey % 10 <> 3"""
add(
    "E6_ontology_validation",
    lambda s, d: P.ontology_issues(sql(s, d, TERMS), sql(s, d, NAMES), sql(s, d, LINKS)),
    f"""with recursive t as ({TERMS}), y as ({NAMES}), e as ({LINKS}), b as (select distinct src, dst from e where relation = 'BROADER'), walk as (select src, dst, 1 as n from b union select w.src, b.dst, n + 1 from walk w join b on b.src = w.dst where n < 16)
    select 'DUPLICATE_TERM' as issue, code as subject from t group by code having count(*) > 1 union all select 'DUPLICATE_SYNONYM', name from y group by name having count(*) > 1
    union all select distinct 'DANGLING_EDGE', src || '>' || dst from e where src not in (select code from t) or dst not in (select code from t) union all select distinct 'WEIGHT_OUT_OF_RANGE', src || '>' || dst from e where pct <= 0 or pct > 100
    union all select distinct 'BROADER_CYCLE', src from walk where src = dst""",
)

# --- finance rule graphs: orders are calls, their lines are groups, conditions and scenarios

CALLS = "select o_orderkey as call_id, o_orderkey % 13 <> 5 as verified from {orders}"
SETS = "select o_orderkey as call_id, o_orderkey as rule_set, o_orderkey % 11 <> 4 as complete, true as verified from {orders} where o_orderkey % 17 <> 6 union all select o_orderkey, o_orderkey + 1, true, true from {orders} where o_orderkey % 19 = 7"
GROUPS = """select l_orderkey as rule_set, concat('g', cast(l_linenumber as string)) as group_id, case when l_linenumber = 1 then null when l_suppkey % 37 = 3 then concat('g', cast(l_linenumber as string)) else concat('g', cast(cast(floor(l_linenumber / 2.0) as int) as string)) end as parent_id,
    case when l_suppkey % 41 = 8 then 'NOT' when l_suppkey % 2 = 0 then 'OR' else 'AND' end as kind from {lineitem}"""
CONDITIONS = "select l_orderkey as rule_set, concat('g', cast(l_linenumber as string)) as group_id, l_suppkey % 53 <> 9 as trusted from {lineitem} where l_partkey % 43 <> 2"
OFFERS = "select l_orderkey as call_id, concat('g', cast(case when l_partkey % 47 = 1 then 99 else l_linenumber end as string)) as group_id, l_partkey % 59 <> 3 as trusted from {lineitem}"
add(
    "E8_rule_graph_check",
    lambda s, d: R.graph_check(*[sql(s, d, t) for t in (CALLS, SETS, GROUPS, CONDITIONS, OFFERS)]),
    f"""with recursive groups0 as ({GROUPS}), v as ({CALLS}), st as ({SETS}), c as ({CONDITIONS}), o as ({OFFERS}),
    down as (select rule_set, group_id from groups0 where parent_id is null union select g.rule_set, g.group_id from down join groups0 g on g.rule_set = down.rule_set and g.parent_id = down.group_id),
    up as (select rule_set, group_id as below, group_id from groups0 union select up.rule_set, up.below, g.parent_id from up join groups0 g on g.rule_set = up.rule_set and g.group_id = up.group_id where g.parent_id is not null),
    ruled as (select distinct up.rule_set, up.group_id from up join c on c.rule_set = up.rule_set and c.group_id = up.below),
    kids as (select g.rule_set, g.group_id, any_value(g.kind) as kind, (select count(*) from groups0 k where k.rule_set = g.rule_set and k.parent_id = g.group_id) + (select count(*) from c where c.rule_set = g.rule_set and c.group_id = g.group_id) as n from groups0 g group by all),
    one as (select call_id, count(*) as sets, min(rule_set) as rule_set, bool_and(complete and verified) as sure from st group by call_id),
    gs as (select rule_set, count(*) as n, count(distinct group_id) as ids, count(*) filter (parent_id is null) as roots, bool_or((rule_set, group_id) not in (select (rule_set, group_id) from down)) as loose from groups0 group by rule_set),
    ks as (select rule_set, bool_or(n = 0 or (kind = 'NOT' and n <> 1)) as odd from kids group by rule_set),
    cs as (select rule_set, count(*) as n, bool_or(not trusted or (rule_set, group_id) not in (select (rule_set, group_id) from groups0)) as doubt from c group by rule_set),
    os as (select o.call_id, count(*) as n, bool_or(not exists (select 1 from groups0 g where g.rule_set = one.rule_set and g.group_id = o.group_id)) as unplaced, bool_or(not exists (select 1 from ruled r where r.rule_set = one.rule_set and r.group_id = o.group_id)) as unruled, bool_or(not trusted) as untrusted from o left join one using (call_id) group by o.call_id)
    select v.call_id, case when not v.verified then 'GRANT_VERSION_UNVERIFIED' when coalesce(sets, 0) <> 1 then 'RULE_SET_NOT_UNIQUE' when not sure then 'RULE_SET_UNVERIFIED' when gs.n > 64 or cs.n > 128 or os.n > 64 then 'SNAPSHOT_LIMIT_EXCEEDED'
        when gs.n is null or ids < gs.n or roots <> 1 or cs.n is null or os.n is null or unplaced then 'INCOMPLETE_RULE_GRAPH' when loose then 'INVALID_RULE_GRAPH' when unruled then 'INCOMPLETE_RULE_GRAPH' when odd then 'UNSUPPORTED_RULE_GRAPH' when doubt or untrusted then 'UNVERIFIED_OFFICIAL_EVIDENCE'
        else 'VERSION_BOUND_EVIDENCE_REFERENCES_ONLY' end as code from v left join one using (call_id) left join gs using (rule_set) left join ks using (rule_set) left join cs using (rule_set) left join os on os.call_id = v.call_id""",
)
VALUES = """select l_orderkey as profile_id, cast(l_linenumber as bigint) * 1000000000 + l_partkey * 1000 + l_suppkey as value_id, l_suppkey % 31 <> 2 as supported, l_partkey % 29 <> 4 as trusted, case when l_suppkey % 37 = 5 then null else 10 + l_quantity end as observed_at, 20 as first_seen_at, case when l_partkey % 41 = 6 then 10 else 30 end as retrieved_at, 70 as created_at, 80 + l_linenumber as verified_at from {lineitem} where l_orderkey % 7 > 0"""
PROFILES = "select o_orderkey as profile_id, case when o_orderkey % 23 = 1 then 75 else 5 end as created_at, case when o_orderkey % 19 = 2 then 82 else 100 end as cutoff from {orders}"
add(
    "E9_preflight",
    lambda s, d: R.preflight(sql(s, d, PROFILES), sql(s, d, VALUES)),
    f"""with p as ({PROFILES}), v as ({VALUES}), x as (select v.profile_id, value_id, case when not supported then 'UNSUPPORTED_ATTRIBUTE_VALUE' when not trusted then 'UNVERIFIED_OFFICIAL_ATTRIBUTE_EVIDENCE'
        when observed_at is null or p.created_at > v.created_at or p.created_at > verified_at or first_seen_at > retrieved_at or retrieved_at > v.created_at or retrieved_at > verified_at or observed_at > v.created_at or observed_at > verified_at or v.created_at > verified_at or verified_at > cutoff then 'INCONSISTENT_ATTRIBUTE_TIMESTAMPS' end as fault from v join p using (profile_id)),
    f as (select profile_id, count(*) as n, arg_min(fault, value_id) filter (fault is not null) as fault from x group by profile_id)
    select p.profile_id, case when n is null then 'NO_ATTRIBUTE_VALUES' when n > 128 then 'ATTRIBUTE_LIMIT_EXCEEDED' else coalesce(fault, 'OWNED_OFFICIAL_ATTRIBUTE_REFERENCES_ONLY') end as code from p left join f using (profile_id)""",
)

# --- all sources together, and what searches see

SOURCE_ROWS = """select p_partkey as id, 'parts' as origin, case when p_partkey % 11 = 3 then 'NEW' else 'OPEN' end as status, case when p_partkey % 13 = 4 then null else 'VERIFIED' end as verification, case when p_partkey % 7 = 2 then 'abc' else sha2(cast(p_partkey as string), 256) end as sha, case p_partkey % 5 when 0 then 'FAX' when 1 then 'API' else 'HTML' end as mode, case when p_size % 9 = 1 then 'USD' else 'CZK' end as currency from {part}
    union all select s_suppkey, 'suppliers', 'DRAFT', 'UNVERIFIED', sha2(s_name, 256), 'FILE', case when s_suppkey % 3 = 0 then 'EUR' else 'GBP' end from {supplier}"""
add("C4_union_validate", lambda s, d: P.validated(sql(s, d, SOURCE_ROWS)).select("id", "origin", F.array_join("reasons", ",").alias("reasons"), "valid"),
    plain(f"""select id, origin, reasons, reasons = '' as valid from (select id, origin, concat_ws(',', case when status = 'NEW' then 'STATUS' end, case when verification is null then 'VERIFICATION' end, case when length(sha) <> 64 then 'CONTENT_HASH' end, case when mode = 'FAX' then 'RETRIEVAL_MODE' end, case when currency in ('USD', 'GBP') then 'CURRENCY' end) as reasons from ({SOURCE_ROWS}))"""))
LISTED = "select p_partkey as call_id, p_name as title, p_type as programme_id from {part}"
PROGRAMME_ROWS = "select p_type as programme_id, concat('code-', lower(p_type)) as code, concat('Programme ', p_type) as programme, min(p_brand) as provider_id from {part} group by p_type"
PROVIDER_ROWS = "select p_brand as provider_id, concat('Provider ', p_brand) as provider from {part} group by p_brand"
PAYLOADS = """select call_id, version_number as ord, concat('{{"keywords":"k', cast(quantity as string), '"', case when quantity % 2 = 0 then concat(',"summary":"', summary, '"') else '' end, '}}') as payload from {versions} where quantity % 3 > 0"""
add("D10_search_projection", lambda s, d: P.projection(view(s, d, "versions"), *[sql(s, d, t) for t in (LISTED, PROGRAMME_ROWS, PROVIDER_ROWS, PAYLOADS)]),
    f"""with v as (select call_id, version_number, status from {{versions}} x where version_number = (select max(version_number) from {{versions}} y where y.call_id = x.call_id)), p as (select call_id, arg_max(quantity, version_number) as q, arg_max(summary, version_number) as words from {{versions}} where quantity % 3 > 0 group by call_id)
    select v.call_id, v.version_number, v.status, l.title, case when q % 2 = 0 then words else '' end as summary, concat_ws(' ', 'k' || q, code, programme, provider) as keywords from v join ({LISTED}) l using (call_id) join ({PROGRAMME_ROWS}) g using (programme_id) join ({PROVIDER_ROWS}) o using (provider_id) join p using (call_id)""")  # fmt: skip
