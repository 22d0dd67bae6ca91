"""Domain views over the base tables, as SQL that Spark and DuckDB both take.

A view names other tables and views in braces. Spark gets them as DataFrames, DuckDB as common
table expressions, so both engines start from the same rows. Arithmetic is on integers.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "calls": "select p_partkey as call_id, p_name as title, p_type as activity, p_brand as provider, 'CZK' as currency, p_size from {part}",
    "versions": """select l_partkey as call_id, l_orderkey, l_linenumber,
        row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) as version_number,
        case concat(l_returnflag, l_linestatus) when 'AF' then 'CLOSED' when 'AO' then 'PLANNED' when 'NF' then 'PAUSED' when 'NO' then 'OPEN' when 'RF' then 'CANCELLED' else 'ANNOUNCED' end as status,
        cast(l_shipdate as date) as open_at, cast(l_shipdate as date) + cast(l_quantity as int) as close_at,
        concat('Call ', cast(cast(l_quantity as int) % 5 as string)) as title, concat('round ', cast(l_linenumber % 3 as string)) as summary,
        concat('rule-', cast(l_suppkey % 4 as string)) as rules, cast(round(l_extendedprice * 100) as bigint) as cap_minor, cast(round(l_discount * 1000) as bigint) * 10 as rate_bps,
        cast(l_quantity as bigint) as quantity, l_suppkey from {lineitem}""",
    "steps": """select call_id, version_number, status, open_at, close_at, title, summary, rules, cap_minor, rate_bps,
        lag(version_number) over w as old_number, lag(status) over w as old_status, lag(open_at) over w as old_open_at, lag(close_at) over w as old_close_at,
        lag(title) over w as old_title, lag(summary) over w as old_summary, lag(rules) over w as old_rules, lag(cap_minor) over w as old_cap_minor, lag(rate_bps) over w as old_rate_bps
        from {versions} window w as (partition by call_id order by version_number)""",
    "projects": """select o_orderkey as project_id, o_custkey as applicant_id, case when o_orderkey % 11 = 0 then 'EUR' else 'CZK' end as currency,
        cast(round(o_totalprice * 100) as bigint) as total_minor,
        case when o_orderkey % 5 = 0 then null else cast(floor(cast(round(o_totalprice * 100) as bigint) * 7 / 10.0) as bigint) end as eligible_minor,
        case when o_orderkey % 7 = 0 then null else cast(floor(cast(round(o_totalprice * 100) as bigint) / 10.0) as bigint) end as vat_minor,
        o_orderpriority as priority, cast(o_orderdate as date) as due_at from {orders}""",
    "funded": """select p.project_id, p.currency, p.total_minor, p.eligible_minor, p.vat_minor,
        case when p.eligible_minor is null or p.vat_minor is null then null when p.project_id % 13 = 0 then 1 else p.total_minor - p.eligible_minor - p.vat_minor end as ineligible_minor,
        concat(cast(v.call_id as string), ':', cast(v.version_number as string)) as scenario_id, 'CZK' as scenario_currency, v.call_id,
        case v.l_suppkey % 6 when 0 then 'LOAN' else 'GRANT' end as instrument, case v.quantity % 9 when 0 then 'FAIL' when 1 then 'UNKNOWN' else 'PASS' end as applicability,
        case v.quantity % 4 when 0 then null when 1 then 'FAIL' when 2 then 'UNKNOWN' else 'PASS' end as group_result, v.quantity % 4 <> 3 as has_group,
        case when v.rate_bps = 0 then null else 2000 + v.rate_bps end as rate_bps, case when v.quantity % 3 = 0 then null else v.cap_minor end as cap_minor,
        case when v.quantity % 8 = 5 then v.cap_minor else null end as min_minor, case when v.quantity % 10 = 7 then 10000000 else null end as cost_min_minor, case when v.quantity % 10 = 8 then 20000000 else null end as cost_max_minor,
        case v.l_suppkey % 3 when 0 then 'REIMBURSEMENT' when 1 then 'ADVANCE' else 'UNKNOWN' end as payment_mode, v.l_suppkey % 2 = 0 as advance_allowed
        from {projects} p join {versions} v on v.l_orderkey = p.project_id""",
    # what a project may choose from; some of its scenarios share an id
    "offers": """select project_id, case when call_id % 17 = 0 then concat('twice:', cast(project_id as string)) else scenario_id end as scenario_id, applicability, has_group, group_result from {funded}""",
    # pages of which every block is known
    "built_pages": """select o_orderkey as page_id, concat('http://calls.example/c/', cast(o_orderkey as string)) as url, concat('<html><head><script>var x = "<p>no</p>";</script></head><body><h1>Call ', cast(o_orderkey as string), '</h1><p>Opens <b>', cast(cast(o_orderdate as date) as string),
        '</b><br>now &amp; here<h3>Conditions</h3><ul><li>', o_orderpriority, '<li> ', concat('clerk ', cast(o_custkey % 7 as string)), ' </ul><p><a href="/doc/', cast(o_orderkey as string), '.pdf">Rules ', cast(o_custkey as string), '</a> <a href="#top">up</a></p><table><tr><th>Status:</th><td>', o_orderstatus, '</td></tr><tr><td>Clerk</td><td>', concat('clerk ', cast(o_custkey % 7 as string)),
        '</td><td>x</td></tr><tr><td></td><td> </td></tr></table><dl><dt>Clerk:</dt><dd>', o_orderpriority, '</dd></dl><h2>History</h2><svg><p>hidden</p></svg><table><tr><td>', cast(cast(o_orderdate as date) as string), '</td><td>extended</td></tr><tr><td>1. 2. 2024</td><td>opened</td></tr></table><p>End</p></body></html>') as html,
        concat('Call ', cast(o_orderkey as string)) as top, cast(cast(o_orderdate as date) as string) as day, o_orderpriority as priority, concat('clerk ', cast(o_custkey % 7 as string)) as clerk, o_custkey as custkey, o_orderstatus as state from {orders}""",
    "source_runs": """select event_type as source_id, cast(ts as date) as day, cast(date_part('hour', ts) as int) as hour, count(*) as seen,
        sum(case when value < 10 then 1 else 0 end) as errors, sum(case when value > 90 then 1 else 0 end) as bad,
        concat('v', cast(cast(date_part('day', cast(ts as date)) as int) / 20 >= 1 as string)) as adapter, case when cast(date_part('hour', ts) as int) % 7 = 3 then 'LOCKED' else 'DONE' end as status
        from {events} group by event_type, cast(ts as date), cast(date_part('hour', ts) as int)""",
    "observations": """select event_type as source_id, cast(user_id as string) as external_id, cast(ts as date) as day, max(event_id) as event_id, max(props) as payload
        from {events} group by event_type, user_id, cast(ts as date)""",
    "outbox": """select concat(event_type, ':', cast(user_id as string), ':', cast(cast(date_part('hour', ts) as int) as string)) as dedupe_key, event_id, event_type, user_id, ts, value from {events}""",
    "facts": """select c_custkey as subject_id, case when c_custkey % 7 = 0 then null else c_mktsegment end as segment, c_custkey % 13 = 0 as segment_absent,
        case when c_custkey % 7 = 3 then null else cast(round(c_acctbal * 100) as bigint) end as balance_minor, c_custkey % 17 = 0 as balance_is_text,
        concat('n', cast(c_nationkey as string)) as geo_id, c_custkey % 5 = 0 as geo_unknown, c_custkey % 3 as rule_set from {customer}""",
    # attribute values as JSON texts, some of a wrong type, some missing (null), some known to be absent
    "attribute_values": """select subject_id, attribute_key, case when (subject_id + k) % 23 = 4 or (subject_id + k) % 29 = 5 then null when (subject_id + k) % 19 = 3 then wrong else value end as value, (subject_id + k) % 29 = 5 as absent from (
        select c_custkey as subject_id, 'name' as attribute_key, 1 as k, concat('"', c_name, '"') as value, '7' as wrong from {customer}
        union all select c_custkey, 'segment', 2, concat('"', c_mktsegment, '"'), 'true' from {customer}
        union all select c_custkey, 'staff', 3, cast(c_nationkey - 5 as string), '1.5' from {customer}
        union all select c_custkey, 'balance', 4, cast(cast(round(c_acctbal * 100) as bigint) as string), '"12"' from {customer}
        union all select c_custkey, 'share', 5, cast(c_custkey % 100 * 100 as string), 'false' from {customer}
        union all select c_custkey, 'ratio', 6, concat(cast(c_custkey % 40 as string), case when c_custkey % 2 = 0 then '.25' else '' end), '"1.5"' from {customer}
        union all select c_custkey, 'public', 7, case when c_custkey % 3 = 0 then 'true' else 'false' end, '1' from {customer}
        union all select c_custkey, 'activities', 8, concat('["a', cast(c_custkey % 5 as string), '","b","a', cast(c_nationkey % 3 as string), '"]'), '["a",1]' from {customer}
        union all select c_custkey, 'founded', 9, concat('"20', cast(10 + c_custkey % 15 as string), '-02-', cast(10 + c_custkey % 18 as string), '"'), '"2023-02-31"' from {customer}
        union all select c_custkey, 'checked', 10, concat('"2024-03-', cast(10 + c_custkey % 20 as string), 'T1', cast(c_nationkey % 9 as string), ':30:00Z"'), '"soon"' from {customer}
        union all select c_custkey, 'seat', 11, concat('"', case when c_custkey % 12 = 1 then 'x' else 'n' end, cast(c_nationkey as string), '"'), '["n1"]' from {customer}) t where (subject_id + k) % 31 <> 6""",
    # rule trees, one per order; some have no root or two, empty or repeated groups, or dangling parents
    "rule_groups": """select l_orderkey as rule_set, concat('g', cast(case when l_suppkey % 40 = 7 then 1 else l_linenumber end as string)) as group_id,
        case when l_linenumber = 1 and l_suppkey % 30 <> 4 or l_suppkey % 50 = 9 then null when l_suppkey % 60 = 11 then 'g9' when l_suppkey % 45 = 13 then concat('g', cast(l_linenumber as string)) else concat('g', cast(cast(floor(l_linenumber / 2.0) as int) as string)) end as parent_id,
        case l_suppkey % 7 when 0 then 'NOT' when 1 then 'OR' else 'AND' end as kind from {lineitem}""",
    "rule_leaves": """select l_orderkey as rule_set, concat('g', cast(l_linenumber as string)) as group_id, cast(1 + l_suppkey % 2 as bigint) as n from {lineitem} where l_partkey % 20 <> 3""",
    # rule sets kept as data: one tree per order, some with a fault; its conditions are drawn from the fixed cases
    "set_lines": """select l_orderkey as rule_set, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) as k, cast(count(*) over (partition by l_orderkey) as int) as m, l_suppkey, l_partkey from {lineitem}""",
    "set_groups": """select rule_set, concat('g', cast(k as string)) as group_id, case when k = 1 then cast(null as string) when rule_set % 53 = 9 and k = 2 then 'g99' else concat('g', cast(cast(floor(k / 2.0) as int) as string)) end as parent_id,
        case when own + case when 2 * k + 1 <= m then 2 when 2 * k <= m then 1 else 0 end = 1 and l_suppkey % 2 = 0 or rule_set % 41 = 7 and k = 1 then 'NOT' when l_partkey % 3 = 1 then 'OR' else 'AND' end as kind, k as position, own, l_suppkey, l_partkey
        from (select *, cast(case when 2 * k > m and rule_set % 29 <> 3 then 1 else 0 end + l_suppkey % 3 as int) as own from {set_lines}) t""",
    "set_conditions": """select g.rule_set, g.group_id, concat(g.group_id, 'c', cast(n.i as string)) as condition_id, n.i as place, c.attribute_key, c.data_type, c.operator, c.expected, c.unknown_policy,
        (g.l_partkey + n.i) % 6 <> 0 as blocking, (g.l_suppkey + n.i) % 5 <> 0 as verified, (g.l_partkey + 2 * n.i) % 7 <> 0 as evidence
        from {set_groups} g join (select 0 as i union all select 1 union all select 2) n on n.i < g.own join {rule_cases} c on c.case_no = (g.l_suppkey * 7 + g.l_partkey + 5 * n.i) % 49""",
    "rule_sets": """select o_orderkey as rule_set, o_custkey as subject_id, case when o_orderkey % 3 = 0 then 'PARTIAL' else 'COMPLETE' end as completeness,
        case when o_orderkey % 5 = 1 then 'EXTRACTED' else 'VERIFIED' end as verification, o_orderkey % 37 <> 5 as same_version from {orders}""",
    # values with an official source, verified and with evidence
    "trusted_values": "select * from {attribute_values} where (subject_id + length(attribute_key)) % 11 <> 1",
    "area_lists": """select s_suppkey as list_id, concat(case when s_suppkey % 3 = 0 then 'r' else 'n' end, cast(case when s_suppkey % 3 = 0 then s_suppkey % 5 else s_nationkey end as string)) as place_id, 'INCLUDE' as mode, s_suppkey % 4 <> 1 as descendants from {supplier}
        union all select s_suppkey, concat('n', cast(s_suppkey % 25 as string)), 'EXCLUDE', true from {supplier} where s_suppkey % 3 = 0""",
    "places": """select concat('r', cast(r_regionkey as string)) as place_id, cast(null as string) as parent_id from {region}
        union all select concat('n', cast(n_nationkey as string)), concat('r', cast(n_regionkey as string)) from {nation}""",
    "search_docs": """select doc_id, split_part(coalesce(text, ''), chr(10), 1) as title, coalesce(text, '') as body, split_part(coalesce(text, ''), chr(10), 2) as summary, split_part(coalesce(text, ''), chr(10), 3) as costs, concat(lang, ' ', source) as keywords, source as provider,
        case doc_id % 8 when 0 then 'OPEN' when 1 then 'PLANNED' when 2 then 'ANNOUNCED' when 3 then 'CLOSED' when 4 then 'CANCELLED' else 'OPEN' end as status,
        case when doc_id % 9 = 0 then null else date '2024-01-01' + cast(doc_id % 700 as int) end as close_at from {documents}""",
    "terms": "select distinct p_name as name from {part} union select distinct p_type from {part} union select distinct p_brand from {part}",
    # per call the next one of the same activity and the next one of another
    "golden": """select q.call_id as query_id, q.title, q.activity, q.good_id, b.call_id as bad_id from (select *, lead(call_id) over (partition by activity order by call_id) as good_id from {calls}) q
        left join {calls} b on b.call_id = q.call_id + 1 and b.activity <> q.activity and b.title <> q.title and b.provider <> q.provider""",
    "synonyms": """select p_brand as term, concat('label ', p_brand) as name, cast(50 + min(p_size) % 50 as bigint) as pct from {part} group by p_brand
        union all select p_type, concat('plan ', p_type), cast(90 - min(p_size) % 40 as bigint) from {part} group by p_type""",
    "edges": """select p_name as src, p_type as dst, 'BROADER' as relation, cast(60 + min(p_size) % 40 as bigint) as pct from {part} group by p_name, p_type
        union all select p_type, p_brand, 'RELATED', cast(50 + min(p_size) % 50 as bigint) from {part} group by p_type, p_brand""",
    "watches": """select o_orderkey as watch_id, o_custkey as project_id, o_orderkey % 100 <> 50 as enabled, case o_orderkey % 3 when 0 then 'WEAK' when 1 then 'POSSIBLE' else 'VERY_GOOD' end as minimum_band,
        concat('k', cast(cast(floor(o_custkey / 8.0) as int) as string), case when o_orderkey % 3 = 0 then ' support' else '' end) as intent from {orders}""",
    # the current version of each call, with the text that searches see
    "current_calls": """select c.call_id, v.version_number, v.status, concat(c.title, ' ', c.activity, ' k', cast(cast(floor(c.call_id / 8.0) as int) as string)) as text
        from {calls} c join (select *, max(version_number) over (partition by call_id) as newest from {versions}) v on v.call_id = c.call_id and v.version_number = v.newest""",
    "newest_versions": "select call_id, version_number, status, open_at, close_at from (select *, max(version_number) over (partition by call_id) as newest from {versions}) t where version_number = newest",
    # every version with the text that searches see, and the number of its call's newest one
    "version_texts": """select c.call_id, v.version_number, v.status, v.newest, concat(c.title, ' ', c.activity, ' k', cast(cast(floor(c.call_id / 8.0) as int) as string)) as text
        from {calls} c join (select *, max(version_number) over (partition by call_id) as newest from {versions}) v on v.call_id = c.call_id""",
    # watches as they are when their hits are judged: some have been switched off since
    "watches_now": "select watch_id, enabled and watch_id % 40 <> 9 as enabled, minimum_band from {watches}",
    "candidates": """select w.watch_id, w.enabled, w.minimum_band, v.call_id, v.version_number, case v.quantity % 3 when 0 then 'WEAK' when 1 then 'POSSIBLE' else 'VERY_GOOD' end as band,
        case v.quantity % 7 when 0 then 'INELIGIBLE' when 1 then 'NEEDS_REVIEW' when 2 then 'NEEDS_INFORMATION' when 3 then null when 4 then 'ELIGIBLE' else 'LIKELY_ELIGIBLE' end as eligibility,
        case v.l_suppkey % 6 when 0 then 'SCENARIO_NOT_APPLICABLE' when 1 then 'ERROR' when 2 then 'INSTRUMENT_NOT_SUPPORTED' when 3 then 'NEEDS_INFORMATION' when 4 then null else 'COMPLETE' end as finance
        from {watches} w join {versions} v on v.l_orderkey = w.watch_id""",
    "requirements": """select v.call_id, v.version_number, r.req as requirement_id, concat(r.req, ' ', cast((v.quantity + r.n) % 3 as string)) as title,
        case (v.l_suppkey + r.n) % 3 when 0 then 'REQUIRED' when 1 then 'CONDITIONAL' else 'RECOMMENDED' end as necessity,
        case (v.quantity + r.n) % 3 when 0 then true when 1 then false else null end as condition_applies
        from {versions} v join (select 'budget' as req, 0 as n union all select 'consent', 1 union all select 'plan', 2 union all select 'statute', 3) r on (v.quantity + r.n) % 4 <> 0""",
    # profiles with the patch that each applicant's last project brings, if any
    "profile_patches": """select c_custkey as subject_id, p is not null as patched, coalesce(p % 4 = 0, false) as sourced, cast(c_custkey as string) as old_ico, case when (c_custkey + 0) % 4 <> 0 then 'register' end as source_ico, coalesce(p % 7 = 0, false) as gives_ico, case when p % 14 = 0 then cast(p as string) else cast(c_custkey as string) end as new_ico, case when (p + 0) % 3 = 0 then 'register' when (p + 0) % 3 = 1 then 'form' end as told_ico,
        concat('m', cast(c_nationkey as string)) as old_municipality_code, case when (c_custkey + 1) % 4 <> 0 then 'register' end as source_municipality_code, coalesce(p % 3 = 0, false) as gives_municipality_code, concat('m', cast(p % 25 as string)) as new_municipality_code, case when (p + 1) % 3 = 0 then 'register' when (p + 1) % 3 = 1 then 'form' end as told_municipality_code,
        concat('town ', cast(c_nationkey as string)) as old_municipality_name, case when (c_custkey + 2) % 4 <> 0 then 'register' end as source_municipality_name, coalesce(p % 6 = 0, false) as gives_municipality_name, concat('town ', cast(p % 25 as string)) as new_municipality_name, case when (p + 2) % 3 = 0 then 'register' when (p + 2) % 3 = 1 then 'form' end as told_municipality_name,
        concat('r', cast(c_nationkey % 5 as string)) as old_region_code, case when (c_custkey + 3) % 4 <> 0 then 'register' end as source_region_code, coalesce(p % 11 = 0, false) as gives_region_code, cast(null as string) as new_region_code, case when (p + 3) % 3 = 0 then 'register' when (p + 3) % 3 = 1 then 'form' end as told_region_code,
        cast(c_custkey % 900 as string) as old_municipality_population, case when (c_custkey + 4) % 4 <> 0 then 'register' end as source_municipality_population, coalesce(p % 5 = 0, false) as gives_municipality_population, case when p % 10 = 0 then cast(p % 900 as string) else cast(c_custkey % 900 as string) end as new_municipality_population, case when (p + 4) % 3 = 0 then 'register' when (p + 4) % 3 = 1 then 'form' end as told_municipality_population,
        '2024-01-01' as old_municipality_population_as_of, case when (c_custkey + 5) % 4 <> 0 then 'register' end as source_municipality_population_as_of, coalesce(p % 15 = 0, false) as gives_municipality_population_as_of, '2025-01-01' as new_municipality_population_as_of, case when (p + 5) % 3 = 0 then 'register' when (p + 5) % 3 = 1 then 'form' end as told_municipality_population_as_of
        from {customer} left join (select o_custkey, max(o_orderkey) as p from {orders} where o_orderkey % 3 <> 1 group by o_custkey) o on o_custkey = c_custkey""",
    # a project's workspaces, one per call, begun on some version of it
    "workspaces": """select concat(cast(l_orderkey as string), ':', cast(call_id as string)) as workspace_id, call_id, min(version_number) as baseline from {versions} group by l_orderkey, call_id""",
    "version_documents": """select v.call_id, v.version_number, d.doc as document_id, case when (v.l_suppkey + d.n) % 9 = 4 then null else concat(d.doc, '-', cast((v.quantity * 7 + d.n) % 3 as string)) end as digest
        from {versions} v join (select 'annex' as doc, 0 as n union all select 'form', 1 union all select 'guide', 2) d on (v.l_suppkey + d.n) % 5 <> 1""",
}


def used(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Views that number a table's rows within a key, which they rename: the table is dealt by the key first,
#: so that one shuffle of its plain columns serves the numbering and what follows by the new name.
DEALT = {"versions": ("lineitem", "l_partkey"), "set_lines": ("lineitem", "l_orderkey"), "built_pages": ("orders", "o_orderkey")}
#: Of these, views with much work a row: their table is dealt over as many tasks as a shuffle has, however small its
#: files, and before the work, as the plain columns are the smallest.
EVENLY = {"built_pages"}


def view(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A base table or a domain view, which may be made from views that are ``given``."""
    if given and name in given:
        return given[name]
    if name in TABLES:
        return table(spark, sf_dir, name)
    return sql(spark, sf_dir, VIEWS[name], DEALT.get(name), int(spark.conf.get("spark.sql.shuffle.partitions")) if name in EVENLY else None, given)


def sql(spark: SparkSession, sf_dir: str, text: str, dealt: tuple[str, str] | None = None, parts: int | None = None, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A query whose tables and views stand in braces; ``dealt`` names a table and its column by which it is
    dealt before, over as many ``parts`` as are told, however small; ``given``: views that are there already."""
    frames = {n: view(spark, sf_dir, n, given) for n in used(text)}
    if dealt:
        frames[dealt[0]] = frames[dealt[0]].repartition(*([parts] if parts else []), dealt[1])
    return spark.sql(text, **frames)


def duck(text: str) -> str:
    """The same for DuckDB: views become common table expressions."""
    order: list[str] = []

    def need(t: str) -> None:
        for n in used(t):
            if n not in TABLES and n not in order:
                need(VIEWS[n])
                order.append(n)

    need(text)
    plain = lambda t: re.sub(r"\{([a-z]\w*)\}", r"\1", t)
    head = ", ".join(f"{n} as ({plain(VIEWS[n])})" for n in order)
    body = plain(text).strip()
    if not head:
        return body
    return f"with {head}, {body[5:]}" if body.lower().startswith("with ") else f"with {head} {body}"
