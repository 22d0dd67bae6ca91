"""Queries of eligibility (G), finance (H), changes, watches and notifications (I)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from grantloom.functions.normalize import stable_id
from grantloom.operators import changes as C
from grantloom.operators import money as M
from grantloom.operators import percolator as P
from grantloom.operators import rule_trees as T
from grantloom.operators import rules as R
from grantloom.operators import search as S
from grantloom.plans.fields import fold
from grantloom.views import VIEWS, duck, view

QUERIES: dict = {}
SQL: dict = {}


def add(name, query, oracle=None):
    QUERIES[name] = query
    if oracle:
        SQL[name] = duck(oracle)


#: (attribute, type, operator, expected): every operator, over every type it takes and some it does not.
CASES = [
    ("name", "STRING", "EQ", '"Customer#000000001"'), ("name", "STRING", "CONTAINS", '"00000004"'), ("name", "STRING", "CONTAINS", "4"), ("name", "STRING", "LT", '"Customer#000000050"'), ("name", "STRING", "EXISTS", None),
    ("segment", "ENUM", "IN", '["BUILDING","MACHINERY"]'), ("segment", "ENUM", "NOT_IN", '["BUILDING","MACHINERY"]'), ("segment", "ENUM", "IN", '"BUILDING"'), ("segment", "ENUM", "NEQ", '"AUTOMOBILE"'), ("segment", "ENUM", "IN", '["BUILDING",7]'),
    ("staff", "INTEGER", "GTE", "5"), ("staff", "INTEGER", "LT", "0"), ("staff", "INTEGER", "EQ", '"5"'), ("staff", "INTEGER", "NOT_EXISTS", None), ("staff", "INTEGER", "CONTAINS", "5"), ("staff", "INTEGER", "DATE_BEFORE", "5"),
    ("balance", "MONEY_MINOR", "BETWEEN", "[100000, 500000]"), ("balance", "MONEY_MINOR", "BETWEEN", "[500000, 100000]"), ("balance", "MONEY_MINOR", "BETWEEN", "[1, 2, 3]"), ("balance", "MONEY_MINOR", "LTE", "0"), ("balance", "MONEY_MINOR", "GT", "1.5"),
    ("share", "PERCENT_BPS", "GT", "5000"), ("share", "PERCENT_BPS", "IN", "[100, 200, 300]"), ("share", "PERCENT_BPS", "NEQ", "100"),
    ("ratio", "NUMBER", "GT", "10"), ("ratio", "NUMBER", "EQ", "4.25"), ("ratio", "NUMBER", "BETWEEN", "[3.5, 20]"), ("ratio", "NUMBER", "EQ", "true"),
    ("public", "BOOLEAN", "EQ", "true"), ("public", "BOOLEAN", "NEQ", "true"), ("public", "BOOLEAN", "EQ", "1"),
    ("activities", "STRING_SET", "INTERSECTS", '["a1","a2"]'), ("activities", "STRING_SET", "CONTAINS", '"a0"'), ("activities", "STRING_SET", "EQ", '["b","a1"]'), ("activities", "STRING_SET", "INTERSECTS", '"a1"'), ("segment", "ENUM", "INTERSECTS", '["BUILDING"]'),
    ("founded", "DATE", "DATE_BEFORE", '"2018-01-01"'), ("founded", "DATE", "DATE_AFTER", '"2018-01-01"'), ("founded", "DATE", "BETWEEN", '["2012-01-01","2019-12-31"]'), ("founded", "DATE", "EQ", '"2018-13-01"'),
    ("checked", "DATETIME", "DATE_AFTER", '"2024-03-15T12:00:00Z"'), ("checked", "DATETIME", "DATE_BEFORE", '"2024-03-15T14:00:00+02:00"'), ("checked", "DATETIME", "LTE", '"2024-03-20T10:30:00Z"'),
    ("seat", "GEO_ID", "GEO_WITHIN", '"r1"'), ("seat", "GEO_ID", "GEO_NOT_WITHIN", '"r1"'), ("seat", "GEO_ID", "GEO_WITHIN", '"n3"'), ("seat", "GEO_ID", "GEO_WITHIN", '"r77"'), ("segment", "ENUM", "GEO_WITHIN", '"r1"'), ("seat", "GEO_ID", "GEO_WITHIN", "7"), ("nowhere", "STRING", "EXISTS", None),
]


def rule_conditions() -> str:
    rows = []
    for k, (key, kind, op, expected) in enumerate(CASES):
        policy = "NOT_APPLICABLE" if k % 3 == 1 else "UNKNOWN"
        value = "cast(null as string)" if expected is None else f"'{expected}'"
        rows.append(f"('c{k:02d}', {k % 2}, '{key}', '{kind}', '{op}', {value}, '{policy}')")
    return f"select condition_id, rule_set, attribute_key, data_type, operator, expected, unknown_policy, 'g0' as group_id, true as blocking, true as verified from (values {', '.join(rows)}) as t(condition_id, rule_set, attribute_key, data_type, operator, expected, unknown_policy)"


def rule_cases() -> str:
    rows = [f"({k}, '{key}', '{kind}', '{op}', {'cast(null as string)' if e is None else repr(e)}, '{'NOT_APPLICABLE' if k % 3 == 1 else 'UNKNOWN'}')" for k, (key, kind, op, e) in enumerate(CASES)]
    return f"select * from (values {', '.join(rows)}) as t(case_no, attribute_key, data_type, operator, expected, unknown_policy)"


VIEWS["rule_conditions"] = rule_conditions()
VIEWS["rule_cases"] = rule_cases()


def typed_sql(raw: str) -> str:
    """A JSON text as a value of its type, null if it is of another."""
    text = f"case when json_type({raw}) = 'VARCHAR' then {raw}::json->>'$' end"
    strings = f"json_type({raw}) = 'ARRAY' and len(list_filter(json_extract({raw}, '$[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0"
    return f"""case when data_type in ('STRING', 'ENUM', 'GEO_ID') then case when json_type({raw}) = 'VARCHAR' then {{'s': {text}, 'n': null::decimal(38,0), 'f': null::double}} end
        when data_type = 'STRING_SET' then case when {strings} then {{'s': array_to_string(list_sort(list_distinct(json_extract_string({raw}, '$[*]'))), chr(1)), 'n': null::decimal(38,0), 'f': null::double}} end
        when data_type in ('INTEGER', 'MONEY_MINOR', 'PERCENT_BPS') then case when json_type({raw}) in ('BIGINT', 'UBIGINT') then {{'s': null::varchar, 'n': cast({raw} as decimal(38,0)), 'f': null::double}} end
        when data_type = 'BOOLEAN' then case when json_type({raw}) = 'BOOLEAN' then {{'s': null::varchar, 'n': case when {raw} = 'true' then 1 else 0 end::decimal(38,0), 'f': null::double}} end
        when data_type = 'NUMBER' then case when json_type({raw}) in ('BIGINT', 'UBIGINT', 'DOUBLE') then {{'s': null::varchar, 'n': null::decimal(38,0), 'f': cast({raw} as double)}} end
        when data_type = 'DATE' then case when try_cast({text} as date) is not null then {{'s': null::varchar, 'n': cast(try_cast({text} as date) - date '1970-01-01' as decimal(38,0)), 'f': null::double}} end
        when data_type = 'DATETIME' then case when try_cast({text} as timestamptz) is not null then {{'s': null::varchar, 'n': cast(epoch_us(try_cast({text} as timestamptz)) as decimal(38,0)), 'f': null::double}} end end"""


def rules_sql(own: str, select: str) -> str:
    """Condition results over ``own``: rules with subject_id, value and absent."""
    return f"""with own as ({own}),
    t as (select *, {typed_sql('value')} as x, {typed_sql('expected')} as e, json_type(expected) as shape, case when json_type(expected) = 'ARRAY' then cast(json_extract(expected, '$[*]') as varchar[]) end as raw from own),
    u as (select *, list_transform(raw, lambda i: {typed_sql('i')}) as items from t),
    w as (select *, raw is not null and len(list_filter(items, lambda i: i is null)) = 0 as whole, case when json_type(expected) = 'VARCHAR' then expected::json->>'$' end as word,
        x.s in (select place_id from {{places}}) and e.s in (select place_id from {{places}}) as known, x.s = e.s or exists (select 1 from {{places}} p where p.place_id = x.s and p.parent_id = e.s) as inside from u),
    d as (select *, case when absent then case operator when 'EXISTS' then 'FAIL' when 'NOT_EXISTS' then 'PASS' else 'UNKNOWN' end
        when value is null then case when unknown_policy = 'NOT_APPLICABLE' then 'NOT_APPLICABLE' else 'UNKNOWN' end
        when x is null then 'ERROR' when operator = 'EXISTS' then 'PASS' when operator = 'NOT_EXISTS' then 'FAIL'
        when operator in ('GEO_WITHIN', 'GEO_NOT_WITHIN') then case when data_type <> 'GEO_ID' or e is null then 'ERROR' when not known then 'UNKNOWN' when inside = (operator = 'GEO_WITHIN') then 'PASS' else 'FAIL' end
        when operator in ('DATE_BEFORE', 'DATE_AFTER') and data_type not in ('DATE', 'DATETIME') then 'ERROR'
        when operator = 'BETWEEN' then case when not whole or len(items) <> 2 then 'ERROR' when items[1] > items[2] then 'ERROR' when x >= items[1] and x <= items[2] then 'PASS' else 'FAIL' end
        when operator in ('IN', 'NOT_IN') then case when not whole then 'ERROR' when list_contains(items, x) = (operator = 'IN') then 'PASS' else 'FAIL' end
        when operator = 'INTERSECTS' then case when data_type <> 'STRING_SET' or raw is null then 'ERROR' when list_has_any(json_extract_string(value, '$[*]'), json_extract_string(expected, '$[*]')) then 'PASS' else 'FAIL' end
        when operator = 'CONTAINS' then case when data_type = 'STRING_SET' then case when list_contains(json_extract_string(value, '$[*]'), coalesce(word, expected)) then 'PASS' else 'FAIL' end when x.s is null or word is null then 'ERROR' when contains(x.s, word) then 'PASS' else 'FAIL' end
        when e is null then 'ERROR'
        when case operator when 'EQ' then x = e when 'NEQ' then x <> e when 'LT' then x < e when 'DATE_BEFORE' then x < e when 'LTE' then x <= e when 'GT' then x > e when 'DATE_AFTER' then x > e else x >= e end then 'PASS' else 'FAIL' end as result from w)
    {select}"""


add(
    "G1_conditions",
    lambda s, d: R.evaluate(view(s, d, "customer").select(F.col("c_custkey").alias("subject_id"), (F.col("c_custkey") % 2).alias("rule_set")), view(s, d, "rule_conditions"), view(s, d, "attribute_values"), view(s, d, "places")).select("subject_id", "condition_id", "result"),
    rules_sql("select c.c_custkey as subject_id, r.*, a.value, coalesce(a.absent, false) as absent from {customer} c join {rule_conditions} r on r.rule_set = c.c_custkey % 2 left join {attribute_values} a on a.subject_id = c.c_custkey and a.attribute_key = r.attribute_key", "select subject_id, condition_id, result from d"),
)


def folded(s, d, values="attribute_values"):
    """A row per rule set and applicant: results of groups and conditions, causes, root."""
    rules = view(s, d, "set_conditions")
    subjects = view(s, d, "rule_sets").select("subject_id", "rule_set")
    results = R.evaluate(subjects, rules, view(s, d, values), view(s, d, "places"), ["rule_set", "place", "attribute_key", "evidence", "missing"], view(s, d, "rule_cases"))
    return T.fold_sets(results, T.trees(view(s, d, "set_groups").select("rule_set", "group_id", "parent_id", "kind", "position", "own")))


LEVELS = 9  # more than the lines of an order ask for
RESULTS = ("PASS", "FAIL", "UNKNOWN", "ERROR", "NOT_APPLICABLE")


def tree_sql(select: str, values: str = "attribute_values") -> str:
    """The same level by level: ``cond`` (conditions with results), ``lv`` (groups with levels), ``bad``
    (sets that are no tree), ``done`` (results of groups), ``cause``, ``root``."""
    own = f"select o.subject_id, r.*, a.value, coalesce(a.absent, false) as absent from {{set_conditions}} r join {{rule_sets}} o using (rule_set) left join {{{values}}} a on a.subject_id = o.subject_id and a.attribute_key = r.attribute_key"
    head = rules_sql(own, "").rstrip()
    ladder = lambda order, rest: "case " + " ".join(f"when bool_or(r = '{x}') then '{x}'" for x in order) + f" else '{rest}' end"
    flip = lambda x: f"case {x} when 'PASS' then 'FAIL' when 'FAIL' then 'PASS' else {x} end"
    parts = [
        "cond as materialized (select *, value is null and not absent or value = 'null' and not absent as missing from d)",
        "lv as materialized (with recursive w as (select rule_set, group_id, parent_id, kind, 0 as level, lpad(cast(position as varchar), 3, '0') as path from {set_groups} where parent_id is null"
        " union all select g.rule_set, g.group_id, g.parent_id, g.kind, w.level + 1, w.path || lpad(cast(g.position as varchar), 3, '0') from {set_groups} g join w on w.rule_set = g.rule_set and w.group_id = g.parent_id) select * from w)",
        "bad as materialized (select distinct rule_set from {set_groups} g where not exists (select 1 from lv where lv.rule_set = g.rule_set and lv.group_id = g.group_id)"
        " or own + (select count(*) from {set_groups} k where k.rule_set = g.rule_set and k.parent_id = g.group_id) < 1 or kind = 'NOT' and own + (select count(*) from {set_groups} k where k.rule_set = g.rule_set and k.parent_id = g.group_id) <> 1)",
        f"f{LEVELS} as (select rule_set, group_id, parent_id, kind, path, '' as result from lv where false)",
    ]
    for n in range(LEVELS - 1, -1, -1):
        parts.append(f"c{n} as (select rule_set, group_id, case when blocking then result else 'NOT_APPLICABLE' end as r from cond union all select rule_set, parent_id, result from f{n + 1})")
        parts.append(f"f{n} as materialized (select g.rule_set, g.group_id, g.parent_id, g.kind, g.path, case when count(*) filter (r <> 'NOT_APPLICABLE') = 0 then 'NOT_APPLICABLE' when g.kind = 'NOT' then {flip('max(r)')} when g.kind = 'AND' then {ladder(['FAIL', 'ERROR', 'UNKNOWN'], 'PASS')} else {ladder(['PASS', 'ERROR', 'UNKNOWN'], 'FAIL')} end as result"
                     f" from lv g left join c{n} c on c.rule_set = g.rule_set and c.group_id = g.group_id where level = {n} and not exists (select 1 from bad b where b.rule_set = g.rule_set) group by g.rule_set, g.group_id, g.parent_id, g.kind, g.path)")  # fmt: skip
    want = "case kind when 'NOT' then " + flip("f.result") + " else f.result end as want"
    parts.append(f"w0 as (select f.rule_set, f.group_id, {want} from f0 f)")
    for n in range(1, LEVELS):
        parts.append(f"w{n} as (select f.rule_set, f.group_id, {want} from f{n} f join w{n - 1} w on w.rule_set = f.rule_set and w.group_id = f.parent_id and w.want = f.result)")
    parts.append("done as materialized (" + " union all ".join(f"select * from f{n}" for n in range(LEVELS)) + ")")
    parts.append("active as (" + " union all ".join(f"select * from w{n}" for n in range(LEVELS)) + ")")
    parts.append("cause as materialized (select c.rule_set, c.subject_id, c.condition_id, c.verified, row_number() over (partition by c.rule_set order by lv.path, c.place) - 1 as nth from cond c join active a on a.rule_set = c.rule_set and a.group_id = c.group_id and a.want = c.result join lv on lv.rule_set = c.rule_set and lv.group_id = c.group_id where c.blocking)")
    parts.append("root as materialized (select distinct c.rule_set, c.subject_id, s.completeness, s.verification, s.same_version, coalesce(f.result, 'ERROR') as root from cond c join {rule_sets} s using (rule_set) left join f0 f on f.rule_set = c.rule_set)")
    return head + ",\n" + ",\n".join(parts) + "\n" + select


STATUS_SQL = """select rule_set, subject_id, root, case when root = 'ERROR' or exists (select 1 from cond c where c.rule_set = r.rule_set and blocking and result = 'ERROR') then 'NEEDS_REVIEW'
        when root = 'FAIL' then case when exists (select 1 from cause c where c.rule_set = r.rule_set and not verified) then 'NEEDS_REVIEW' else 'INELIGIBLE' end
        when root = 'UNKNOWN' then 'NEEDS_INFORMATION' when root = 'NOT_APPLICABLE' then 'NEEDS_REVIEW'
        when completeness = 'COMPLETE' and verification = 'VERIFIED' and not exists (select 1 from cond c where c.rule_set = r.rule_set and blocking and not verified and result <> 'NOT_APPLICABLE') then 'ELIGIBLE' else 'LIKELY_ELIGIBLE' end as status from root r"""
add("G2_group_fold", lambda s, d: folded(s, d).select("rule_set", "subject_id", F.explode("groups").alias("one_group")).select("rule_set", "subject_id", "one_group.group_id", "one_group.result"),
    tree_sql("select d.rule_set, r.subject_id, d.group_id, d.result from done d join root r using (rule_set)"))
add("G3_causes", lambda s, d: folded(s, d).select("rule_set", "subject_id", F.posexplode("causes").alias("nth", "condition_id")), tree_sql("select rule_set, subject_id, cast(nth as integer) as nth, condition_id from cause"))
add(
    "G4_public_status",
    lambda s, d: T.public_status(folded(s, d), view(s, d, "rule_sets").select("rule_set", "completeness", "verification")),
    tree_sql(STATUS_SQL),
)
add(
    "G5_result_counts",
    lambda s, d: folded(s, d).select("rule_set", "subject_id", *[F.expr(f"cast(if(fault is null, size(filter(conditions, c -> c.result = '{r}')), {int(r == 'ERROR')}) as bigint)").alias(r.lower()) for r in RESULTS]),
    tree_sql("select c.rule_set, c.subject_id, " + ", ".join(f"case when bool_or(b.rule_set is null) then count(*) filter (result = '{r}') else {int(r == 'ERROR')} end as {r.lower()}" for r in RESULTS) + " from cond c left join bad b using (rule_set) group by c.rule_set, c.subject_id"),
)
add(
    "G6_input_hash",
    lambda s, d: R.input_hash(view(s, d, "attribute_values")),
    """select subject_id, sha256('{' || string_agg('"' || attribute_key || '":' || case when absent then 'null' else value end, ',' order by attribute_key) || '}') as hash from {attribute_values} where absent or value is not null group by subject_id""",
)
add(
    "G7_missing_attributes",
    lambda s, d: folded(s, d).filter("fault is null").select(
        "rule_set", "subject_id", F.expr("array_join(array_distinct(transform(filter(conditions, c -> c.result = 'UNKNOWN' and c.missing), c -> c.attribute_key)), ',')").alias("missing"),
        F.expr("if(root = 'FAIL', array_join(causes, ','), '')").alias("blockers"),
    ),
    tree_sql("""select r.rule_set, r.subject_id, coalesce((select string_agg(attribute_key, ',' order by first_at) from (select attribute_key, min(lv.path || '/' || cast(c.place as varchar)) as first_at from cond c join lv on lv.rule_set = c.rule_set and lv.group_id = c.group_id where c.rule_set = r.rule_set and result = 'UNKNOWN' and missing group by attribute_key)), '') as missing,
        case when root = 'FAIL' then coalesce((select string_agg(condition_id, ',' order by nth) from cause c where c.rule_set = r.rule_set), '') else '' end as blockers from root r where not exists (select 1 from bad b where b.rule_set = r.rule_set)"""),
)
add("G8_geo_closure", lambda s, d: R.ancestors(view(s, d, "places")), "with recursive up as (select place_id, place_id as ancestor_id from places0 union all select u.place_id, p.parent_id from up u join places0 p on p.place_id = u.ancestor_id where p.parent_id is not null) select place_id, ancestor_id from up")
SQL["G8_geo_closure"] = "with recursive places0 as (select 'r' || r_regionkey as place_id, null::varchar as parent_id from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation), up as (select place_id, place_id as ancestor_id from places0 union all select u.place_id, p.parent_id from up u join places0 p on p.place_id = u.ancestor_id where p.parent_id is not null) select place_id, ancestor_id from up"
add(
    "G8_area_lists",
    lambda s, d: R.area(view(s, d, "places"), view(s, d, "area_lists")),
    """with named as (select l.list_id, l.mode, p.place_id from {area_lists} l join {places} p on p.place_id = l.place_id or (l.descendants and p.parent_id = l.place_id))
    select distinct list_id, place_id from named n where mode = 'INCLUDE' and not exists (select 1 from named x where x.list_id = n.list_id and x.place_id = n.place_id and x.mode = 'EXCLUDE')""",
)
add(
    "G9_tree_validation",
    lambda s, d: R.tree_errors(view(s, d, "rule_groups"), view(s, d, "rule_leaves")),
    """with recursive g as (select rule_set, group_id, count(*) as copies, max(kind) as kind, max(parent_id) as up, bool_or(parent_id is null) as is_root, count(*) filter (parent_id is null) as roots from groups0 group by rule_set, group_id),
    down as (select rule_set, group_id, 0 as depth from g where is_root union select g.rule_set, g.group_id, down.depth + 1 from down join g on g.rule_set = down.rule_set and g.up = down.group_id and not g.is_root where down.depth < 16),
    kids as (select rule_set, parent_id as group_id, count(*) as n from groups0 where parent_id is not null group by all), leaves as (select rule_set, group_id, sum(n) as n from leaves0 group by all),
    each as (select g.*, coalesce(k.n, 0) + coalesce(l.n, 0) as children, exists (select 1 from down d where d.rule_set = g.rule_set and d.group_id = g.group_id) as reached from g left join kids k using (rule_set, group_id) left join leaves l using (rule_set, group_id))
    select rule_set, case when bool_or(coalesce(group_id, '') = '') then 'EMPTY_GROUP_ID' when bool_or(copies > 1) then 'DUPLICATE_GROUP_ID' when bool_or(children = 0) then 'EMPTY_GROUP' when bool_or(kind = 'NOT' and children <> 1) then 'NOT_NEEDS_ONE_CHILD'
        when sum(roots) <> 1 then 'NO_SINGLE_ROOT' when not bool_and(reached) then 'NOT_CONNECTED' end as error from each group by rule_set""",
)
SQL["G9_tree_validation"] = SQL["G9_tree_validation"].replace("with recursive ", f"with recursive groups0 as ({VIEWS['rule_groups']}), leaves0 as ({VIEWS['rule_leaves']}), ".replace("{lineitem}", "lineitem"), 1)
add("H1_scenario_choice", lambda s, d: M.choose(view(s, d, "offers"), ["project_id"]),
    """with each as (select project_id, scenario_id, has_group and group_result is null as gap,
            case when applicability = 'FAIL' or (has_group and group_result = 'FAIL') then 'FAIL' when applicability = 'UNKNOWN' or (has_group and coalesce(group_result, 'UNKNOWN') = 'UNKNOWN') then 'UNKNOWN' else 'PASS' end as combined from {offers}),
    sums as (select project_id, count(*) > count(distinct scenario_id) as twice, count(*) filter (combined = 'PASS') as passed, count(*) filter (combined = 'UNKNOWN') as unknown, bool_or(gap) as gap, min(scenario_id) filter (combined = 'PASS') as first_pass from each group by project_id)
    select project_id, passed, unknown, case when twice then 'ERROR' when passed > 1 or unknown > 0 then 'NEEDS_INFORMATION' when passed = 1 then 'COMPLETE' else 'SCENARIO_NOT_APPLICABLE' end as status,
        case when twice then 'DUPLICATE_SCENARIO_ID' when passed > 1 then 'MULTIPLE_APPLICABLE_SCENARIOS' when unknown > 0 and gap then 'SCENARIO_CONDITION_GROUP_RESULT_MISSING' when unknown > 0 then 'SCENARIO_APPLICABILITY_UNKNOWN' when passed = 1 then '' else 'NO_APPLICABLE_SCENARIO' end as reason,
        case when not twice and passed = 1 and unknown = 0 then first_pass end as scenario_id from sums""")  # fmt: skip
add(
    "H2_gated_group_result",
    lambda s, d: T.gated_groups(folded(s, d, "trusted_values"), view(s, d, "rule_sets").drop("subject_id")),
    tree_sql("""select r.rule_set, why.reason, g.group_id, case when why.reason is not null then null when r.completeness = 'COMPLETE' and r.verification = 'VERIFIED' and g.result in ('PASS', 'FAIL') and g.n > 0 and g.good = g.n then g.result else 'UNKNOWN' end as group_result
        from (select *, case when not same_version then 'GRANT_CALL_VERSION_MISMATCH' when root = 'ERROR' or exists (select 1 from cond c where c.rule_set = r.rule_set and result = 'ERROR') then 'ELIGIBILITY_EVALUATION_ERROR' end as reason from root r) why
        join root r on r.rule_set = why.rule_set left join (select d.rule_set, d.group_id, d.result, count(c.condition_id) as n, count(*) filter (c.verified and c.evidence and c.result in ('PASS', 'FAIL')) as good
            from done d join lv on lv.rule_set = d.rule_set and starts_with(lv.path, d.path) left join cond c on c.rule_set = lv.rule_set and c.group_id = lv.group_id group by all) g on g.rule_set = r.rule_set and why.reason is null""", "trusted_values"),
)
add(
    "H3_finance",
    lambda s, d: M.evaluate(view(s, d, "funded")).select("project_id", "scenario_id", "status", "reasons", "max_grant", "own_eligible", "minimum_cash", "prefinancing"),
    """with g as (select *, least((eligible_minor * rate_bps) // 10000, cap_minor) as grant_, concat_ws(',', case when eligible_minor is null then 'MISSING_ELIGIBLE_COSTS' end, case when ineligible_minor is null then 'MISSING_INELIGIBLE_COSTS' end, case when vat_minor is null then 'MISSING_NONRECOVERABLE_VAT' end, case when rate_bps is null then 'MISSING_SUPPORT_RATE_MAX' end) as missing from {funded}),
    r as (select *, case when has_group and group_result is null then 'NEEDS_INFORMATION|SCENARIO_CONDITION_GROUP_RESULT_MISSING' when has_group and group_result = 'UNKNOWN' then 'NEEDS_INFORMATION|SCENARIO_APPLICABILITY_UNKNOWN' when has_group and group_result = 'FAIL' then 'SCENARIO_NOT_APPLICABLE|SCENARIO_CONDITIONS_FAIL'
        when instrument <> 'GRANT' then 'INSTRUMENT_NOT_SUPPORTED|INSTRUMENT_LOAN_REQUIRES_SPECIALIZED_ENGINE' when currency <> 'CZK' then 'ERROR|CURRENCY_MISMATCH' when applicability = 'FAIL' then 'SCENARIO_NOT_APPLICABLE|SCENARIO_CONDITIONS_FAIL' when applicability = 'UNKNOWN' then 'NEEDS_INFORMATION|SCENARIO_APPLICABILITY_UNKNOWN'
        when missing <> '' then 'NEEDS_INFORMATION|' || missing when eligible_minor + ineligible_minor + vat_minor <> total_minor then 'ERROR|PROJECT_COST_COMPONENTS_DO_NOT_SUM_TO_TOTAL' when total_minor < cost_min_minor then 'SCENARIO_NOT_APPLICABLE|PROJECT_COST_BELOW_MINIMUM' when total_minor > cost_max_minor then 'SCENARIO_NOT_APPLICABLE|PROJECT_COST_ABOVE_MAXIMUM'
        when grant_ < min_minor then 'SCENARIO_NOT_APPLICABLE|CALCULATED_GRANT_BELOW_MINIMUM' when payment_mode = 'UNKNOWN' then 'COMPLETE|PREFINANCING_RULE_UNKNOWN' else 'COMPLETE|' end as x from g)
    select project_id, scenario_id, split_part(x, '|', 1) as status, split_part(x, '|', 2) as reasons, case when x like 'COMPLETE%' then grant_ end as max_grant, case when x like 'COMPLETE%' then eligible_minor - grant_ end as own_eligible,
        case when x like 'COMPLETE%' then eligible_minor - grant_ + ineligible_minor + vat_minor end as minimum_cash, case when x like 'COMPLETE%' and payment_mode = 'REIMBURSEMENT' and not advance_allowed then total_minor end as prefinancing from r""",
)
EVENTS = " union all ".join(
    f"select call_id, version_number, '{p}' as field_path, '{k}' as change_type, '{v}' as severity, cast({o} as varchar) as old_value, cast({n} as varchar) as new_value from {{steps}} where old_number is not null and {o} is distinct from {n}" for p, n, o, k, v in C.SCALARS
) + " union all select call_id, version_number, 'status', 'STATUS_CHANGED', case when status in ('PAUSED', 'CLOSED', 'CANCELLED') then 'CRITICAL' else 'IMPORTANT' end, old_status, status from {steps} where old_number is not null and old_status is distinct from status"
add("I1_scalar_diff", lambda s, d: C.scalar_events(view(s, d, "steps")), f"select *, left(sha256(concat(call_id, chr(31), version_number, chr(31), field_path, chr(31), change_type)), 24) as event_id from ({EVENTS})")
add("I2_set_diff", lambda s, d: view(s, d, "requirements").groupBy("call_id", "version_number").agg(F.array_sort(F.collect_set("title")).alias("a")).withColumn("old", F.lag("a").over(Window.partitionBy("call_id").orderBy("version_number"))).filter("old is not null and old <> a").select("call_id", "version_number", F.array_join(F.array_except("a", "old"), ",").alias("added"), F.array_join(F.array_except("old", "a"), ",").alias("removed")),
    "select call_id, version_number, array_to_string(list_filter(a, lambda x: not list_contains(old, x)), ',') as added, array_to_string(list_filter(old, lambda x: not list_contains(a, x)), ',') as removed from (select *, lag(a) over (partition by call_id order by version_number) as old from (select call_id, version_number, list_sort(list(distinct title)) as a from {requirements} group by all)) where old is not null and old <> a")


def keyed_diff(s, d):
    """Steps of requirements and documents, under the field's path."""
    newest = view(s, d, "versions").groupBy("call_id").agg(F.max("version_number").alias("newest"))
    told = lambda name, key, value: view(s, d, name).select("call_id", "version_number", F.concat(F.lit("documents." if key == "document_id" else "requirements."), key).alias("field_path"), F.col(value).alias("x"))
    return C.keyed_steps(told("requirements", "requirement_id", "title").unionByName(told("version_documents", "document_id", "digest")), newest, "field_path", "x")


KEYED_SQL = """with v as materialized (select call_id, version_number from {versions}), r as materialized (select call_id, version_number, 'requirements.' || requirement_id as field_path, title as x from {requirements}
        union all select call_id, version_number, 'documents.' || document_id, digest from {version_documents}),
    o as materialized (select r.call_id, r.version_number + 1 as version_number, field_path, x from r join v on v.call_id = r.call_id and v.version_number = r.version_number + 1)
    select call_id, version_number, field_path, 'ADDED' as change, null as old_value, x as new_value from r where version_number > 1 and not exists (select 1 from o where o.call_id = r.call_id and o.version_number = r.version_number and o.field_path = r.field_path)
    union all select call_id, version_number, field_path, 'REMOVED', x, null from o where not exists (select 1 from r where o.call_id = r.call_id and o.version_number = r.version_number and o.field_path = r.field_path)
    union all select o.call_id, o.version_number, o.field_path, 'CHANGED', o.x, r.x from o join r using (call_id, version_number, field_path) where o.x is distinct from r.x"""
add("I3_keyed_diff", keyed_diff, KEYED_SQL)
add("I5_event_order", lambda s, d: C.event_order(view(s, d, "steps")),
    f"select call_id, version_number, field_path, row_number() over (partition by call_id, version_number order by case severity when 'CRITICAL' then 0 when 'IMPORTANT' then 1 when 'INFORMATIONAL' then 2 else 3 end, field_path) as place from ({EVENTS})")
#: What is known of a watch's applicant for a call's version, as SQL over watch_id, call_id and v.
KNOWN = ["""case (watch_id + 3 * call_id + {v}) % 7 when 0 then 'INELIGIBLE' when 1 then 'NEEDS_REVIEW' when 2 then 'NEEDS_INFORMATION' when 3 then null when 4 then 'LIKELY_ELIGIBLE' else 'ELIGIBLE' end as eligibility""",
    """case (2 * watch_id + call_id + {v}) % 8 when 0 then 'SCENARIO_NOT_APPLICABLE' when 1 then 'ERROR' when 2 then 'INSTRUMENT_NOT_SUPPORTED' when 3 then 'NEEDS_INFORMATION' when 4 then null else 'COMPLETE' end as finance"""]
#: Which matches were there before: for some calls that of the version before, for some one of the same version.
CURRENT, BEFORE, SAME = "version_number = newest", "call_id % 3 = 1 and version_number = newest - 1", "call_id % 3 = 0 and version_number = newest"


def hits(s, d, which=CURRENT):
    """Versions x enabled watches with any hit of the intent's first 20 tokens."""
    watches = view(s, d, "watches")
    return P.percolate(view(s, d, "version_texts").filter(which), watches, P.intent_index(watches))


def known(hits, v="version_number"):
    return hits.selectExpr("*", *[x.format(v=v) for x in KNOWN])


def matches(s, d):
    """Hits of current versions judged by band, eligibility and finance."""
    watches = view(s, d, "watches")
    found = P.percolate(view(s, d, "version_texts").filter(CURRENT), P.watched(watches, view(s, d, "watches_now")), P.intent_index(watches), "now")
    return P.judged(known(found))


def acted(s, d):
    """Matches of current versions against those that were there before. Both come from one search and
    meet by intent and call, before watches share them; then a match and the one before are one row."""
    watches, at = view(s, d, "watches"), F.struct("version_number", "coverage")
    texts = view(s, d, "version_texts").filter(f"({CURRENT}) or ({BEFORE})")
    found, is_now = P.found(texts, P.intent_index(watches), "newest"), F.col("version_number") == F.col("newest")
    pair = found.groupBy("intent", "call_id").agg(F.max(F.when(is_now, at)).alias("this"), F.max(F.when(~is_now, at)).alias("before")).filter("this is not null")
    # of some calls the match before is of the same version, judged by what was known then
    pair = pair.withColumn("before", F.expr("if(call_id % 3 = 0, this, before)"))
    hits = P.fanned(pair, P.watched(watches, view(s, d, "watches_now")), "now")
    old = P.judged(known(hits.select("*", "before.*"), "(version_number + if(call_id % 3 = 0, watch_id % 2, 0))"))
    told = P.once(old, "dedupe_key").select("watch_id", "call_id", "now", "this.*", F.col("dedupe_key").alias("old_key"))
    return P.once(P.judged(known(told)), "status", "candidate", "dedupe_key").withColumn("action", P.action("old_key", "dedupe_key"))


WORDS = lambda c: f"list_filter(string_split({fold(c)}, ' '), lambda x: x <> '')"
def hits_sql(which: str) -> str:
    """The same by comparing distinct tokens with distinct words."""
    return f"""with own0 as (select watch_id, {WORDS('intent')}[1:20] as ts from {{watches}} where enabled), own as materialized (select watch_id, len(ts) as n, unnest(ts) as token from own0),
    terms as materialized (select distinct call_id, version_number, unnest({WORDS('text')}) as term from {{version_texts}} where status in ('OPEN', 'PLANNED', 'ANNOUNCED') and {which}),
    pairs as materialized (select t.token, w.term from (select distinct token from own) t join (select distinct term from terms) w on left(w.term, 2) = left(t.token, 2) and (w.term = t.token or (length(t.token) >= 3 and starts_with(w.term, t.token)))),
    hits as (select distinct token, call_id, version_number from pairs join terms using (term))
    select watch_id, call_id, version_number, round(count(*) / first(n), 6) as coverage from own join hits using (token) group by watch_id, call_id, version_number"""


add("I6_watch_fanout", hits, hits_sql(CURRENT))
STATUS = """case when not enabled then 'NOT_RELEVANT' when (case band when 'WEAK' then 0 when 'POSSIBLE' then 1 else 2 end) < (case minimum_band when 'WEAK' then 0 when 'POSSIBLE' then 1 else 2 end) then 'NOT_RELEVANT' when eligibility = 'INELIGIBLE' then 'NOT_ELIGIBLE' when eligibility = 'NEEDS_REVIEW' then 'NEEDS_REVIEW'
    when eligibility is null or eligibility = 'NEEDS_INFORMATION' then 'NEEDS_INFORMATION' when finance = 'SCENARIO_NOT_APPLICABLE' then 'NOT_FINANCIALLY_COMPATIBLE' when finance in ('ERROR', 'INSTRUMENT_NOT_SUPPORTED') then 'NEEDS_REVIEW' when finance is null or finance = 'NEEDS_INFORMATION' then 'NEEDS_INFORMATION' else 'MATCHED' end"""
def matches_sql(which: str, v: str = "version_number") -> str:
    band = "case when round(0.45 * coverage / 0.8, 6) >= 0.7 then 'VERY_GOOD' when round(0.45 * coverage / 0.8, 6) >= 0.35 then 'POSSIBLE' else 'WEAK' end as band"
    told = f"select h.*, w.enabled, w.minimum_band, {band}, {', '.join(KNOWN).format(v=v)} from ({hits_sql(which)}) h join {{watches_now}} w using (watch_id)"
    return f"select *, 'watch:' || watch_id || ':call:' || call_id || ':version:' || version_number || ':status:' || status as dedupe_key from (select *, {STATUS} as status from ({told}) t0) t1"


ACTED = f"""select m.*, status in ('MATCHED', 'NEEDS_INFORMATION') as candidate, case when o.dedupe_key is null then 'CREATED' when o.dedupe_key = m.dedupe_key then 'UNCHANGED' else 'UPDATED' end as action
    from ({matches_sql(CURRENT)}) m left join (select watch_id, call_id, dedupe_key from ({matches_sql(BEFORE)}) b0 union all select watch_id, call_id, dedupe_key from ({matches_sql(SAME, "version_number + watch_id % 2")}) s0) o using (watch_id, call_id)"""
add("I7_watch_decision", lambda s, d: matches(s, d).select("watch_id", "call_id", "version_number", "band", "status", F.array_join("reasons", ",").alias("reasons"), "candidate"),
    f"select watch_id, call_id, version_number, band, status, concat_ws(',', 'RELEVANCE_' || band, 'WATCH_STATUS_' || status, coalesce('ELIGIBILITY_' || eligibility, 'ELIGIBILITY_NOT_EVALUATED'), coalesce('FINANCE_' || finance, 'FINANCE_NOT_EVALUATED')) as reasons, status in ('MATCHED', 'NEEDS_INFORMATION') as candidate from ({matches_sql(CURRENT)}) m")
add("I8_match_action", lambda s, d: acted(s, d).select("watch_id", "call_id", "version_number", "status", "action"), f"select watch_id, call_id, version_number, status, action from ({ACTED}) a0")
add("I9_match_notifications", lambda s, d: P.notifications(acted(s, d)),
    f"select watch_id, call_id, version_number, case status when 'MATCHED' then 'NEW_MATCHING_GRANT' else 'MATCH_NEEDS_INFORMATION' end as kind, case status when 'MATCHED' then 'IMPORTANT' else 'INFO' end as severity, 'watch-match:' || dedupe_key as dedupe_base from ({ACTED}) a0 where candidate and action <> 'UNCHANGED'")
add("I10_change_notifications", lambda s, d: C.scalar_events(view(s, d, "steps")).filter("severity <> 'EDITORIAL'").select("event_id", "severity", F.concat_ws(" → ", F.coalesce("old_value", F.lit("?")), F.coalesce("new_value", F.lit("?"))).alias("body"), F.col("severity").isin("CRITICAL", "IMPORTANT").alias("push")),
    f"select left(sha256(concat(call_id, chr(31), version_number, chr(31), field_path, chr(31), change_type)), 24) as event_id, severity, coalesce(old_value, '?') || ' → ' || coalesce(new_value, '?') as body, severity in ('CRITICAL', 'IMPORTANT') as push from ({EVENTS}) where severity <> 'EDITORIAL'")
def reminders(s, d):
    """Calls due in so many days, unless the reminder has been sent already."""
    due = view(s, d, "versions").withColumn("days", F.date_diff("close_at", F.lit("1997-01-01").cast("date"))).filter(F.col("days").isin(60, 30, 14, 7, 3, 1))
    sent = view(s, d, "versions").filter("quantity % 3 = 0").select("call_id", "version_number", F.lit(30).alias("days")).distinct()
    return due.join(sent, ["call_id", "version_number", "days"], "left_anti").select("call_id", "version_number", F.col("days").cast("long").alias("days"), F.when(F.col("days") <= 3, "CRITICAL").otherwise("IMPORTANT").alias("severity"))


add("I11_deadline_reminders", reminders,
    "select call_id, version_number, (close_at - date '1997-01-01')::bigint as days, case when close_at - date '1997-01-01' <= 3 then 'CRITICAL' else 'IMPORTANT' end as severity from {versions} where close_at - date '1997-01-01' in (60, 30, 14, 7, 3, 1) and not (quantity % 3 = 0 and close_at - date '1997-01-01' = 30)")
add("I12_channels", lambda s, d: view(s, d, "outbox").select("dedupe_key", F.explode(F.when(F.col("user_id") % 4 == 0, F.array(F.lit("IN_APP"), F.lit("WEB_PUSH"))).otherwise(F.array(F.lit("IN_APP")))).alias("channel")).dropDuplicates(["dedupe_key", "channel"]),
    "select distinct dedupe_key, unnest(case when user_id % 4 = 0 then ['IN_APP', 'WEB_PUSH'] else ['IN_APP'] end) as channel from {outbox}")
add("I13_feed", lambda s, d: view(s, d, "outbox").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))).filter("r <= 50").select("user_id", "event_id", "r"),
    "select user_id, event_id, r from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from {outbox}) where r <= 50")
def project_feed(s, d):
    """A project's newest 50 matches of versions that are still current."""
    m = C.watch_status(view(s, d, "candidates")).filter("candidate").join(view(s, d, "current_calls").select("call_id", "version_number"), ["call_id", "version_number"])
    m = m.join(view(s, d, "watches").select("watch_id", "project_id"), "watch_id")
    return m.withColumn("r", F.row_number().over(Window.partitionBy("project_id").orderBy(F.col("version_number").desc(), "call_id", "watch_id"))).filter("r <= 50").select("project_id", "watch_id", "call_id", "version_number", "r")


add("I13_project_feed", project_feed,
    f"""select project_id, watch_id, call_id, version_number, r from (select *, row_number() over (partition by project_id order by version_number desc, call_id, watch_id) as r from (select m.watch_id, m.call_id, m.version_number, project_id from (select *, {STATUS} as verdict from {{candidates}}) m join {{current_calls}} n using (call_id, version_number) join {{watches}} w on w.watch_id = m.watch_id where verdict in ('MATCHED', 'NEEDS_INFORMATION'))) where r <= 50""")
add("I14_effective_order", lambda s, d: view(s, d, "versions").withColumn("current", F.col("status") == "OPEN").withColumn("place", F.row_number().over(Window.partitionBy("call_id").orderBy(F.col("current").desc(), F.col("version_number").desc()))).select("call_id", "version_number", "place"),
    "select call_id, version_number, row_number() over (partition by call_id order by status = 'OPEN' desc, version_number desc) as place from {versions}")
