"""Rule sets kept as data: any tree of groups over conditions, folded in one row per applicant.

A set's groups (64 at most) and an applicant's condition results (128 at most) are gathered into
arrays by one shuffle each; levels, faults, results and causes are then array expressions, so no
join is repeated per level and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 16
FLIP = "case {0} when 'PASS' then 'FAIL' when 'FAIL' then 'PASS' else {0} end"


def once(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with further columns (SQL), each worked out once a row. As plain columns they would be put into
    the expressions that read them, and those read them in lambdas: once per item."""
    return df.select("*", F.inline(F.array(F.struct(*[F.expr(e).alias(name) for name, e in columns.items()]))))


def with_paths(groups: str, depth: int = DEPTH) -> str:
    """SQL of an array of groups (group_id, parent_id, kind, position, own) with ``path``, the
    positions from the root down to the group, null where no root is found within ``depth``
    steps; paths sort in the order of evaluation, a group before what lies below it."""
    at = f"filter({groups}, y -> y.group_id = a.up)"
    found = "if(size(u) > 0, named_struct('up', u[0].parent_id, 'path', concat(lpad(cast(u[0].position as string), 6, '0'), '/', a.path)), a)"
    step = f"if(a.up is not null, transform(array({at}), u -> {found})[0], a)"
    start = "named_struct('up', g.parent_id, 'path', concat(lpad(cast(g.position as string), 6, '0'), '/'))"
    found = f"aggregate(sequence(1, {depth}), {start}, (a, i) -> {step}, a -> if(a.up is null, a.path, null))"
    return f"transform({groups}, g -> named_struct('path', {found}, 'group_id', g.group_id, 'parent_id', g.parent_id, 'kind', g.kind, 'own', g.own))"


def trees(groups: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(rule_set, tree, fault): a set's groups with paths, and the first reason why it is no tree, if
    any. ``groups``: (rule_set, group_id, parent_id, kind, position); ``own``: (rule_set, group_id, n),
    how many conditions a group has; without it ``groups`` tell that themselves, as ``own``."""
    counted = groups if own is None else groups.join(own, ["rule_set", "group_id"], "left").withColumn("own", F.coalesce("n", F.lit(0)))
    sets = counted.groupBy("rule_set").agg(F.sort_array(F.collect_list(F.struct("position", "group_id", "parent_id", "kind", "own"))).alias("gs"))
    sets = once(sets, tree=with_paths("gs"))
    kids = "g.own + size(filter(tree, y -> y.parent_id = g.group_id))"
    faults = [
        ("exists(tree, g -> coalesce(g.group_id, '') = '')", "EMPTY_GROUP_ID"),
        ("size(array_distinct(transform(tree, g -> g.group_id))) < size(tree)", "DUPLICATE_GROUP_ID"),
        (f"exists(tree, g -> {kids} = 0)", "EMPTY_GROUP"),
        (f"exists(tree, g -> g.kind = 'NOT' and {kids} <> 1)", "NOT_NEEDS_ONE_CHILD"),
        ("size(filter(tree, g -> g.parent_id is null)) <> 1", "NO_SINGLE_ROOT"),
        ("exists(tree, g -> g.path is null)", "NOT_CONNECTED"),
    ]
    return sets.select("rule_set", "tree", F.expr("case " + " ".join(f"when {test} then '{name}'" for test, name in faults) + " end").alias("fault"))


def fold_sets(results: DataFrame, trees: DataFrame) -> DataFrame:
    """(rule_set, subject_id, fault, groups, conditions, causes, root): every group's result from the
    leaves up, the conditions in the order of evaluation, and the blocking ones whose result explains
    the root. ``results``: (rule_set, subject_id, group_id, place, condition_id, result, blocking) and
    what else a condition tells. Sets with a fault have the root ERROR and no groups or causes.

    Conditions that do not block count as NOT_APPLICABLE, which drops out: AND is FAIL, ERROR,
    UNKNOWN, else PASS; OR is PASS, ERROR, UNKNOWN, else FAIL; NOT swaps PASS and FAIL."""
    more = [c for c in results.columns if c not in ("rule_set", "subject_id", "group_id", "place")]
    # dealt by set alone, so that neither the grouping nor the join with the trees moves them again
    own = results.repartition("rule_set").groupBy("rule_set", "subject_id").agg(F.collect_list(F.struct("group_id", "place", *more)).alias("cs"))
    df = own.join(trees, "rule_set")
    fields = ", ".join(f"'{c}', c.{c}" for c in ["group_id", *more])
    path = "filter(tree, g -> g.group_id = c.group_id)[0].path"
    df = once(df, conditions=f"sort_array(transform(cs, c -> named_struct('path', {path}, 'place', c.place, {fields})))")
    kids = """filter(concat(transform(filter(conditions, c -> c.group_id = g.group_id), c -> if(c.blocking, c.result, 'NOT_APPLICABLE')),
        transform(filter(done, d -> d.parent_id = g.group_id), d -> d.result)), r -> r <> 'NOT_APPLICABLE')"""
    ladder = lambda order, rest: "case " + " ".join(f"when array_contains(k, '{r}') then '{r}'" for r in order) + f" else '{rest}' end"
    result = f"""transform(array({kids}), k -> case when size(k) = 0 then 'NOT_APPLICABLE' when g.kind = 'NOT' then {FLIP.format("k[0]")}
        when g.kind = 'AND' then {ladder(["FAIL", "ERROR", "UNKNOWN"], "PASS")} else {ladder(["PASS", "ERROR", "UNKNOWN"], "FAIL")} end)[0]"""
    item = "named_struct('group_id', g.group_id, 'parent_id', g.parent_id, 'kind', g.kind, 'path', g.path, 'result', {0})"
    none = "cast(array() as array<struct<group_id:string,parent_id:string,kind:string,path:string,result:string>>)"
    # the longer a path, the lower the group: sorted by length, children come before their parents
    order = "array_sort(tree, (x, y) -> coalesce(length(y.path), 0) - coalesce(length(x.path), 0))"
    df = once(df, groups=f"if(fault is null, aggregate({order}, {none}, (done, g) -> concat(done, array({item.format(result)}))), {none})")
    want = "if(g.kind = 'NOT', " + FLIP.format("g.result") + ", g.result)"
    active = f"""aggregate(reverse(groups), cast(array() as array<struct<group_id:string,want:string>>), (up, g) -> if(g.parent_id is null or exists(up, a -> a.group_id = g.parent_id and a.want = g.result),
        concat(up, array(named_struct('group_id', g.group_id, 'want', {want}))), up))"""
    causes = "transform(filter(conditions, c -> c.blocking and exists(active, a -> a.group_id = c.group_id and a.want = c.result)), c -> c.condition_id)"
    df = df.withColumn("causes", F.expr(f"transform(array({active}), active -> {causes})[0]"))
    root = F.expr("if(fault is null, element_at(groups, -1).result, 'ERROR')")
    return df.select("rule_set", "subject_id", "fault", "groups", "conditions", "causes", root.alias("root"))


BLOCKING = "filter(conditions, c -> c.blocking)"
STATUS = f"""case when root = 'ERROR' or exists({BLOCKING}, c -> c.result = 'ERROR') then 'NEEDS_REVIEW'
    when root = 'FAIL' then if(arrays_overlap(causes, transform(filter({BLOCKING}, c -> not c.verified), c -> c.condition_id)), 'NEEDS_REVIEW', 'INELIGIBLE')
    when root = 'UNKNOWN' then 'NEEDS_INFORMATION' when root = 'NOT_APPLICABLE' then 'NEEDS_REVIEW'
    when completeness = 'COMPLETE' and verification = 'VERIFIED' and forall({BLOCKING}, c -> c.verified or c.result = 'NOT_APPLICABLE') then 'ELIGIBLE' else 'LIKELY_ELIGIBLE' end"""


def public_status(folded: DataFrame, sets: DataFrame) -> DataFrame:
    """(rule_set, subject_id, root, status). ``sets``: (rule_set, completeness, verification); the
    conditions of ``folded`` tell whether they are ``verified``."""
    return folded.join(sets, "rule_set").select("rule_set", "subject_id", "root", F.expr(STATUS).alias("status"))


def eligibility_tasks(folded: DataFrame, sets: DataFrame) -> DataFrame:
    """(rule_set, subject_id, reference_id, task): where information is missing one PROVIDE_INPUT per
    unknown blocking condition; else, or where there is none, one REVIEW_STATUS for any status but ELIGIBLE."""
    gaps = f"if(status = 'NEEDS_INFORMATION', transform(filter({BLOCKING}, c -> c.result = 'UNKNOWN'), c -> named_struct('reference_id', c.condition_id, 'task', 'PROVIDE_INPUT')), array())"
    whole = "if(status = 'ELIGIBLE', array(), array(named_struct('reference_id', status, 'task', 'REVIEW_STATUS')))"
    df = folded.join(sets, "rule_set").withColumn("status", F.expr(STATUS)).withColumn("gaps", F.expr(gaps))
    return df.select("rule_set", "subject_id", F.explode(F.expr(f"if(size(gaps) > 0, gaps, {whole})")).alias("one_task")).select("rule_set", "subject_id", "one_task.reference_id", "one_task.task")


def gated_groups(folded: DataFrame, sets: DataFrame) -> DataFrame:
    """(rule_set, reason, group_id, group_result): per group PASS or FAIL where the set is complete and
    verified and every condition at or below the group is verified, has evidence and is itself PASS
    or FAIL; else UNKNOWN. A set of another version, with a fault or with any ERROR is blocked: one
    row with the reason. ``folded`` is to come from trusted inputs alone; ``sets``: (rule_set,
    completeness, verification, same_version)."""
    df = folded.join(sets, "rule_set")
    reason = F.expr("case when not same_version then 'GRANT_CALL_VERSION_MISMATCH' when root = 'ERROR' or exists(conditions, c -> c.result = 'ERROR') then 'ELIGIBILITY_EVALUATION_ERROR' end")
    below = "filter(conditions, c -> startswith(c.path, g.path))"
    trusted = f"completeness = 'COMPLETE' and verification = 'VERIFIED' and size({below}) > 0 and forall({below}, c -> c.verified and c.evidence and c.result in ('PASS', 'FAIL'))"
    rows = f"transform(groups, g -> named_struct('group_id', g.group_id, 'group_result', if({trusted} and g.result in ('PASS', 'FAIL'), g.result, 'UNKNOWN')))"
    df = df.select("rule_set", reason.alias("reason"), F.expr(rows).alias("rows"))
    one = "array(named_struct('group_id', cast(null as string), 'group_result', cast(null as string)))"
    return df.select("rule_set", "reason", F.explode(F.expr(f"if(reason is null, rows, {one})")).alias("one_group")).select("rule_set", "reason", "one_group.group_id", "one_group.group_result")
