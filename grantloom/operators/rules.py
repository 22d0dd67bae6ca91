"""Eligibility rules with explicit unknowns: PASS, FAIL, UNKNOWN, ERROR, NOT_APPLICABLE.

SQL null never stands for UNKNOWN: every result is one of the five words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantloom.operators.rule_trees import once


def condition(presence: Column, typed_ok: Column, holds: Column, operator: Column, unknown_policy: Column) -> Column:
    """One condition's result. ``presence``: PRESENT, ABSENT (known) or MISSING; ``typed_ok``: the
    value has the attribute's type; ``holds``: the comparison on the typed value, null if it
    cannot be decided."""
    return (
        F.when(presence == "MISSING", F.when(unknown_policy == "NOT_APPLICABLE", "NOT_APPLICABLE").otherwise("UNKNOWN"))
        .when(presence == "ABSENT", F.when(operator == "EXISTS", "FAIL").when(operator == "NOT_EXISTS", "PASS").otherwise("UNKNOWN"))
        .when(~typed_ok, "ERROR")
        .when(operator == "EXISTS", "PASS")
        .when(operator == "NOT_EXISTS", "FAIL")
        .when(holds.isNull(), "UNKNOWN")
        .when(holds, "PASS")
        .otherwise("FAIL")
    )


def compare(x: Column, operator: Column, low: Column, high: Column, items: Column) -> Column:
    """The scalar operators on one type family; BETWEEN with reversed bounds is null, which the
    caller turns into ERROR through ``typed_ok``."""
    return (
        F.when(operator == "EQ", x == low).when(operator == "NEQ", x != low)
        .when(operator.isin("LT", "DATE_BEFORE"), x < low).when(operator == "LTE", x <= low).when(operator.isin("GT", "DATE_AFTER"), x > low).when(operator == "GTE", x >= low)
        .when(operator == "BETWEEN", F.when(low <= high, x.between(low, high)))
        .when(operator == "IN", F.array_contains(items, x)).when(operator == "NOT_IN", ~F.array_contains(items, x))
    )


TEXT, WHOLE = ["STRING", "ENUM", "GEO_ID"], ["INTEGER", "MONEY_MINOR", "PERCENT_BPS"]
STRINGS = r'^\[\s*("([^"\\]|\\.)*"(\s*,\s*"([^"\\]|\\.)*")*)?\s*\]$'


def text_of(raw: Column) -> Column:
    """The text of a JSON string; null for anything else."""
    return F.when(raw.rlike('^".*"$'), F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v"))


def items_of(raw: Column) -> Column:
    """The JSON texts of an array's items; null for anything else."""
    return F.when(raw.startswith("["), F.transform(F.from_json(raw, "array<variant>"), lambda i: F.to_json(i)))


def typed(raw: Column, kind: Column) -> Column:
    """A JSON text as (s, n, f), of which its type uses one, so that all types compare alike; null
    if the text is not of the type: nothing is converted (``"7"`` is no integer, 1 no boolean)."""
    s = text_of(raw)
    day = F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.unix_date(F.try_to_date(s, "yyyy-MM-dd")))
    instant = F.unix_micros(F.try_to_timestamp(s))
    words = F.when(raw.rlike(STRINGS), F.array_join(F.array_sort(F.array_distinct(F.from_json(raw, "array<string>"))), "\x01"))
    n = F.when(kind.isin(WHOLE), F.when(raw.rlike("^-?[0-9]+$"), raw.try_cast("decimal(38,0)"))).when(kind == "BOOLEAN", F.when(raw == "true", 1).when(raw == "false", 0).cast("decimal(38,0)"))
    n = n.when(kind == "DATE", day.cast("decimal(38,0)")).when(kind == "DATETIME", F.when(s.rlike("^[0-9]{4}-"), instant.cast("decimal(38,0)")))
    f = F.when(kind == "NUMBER", F.when(raw.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), raw.try_cast("double")))
    own = F.when(kind.isin(TEXT), s).when(kind == "STRING_SET", words)
    return F.when(own.isNotNull() | n.isNotNull() | f.isNotNull(), F.struct(own.alias("s"), n.alias("n"), f.alias("f")))


def prepared(rules: DataFrame) -> DataFrame:
    """Rules with what their expected values are, so that it is worked out once for all subjects:
    the typed value ``e``, its text ``word``, an array's typed ``items`` and their texts ``loose``;
    ``whole`` if all items are of the type."""
    kind, expected = F.col("data_type"), F.col("expected")
    df = rules.withColumn("raw", items_of(expected)).withColumn("e", typed(expected, kind)).withColumn("word", text_of(expected))
    df = df.withColumn("items", F.transform("raw", lambda i: typed(i, kind))).withColumn("loose", F.transform("raw", lambda i: F.coalesce(text_of(i), i)))
    return df.withColumn("whole", F.col("raw").isNotNull() & ~F.exists("items", lambda i: i.isNull())).drop("raw")


def applied(within: Column) -> Column:
    """A present value under one of the 17 operators: PASS, FAIL, UNKNOWN or ERROR; over the columns
    of :func:`prepared`, ``value`` and the value typed as ``x``. ``within``: whether the value's
    place lies in the expected one, null if either is unknown."""
    x, e, items, word, whole, kind, operator = (F.col(c) for c in ("x", "e", "items", "word", "whole", "data_type", "operator"))
    low, high, own = F.get(items, F.lit(0)), F.get(items, F.lit(1)), F.from_json("value", "array<string>")
    dates, words = kind.isin("DATE", "DATETIME"), kind == "STRING_SET"
    result = lambda holds: F.when(holds, "PASS").otherwise("FAIL")
    given = lambda ok, holds: F.when(F.coalesce(ok, F.lit(False)), result(holds)).otherwise("ERROR")
    there = e.isNotNull()
    ops = [
        (["EXISTS"], F.lit("PASS")), (["NOT_EXISTS"], F.lit("FAIL")),
        (["EQ"], given(there, x == e)), (["NEQ"], given(there, x != e)), (["LT"], given(there, x < e)), (["LTE"], given(there, x <= e)), (["GT"], given(there, x > e)), (["GTE"], given(there, x >= e)),
        (["DATE_BEFORE"], given(dates & there, x < e)), (["DATE_AFTER"], given(dates & there, x > e)),
        (["BETWEEN"], given(whole & (F.size(items) == 2) & (low <= high), (low <= x) & (x <= high))),
        (["IN"], given(whole, F.array_contains(items, x))), (["NOT_IN"], given(whole, ~F.array_contains(items, x))),
        (["INTERSECTS"], given(words & F.col("loose").isNotNull(), F.arrays_overlap(own, F.col("loose")))),
        (["CONTAINS"], F.when(kind.isin(TEXT), given(word.isNotNull(), F.contains(x["s"], word))).when(words, result(F.array_contains(own, F.coalesce(word, F.col("expected"))))).otherwise("ERROR")),
        (["GEO_WITHIN", "GEO_NOT_WITHIN"], F.when((kind != "GEO_ID") | e.isNull(), "ERROR").when(within.isNull(), "UNKNOWN").otherwise(result(within == (operator == "GEO_WITHIN")))),
    ]
    out = F.lit("ERROR")
    for names, r in reversed(ops):
        out = F.when(operator.isin(names), r).otherwise(out)
    return F.when(x.isNull(), "ERROR").otherwise(out)


def evaluate(subjects: DataFrame, rules: DataFrame, values: DataFrame, places: DataFrame, keep: list[str] | tuple = (), cases: DataFrame | None = None) -> DataFrame:
    """(subject_id, condition_id, group_id, result, blocking, verified): every condition of a
    subject's rule set, with the rules' columns ``keep`` and, where named there, ``missing``
    (whether there is no value and none is known to be absent). ``subjects``: (subject_id, rule_set); ``rules``: (rule_set, condition_id,
    group_id, attribute_key, data_type, operator, expected, unknown_policy, blocking, verified);
    ``values``: (subject_id, attribute_key, value as JSON text, absent), rows may be missing;
    ``places``: (place_id, parent_id); ``cases``: (data_type, expected), all forms of conditions where these
    are known beforehand (else they are taken from the rules), so that each is read once and not once
    per rule. Equi-joins only."""
    up = ancestors(places).groupBy("place_id").agg(F.collect_set("ancestor_id").alias("above"))  # as long as the hierarchy is deep
    known = places.select(F.col("place_id").alias("target"), F.lit(True).alias("target_known")).distinct()
    forms = prepared((rules if cases is None else cases).select("data_type", "expected").distinct()).withColumn("target", F.when(F.col("data_type") == "GEO_ID", text_of(F.col("expected")))).join(known, "target", "left")
    forms = forms.withColumnsRenamed({"data_type": "form_type", "expected": "form"})
    own = values.withColumn("place_id", text_of(F.col("value"))).join(up, "place_id", "left").drop("place_id")
    all_ = subjects.join(rules, "rule_set").join(own, ["subject_id", "attribute_key"], "left")
    all_ = all_.join(forms, (F.col("data_type") == F.col("form_type")) & F.col("expected").eqNullSafe(F.col("form")), "left").withColumn("x", typed(F.col("value"), F.col("data_type")))
    absent, missing = F.coalesce("absent", F.lit(False)), F.col("value").isNull() | (F.col("value") == "null")
    within = F.when(F.col("target_known"), F.array_contains("above", F.col("target")))
    op = F.col("operator")
    result = (
        F.when(absent, F.when(op == "EXISTS", "FAIL").when(op == "NOT_EXISTS", "PASS").otherwise("UNKNOWN"))
        .when(missing, F.when(F.col("unknown_policy") == "NOT_APPLICABLE", "NOT_APPLICABLE").otherwise("UNKNOWN"))
        .otherwise(applied(within))
    )
    all_ = all_.withColumn("missing", missing & ~absent)
    return all_.select("subject_id", "condition_id", "group_id", result.alias("result"), "blocking", "verified", *keep)


def tree_flags(groups: DataFrame, leaves: DataFrame, depth: int = 16) -> DataFrame:
    """(rule_set, groups, blank, twice, empty, bad_not, roots, loose): what is wrong with each rule
    set's tree. ``groups``: (rule_set, group_id, parent_id, kind); ``leaves``: (rule_set, group_id, n),
    the conditions per group. ``loose``: a group from which no path of at most ``depth`` leads to a
    root (a dangling parent, a cycle, or a tree too deep)."""
    key = ["rule_set", "group_id"]
    kids = groups.filter("parent_id is not null").groupBy("rule_set", F.col("parent_id").alias("group_id")).agg(F.count("*").alias("kids"))
    each = groups.groupBy(*key).agg(F.count("*").alias("copies"), F.max("kind").alias("kind"), F.max("parent_id").alias("parent_id"), F.count_if(F.col("parent_id").isNull()).alias("roots"))
    each = each.join(kids, key, "left").join(leaves.groupBy(*key).agg(F.sum("n").alias("n")), key, "left").withColumn("children", F.coalesce("kids", F.lit(0)) + F.coalesce("n", F.lit(0)))
    # a root stays where it is, so a path of doubled steps ends there
    jump = each.select(*key, F.when(F.col("roots") > 0, F.col("group_id")).otherwise(F.col("parent_id")).alias("at"))
    for _ in range((depth - 1).bit_length()):
        step = jump.select("rule_set", F.col("group_id").alias("at"), F.col("at").alias("next"))
        jump = jump.join(step, ["rule_set", "at"], "left").select(*key, F.col("next").alias("at"))
    top = each.filter("roots > 0").select("rule_set", F.col("group_id").alias("at"), F.lit(True).alias("rooted"))
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return each.join(jump, key).join(top, ["rule_set", "at"], "left").groupBy("rule_set").agg(
        F.sum("copies").alias("groups"), has(F.col("group_id") == "").alias("blank"), has(F.col("copies") > 1).alias("twice"), has(F.col("children") == 0).alias("empty"),
        has((F.col("kind") == "NOT") & (F.col("children") != 1)).alias("bad_not"), F.sum("roots").alias("roots"), has(F.col("rooted").isNull()).alias("loose"),
    )


def tree_errors(groups: DataFrame, leaves: DataFrame) -> DataFrame:
    """(rule_set, error): for each rule set null or the first thing wrong with its tree."""
    error = F.when(F.col("blank"), "EMPTY_GROUP_ID").when(F.col("twice"), "DUPLICATE_GROUP_ID").when(F.col("empty"), "EMPTY_GROUP").when(F.col("bad_not"), "NOT_NEEDS_ONE_CHILD").when(F.col("roots") != 1, "NO_SINGLE_ROOT").when(F.col("loose"), "NOT_CONNECTED")
    return tree_flags(groups, leaves).select("rule_set", error.alias("error"))


def gathered(rows: DataFrame, key: str, most: int, item: str, **more: Column) -> DataFrame:
    """(key, n, items, more): a key's number of rows, their ``item`` (SQL, nulls left out) as an array, and further
    aggregates. A key of more than ``most`` rows is over the limit whatever they hold, so ``most`` + 1 stand for
    all of them and no task holds a large set."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("group_id"))
    few = rows.withColumn("nth", nth).filter(F.col("nth") <= most + 1)
    return few.groupBy(key).agg(F.count("*").alias("n"), F.collect_list(F.expr(item)).alias("items"), *[x.alias(c) for c, x in more.items()])


#: Of a set's groups ``gs`` with ``ids``: the place of each one's parent, a root's own, 0 for an unknown one.
UP = "transform(gs, (g, i) -> if(g.parent_id is null, cast(i + 1 as bigint), array_position(ids, g.parent_id)))"
#: Where as many steps as there are groups lead to from each, and, as ``ruled``, the places of the groups of the
#: conditions ``cs`` and of all groups above them: the steps are doubled within the row.
CLIMB = """aggregate(sequence(1, greatest(1, cast(ceil(log2(groups)) as int))), named_struct('up', up, 'ruled', array_distinct(transform(cs, c -> array_position(ids, c)))),
    (a, i) -> named_struct('up', transform(a.up, x -> if(x = 0, 0L, a.up[x - 1])), 'ruled', array_union(a.ruled, transform(a.ruled, x -> if(x = 0, 0L, a.up[x - 1])))))"""
#: Whether a group has nothing right below it, or is NOT and has more than one group or condition there.
ODD = """exists(transform(gs, (g, i) -> named_struct('kind', g.kind, 'n', size(filter(up, x -> x = i + 1)) - if(g.parent_id is null, 1, 0) + size(filter(cs, c -> c = g.group_id)))),
    k -> k.n = 0 or k.kind = 'NOT' and k.n <> 1)"""


def graph_check(versions: DataFrame, sets: DataFrame, groups: DataFrame, conditions: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(call_id, code): whether a call's finance scenarios rest on one verified rule graph; the
    first thing that is amiss. Versions: (call_id, verified); sets: (call_id, rule_set, complete,
    verified); groups: (rule_set, group_id, parent_id, kind); conditions: (rule_set, group_id, trusted);
    scenarios: (call_id, group_id, trusted). A set's groups (64 at most) and conditions (128) and a call's
    scenarios (64) are gathered by one shuffle each; paths are followed within the row, no join is repeated."""
    untrusted, unnamed = F.bool_or(~F.col("trusted")), F.bool_or(F.col("group_id").isNull())
    trees = gathered(groups, "rule_set", 64, "struct(group_id, parent_id, kind)", roots=F.count_if(F.col("parent_id").isNull()), unknown=unnamed).withColumnsRenamed({"n": "groups", "items": "gs"})
    leaves = gathered(conditions, "rule_set", 128, "group_id", doubt=untrusted, nowhere=unnamed).withColumnsRenamed({"n": "conditions", "items": "cs"})
    offers = gathered(scenarios, "call_id", 64, "group_id", untrusted=untrusted, unplaced=unnamed).withColumnsRenamed({"n": "scenarios", "items": "os"})
    only = sets.groupBy("call_id").agg(F.count("*").alias("sets"), F.min("rule_set").alias("rule_set"), F.every(F.col("complete") & F.col("verified")).alias("sure"))
    graphs = only.filter("sets = 1").select("call_id", "rule_set").join(trees, "rule_set", "left").join(leaves, "rule_set", "left")
    whole = "coalesce(groups <= 64 and conditions <= 128 and roots = 1 and not unknown and size(array_distinct(gs.group_id)) = groups, false)"
    graphs = once(graphs, whole=whole, ids="gs.group_id")
    graphs = once(graphs, up=f"if(whole, {UP}, null)")
    graphs = once(graphs, climb=f"if(whole, {CLIMB}, null)")
    graphs = graphs.selectExpr(
        "call_id", "groups", "conditions", "whole", "ids", "transform(filter(climb.ruled, x -> x > 0), x -> ids[x - 1]) as ruled", "exists(climb.up, x -> x = 0 or gs[x - 1].parent_id is not null) as loose",
        f"if(whole, {ODD}, null) as odd", "doubt or nowhere or exists(cs, c -> not array_contains(ids, c)) as doubt",
    )
    df = versions.join(only.drop("rule_set"), "call_id", "left").join(offers, "call_id", "left").join(graphs, "call_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    outside = lambda ids: F.expr(f"exists(os, o -> not array_contains({ids}, o))")
    code = (
        F.when(~F.col("verified"), "GRANT_VERSION_UNVERIFIED").when(n("sets") != 1, "RULE_SET_NOT_UNIQUE").when(~F.col("sure"), "RULE_SET_UNVERIFIED")
        .when((n("groups") > 64) | (n("conditions") > 128) | (n("scenarios") > 64), "SNAPSHOT_LIMIT_EXCEEDED")
        .when(~F.col("whole") | (n("scenarios") == 0) | F.col("unplaced") | outside("ids"), "INCOMPLETE_RULE_GRAPH")
        .when(F.col("loose"), "INVALID_RULE_GRAPH").when(outside("ruled"), "INCOMPLETE_RULE_GRAPH").when(F.col("odd"), "UNSUPPORTED_RULE_GRAPH")
        .when(F.col("doubt") | F.col("untrusted"), "UNVERIFIED_OFFICIAL_EVIDENCE").otherwise("VERSION_BOUND_EVIDENCE_REFERENCES_ONLY")
    )
    return df.select("call_id", code.alias("code"))


def preflight(profiles: DataFrame, values: DataFrame, most: int = 128) -> DataFrame:
    """(profile_id, code): whether a profile's values may be used for finance; else the first
    value's (by ``value_id``) first fault. Values: (profile_id, value_id, supported, trusted, observed_at,
    first_seen_at, retrieved_at, created_at, verified_at); profiles: (profile_id, created_at, cutoff)."""
    own = values.join(profiles.select("profile_id", F.col("created_at").alias("born"), "cutoff"), "profile_id")
    t = lambda *names: [F.col(c) for c in names]
    born, seen, got, made, sure, saw, end = t("born", "first_seen_at", "retrieved_at", "created_at", "verified_at", "observed_at", "cutoff")
    order = (born <= made) & (born <= sure) & (seen <= got) & (got <= made) & (got <= sure) & (saw <= made) & (saw <= sure) & (made <= sure) & (sure <= end)
    fault = F.when(~F.col("supported"), "UNSUPPORTED_ATTRIBUTE_VALUE").when(~F.col("trusted"), "UNVERIFIED_OFFICIAL_ATTRIBUTE_EVIDENCE").when(~F.coalesce(order, F.lit(False)), "INCONSISTENT_ATTRIBUTE_TIMESTAMPS")
    first = own.withColumn("fault", fault).groupBy("profile_id").agg(F.count("*").alias("n"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("value_id"))).alias("fault"))
    code = F.when(F.col("n").isNull(), "NO_ATTRIBUTE_VALUES").when(F.col("n") > most, "ATTRIBUTE_LIMIT_EXCEEDED").otherwise(F.coalesce("fault", F.lit("OWNED_OFFICIAL_ATTRIBUTE_REFERENCES_ONLY")))
    return profiles.select("profile_id").join(first, "profile_id", "left").select("profile_id", code.alias("code"))


def area(places: DataFrame, lists: DataFrame) -> DataFrame:
    """(list_id, place_id): the places of each list (list_id, place_id, mode INCLUDE or EXCLUDE,
    descendants): those included, with all below where descendants is set, less those excluded."""
    below = ancestors(places).select("place_id", F.col("ancestor_id").alias("named"))
    hit = lists.select("list_id", F.col("place_id").alias("named"), "mode", "descendants").join(below, "named").filter("descendants or place_id = named")
    return hit.groupBy("list_id", "place_id").agg(F.bool_or(F.col("mode") == "EXCLUDE").alias("out")).filter("not out").select("list_id", "place_id")


def input_hash(values: DataFrame) -> DataFrame:
    """(subject_id, hash): SHA-256 of a subject's values as one compact JSON object in the order of
    their keys; values known to be absent are null, missing ones are left out."""
    known = values.filter("absent or value is not null")
    pair = F.struct("attribute_key", F.concat(F.lit('"'), "attribute_key", F.lit('":'), F.when(F.col("absent"), "null").otherwise(F.col("value"))).alias("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["text"]), ",")
    return known.groupBy("subject_id").agg(F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256).alias("hash"))


def ancestors(places: DataFrame, depth: int = 3) -> DataFrame:
    """(place_id, ancestor_id) closure of a hierarchy, itself included; a fixed number of joins."""
    up = places.select(F.col("place_id").alias("p"), "parent_id")
    out = level = places.select("place_id", F.col("place_id").alias("ancestor_id"))
    for _ in range(depth):
        level = level.join(up, level.ancestor_id == up.p).filter("parent_id is not null").select("place_id", F.col("parent_id").alias("ancestor_id"))
        out = out.unionByName(level)
    return out
