"""Applicant profiles under patches, and what a change does to verified facts.

A profile and a patch hold their values in maps, as a patch has the fields that it supplies and no
others. Every merge is expressions within one joined row; the fields that it changed are the feed
from which facts lose their verification.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a change of a field makes worthless unless it is supplied anew (fixed values).
DEPENDENT = {
    "municipality_code": ["municipality_name", "region_code", "seat_geography_id", "municipality_population", "municipality_population_as_of"],
    "municipality_population": ["municipality_population_as_of"],
}


def merged(profiles: DataFrame, patches: DataFrame) -> DataFrame:
    """(subject_id, fields, sources, changed) of every profile. ``profiles``: (subject_id, fields,
    sources), maps by field; ``patches``: the same, one at most per subject, ``fields`` with those
    supplied (also as null) and ``sources`` null where the patch names none.

    Supplied fields replace; what depends on a changed field and is not supplied becomes null. A
    source stays only if its value neither changed nor depends on one that did; of a patch's own
    sources those go that repeat the old one for such a value."""
    p = patches.select("subject_id", F.col("fields").alias("patch"), F.col("sources").alias("told"))
    df = profiles.join(p, "subject_id", "left").withColumn("patch", F.coalesce("patch", F.expr("cast(map() as map<string,string>)")))
    df = df.withColumn("changed", F.expr("array_sort(map_keys(map_filter(patch, (k, v) -> not (v <=> fields[k]))))"))
    hurt = " when ".join(f"'{k}' then array({', '.join(repr(x) for x in xs)})" for k, xs in DEPENDENT.items())
    df = df.withColumn("hurt", F.expr(f"flatten(transform(changed, k -> case k when {hurt} else cast(array() as array<string>) end))"))
    df = df.withColumn("stale", F.array_union("changed", "hurt"))
    value = "if(map_contains_key(patch, k), patch[k], if(array_contains(hurt, k), null, fields[k]))"
    keys = "array_union(map_keys(fields), map_keys(patch))"
    fields = F.expr(f"map_from_arrays({keys}, transform({keys}, k -> {value}))")
    sources = F.expr("if(told is null, map_filter(sources, (k, v) -> not array_contains(stale, k)), map_filter(told, (k, v) -> not (array_contains(stale, k) and v <=> sources[k])))")
    return df.select("subject_id", fields.alias("fields"), sources.alias("sources"), "changed")


def invalidated(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """``facts`` (subject_id, attribute_key, source_kind, verification, ...) after ``changes``
    (subject_id, changed): a new company id takes the verification of all facts, a new municipality
    that of its own; users' facts are then USER_DECLARED, others NEEDS_REVIEW."""
    hit = F.array_contains("changed", "ico") | (F.array_contains("changed", "municipality_code") & F.col("attribute_key").startswith("applicant.municipality."))
    after = F.when(F.coalesce(hit, F.lit(False)), F.when(F.col("source_kind") == "USER", "USER_DECLARED").otherwise("NEEDS_REVIEW")).otherwise(F.col("verification"))
    return facts.join(changes.select("subject_id", "changed"), "subject_id", "left").withColumn("verification", after).drop("changed")
