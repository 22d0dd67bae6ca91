"""Declared constraints, checked as Spark jobs: what a database's CHECK, UNIQUE and REFERENCES would say.

All checks of a table that look at one row are a single pass over it. A unique key is one grouped
count, a reference one anti-join on distinct keys; nothing is compared row with row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_of(column: str, *values: str) -> str:
    return f"{column} in ({', '.join(repr(v) for v in values)})"


def between(column: str, low: int, high: int) -> str:
    return f"{column} between {low} and {high}"


def ordered(*columns: str) -> str:
    return " and ".join(f"coalesce({a} <= {b}, true)" for a, b in zip(columns, columns[1:], strict=False))


def required(column: str) -> str:
    return f"{column} is not null"


def shaped(column: str, pattern: str) -> str:
    return f"regexp_like({column}, '{pattern}')"


@dataclass(frozen=True)
class Constraints:
    """Of one table. ``key`` names a row; ``checks``: rule to an SQL condition that no row may break
    (null passes, as in SQL); ``unique``: rule to columns, and to a condition which rows count;
    ``references``: rule to columns, and to another table and its columns (null passes);
    ``one_root``: rule to the columns of a set and of a parent, null for a root."""

    key: list[str]
    checks: dict[str, str] = field(default_factory=dict)
    unique: dict[str, tuple[list[str], str]] = field(default_factory=dict)
    references: dict[str, tuple[list[str], str, list[str]]] = field(default_factory=dict)
    one_root: dict[str, tuple[str, str]] = field(default_factory=dict)


def apart(c: Constraints) -> Iterator[Constraints]:
    """The checks of rows, and each rule that asks for more."""
    if c.checks:
        yield Constraints(c.key, c.checks)
    for kind in ("unique", "references", "one_root"):
        for rule, told in getattr(c, kind).items():
            yield Constraints(c.key, **{kind: {rule: told}})


def violations(tables: dict[str, DataFrame], declared: dict[str, Constraints]) -> DataFrame:
    """(table_name, rule, row_key, n): every broken constraint; ``row_key`` joins the key's columns (of a
    unique key or a set: its own) by colons, with ``?`` for null, ``n`` is how many rows share it, or
    how many roots a set has."""
    parts = []
    for name, c in declared.items():
        df = tables[name]
        told = lambda cols: F.concat_ws(":", *[F.coalesce(F.col(x).cast("string"), F.lit("?")) for x in cols]).alias("row_key")
        row = lambda rule, key, n: [F.lit(name).alias("table_name"), rule.alias("rule"), key, n.cast("long").alias("n")]  # noqa: B023, E731
        if c.checks:
            broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(test), F.lit(True)), rule) for rule, test in c.checks.items()]))
            parts.append(df.select(told(c.key), F.explode(broken).alias("broken")).select(*row(F.col("broken"), F.col("row_key"), F.lit(1))))
        for rule, (cols, where) in c.unique.items():
            counts = df.filter(where).na.drop(subset=cols).groupBy(*cols).agg(F.count("*").alias("count")).filter("count > 1")
            parts.append(counts.select(*row(F.lit(rule), told(cols), F.col("count"))))
        for rule, (cols, other, theirs) in c.references.items():
            known = tables[other].select(*[F.col(x).alias(y) for x, y in zip(theirs, cols, strict=True)]).distinct()
            own = df.select(*dict.fromkeys([*c.key, *cols])).na.drop(subset=cols)
            parts.append(own.join(known, cols, "left_anti").select(*row(F.lit(rule), told(c.key), F.lit(1))))
        for rule, (group, parent) in c.one_root.items():
            roots = df.groupBy(group).agg(F.count_if(F.col(parent).isNull()).alias("roots")).filter("roots <> 1")
            parts.append(roots.select(*row(F.lit(rule), told([group]), F.col("roots"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
