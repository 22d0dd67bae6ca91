r"""URL filters (operator 3, DataFrame functions only).

Host and path are cut out of each URL; listed rules decide first, the longest fitting one wins.
Other URLs are judged by a logistic regression on hashed character n-grams of host and path. It is
trained from a small labelled URL table by full-batch gradient steps, each a grouped sum over the
exploded features; only the weight vector (``BUCKETS`` doubles, a fixed number) passes through
the driver, and it enters the scoring expression as a literal, so pages are judged without a
shuffle whatever their number.

Edge cases: a null URL or one without ``://`` has an empty host and path and is judged by the
model's bias alone; repeated rows and ties are judged one by one; an empty labelled table gives
a model that allows everything; an empty table gives an empty result; extra columns are neither
read nor returned.
"""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantloom.llm.common import read

#: The contract's rules: (verdict, host and path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
BUCKETS, SIZES = 1 << 12, (3, 4, 5)

#: A small labelled URL table, to be replaced by one's own: url and whether it is unwanted.
LABELLED = Path(__file__).with_name("labelled_urls.csv")


def labelled_urls(spark: SparkSession, path: str | Path = LABELLED) -> DataFrame:
    """(url, label) of a file on the driver; a larger table comes as a DataFrame of its own."""
    with open(path, encoding="utf-8", newline="") as f:
        rows = [(r["url"], int(r["unwanted"])) for r in csv.DictReader(f)]
    return spark.createDataFrame(rows, "url string, label int")


def folds(labelled: DataFrame, held_out: int = 25) -> tuple[DataFrame, DataFrame]:
    """The table split by the URLs' hashes: what to train on, and ``held_out`` percent to test on."""
    out = F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(100)) < held_out
    return labelled.filter(~out), labelled.filter(out)


def precision_recall(labelled: DataFrame, model: tuple[list[float], float]) -> tuple[float | None, float | None]:
    """Of the URLs that the model alone blocks, the share labelled unwanted; of those so labelled,
    the share it blocks. None where there are none."""
    seen = judge(labelled.select(F.col("label").alias("page_id"), "url"), model, [])
    n = seen.agg(*[F.count_if(F.expr(c)).alias(k) for k, c in [("hit", "page_id = 1 and verdict = 'block'"), ("blocked", "verdict = 'block'"), ("unwanted", "page_id = 1")]]).first()
    return n["hit"] / n["blocked"] if n["blocked"] else None, n["hit"] / n["unwanted"] if n["unwanted"] else None


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with host and path."""
    u = f"`{url}`"
    rest = f"case when {u} is not null and instr({u}, '://') > 0 then substring({u}, instr({u}, '://') + 3) else '' end"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    df = df.withColumn("rest", F.expr(rest)).withColumn("host", F.expr("regexp_extract(rest, '^[^/?#]*', 0)"))
    df = df.withColumn("path", F.expr("regexp_extract(substring(rest, length(host) + 1), '^[^?#]*', 0)"))
    return df.withColumn("host", F.translate("host", upper, lower)).drop("rest")


def matched(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path; null without one. A rule fits
    its host and all subdomains if the path starts with its path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # later ones go around earlier ones
        host, path = r.split("/", 1)
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def ngrams(c: str) -> str:
    """Buckets of the character n-grams of ``^c$``, for the host and the path apart."""
    padded = f"concat('^', {c}, '$')"
    each = [f"transform(sequence(1, greatest(length({padded}) - {n - 1}, 1)), i -> cast(pmod(xxhash64('{c}', substring({padded}, i, {n})), {BUCKETS}) as int))" for n in SIZES]
    return f"array_distinct(concat({', '.join(each)}))"


def features() -> str:
    return f"case when host = '' and path = '' then cast(array() as array<int>) else array_distinct(concat({ngrams('host')}, {ngrams('path')})) end"


def score(weights: list[float], bias: float) -> str:
    """Log-odds of a feature array ``f``, divided by the square root of its size."""
    table = f"cast(split('{','.join(f'{w:.6g}' for w in weights)}', ',') as array<double>)"
    return f"{bias:.8f}D + aggregate(f, 0D, (a, i) -> a + {table}[i]) / sqrt(greatest(size(f), 1))"


def train(labelled: DataFrame, rounds: int = 60, rate: float = 4.0, l2: float = 1e-3) -> tuple[list[float], float]:
    """Weights and bias of the logistic regression, by accelerated gradient steps; with features of
    length one a rate of 4 never overshoots. Each step is one grouped sum."""
    rows = with_parts(labelled).select(F.expr(features()).alias("f"), F.col("label").cast("double").alias("y")).filter("y is not null").cache()
    n = rows.count()
    if not n:
        rows.unpersist()
        return [0.0] * BUCKETS, -10.0
    w = look = [0.0] * (BUCKETS + 1)  # the last one is the bias
    for k in range(rounds):
        off = rows.select("f", (1 / (1 + F.exp(-F.expr(score(look[:-1], look[-1])))) - F.col("y")).alias("g"))
        parts = off.select(F.explode(F.concat(F.array(F.lit(BUCKETS)), "f")).alias("i"), "g", F.sqrt(F.greatest(F.size("f"), F.lit(1))).alias("z"))
        step = [l2 * x for x in look[:-1]] + [0.0]
        for r in parts.groupBy("i").agg(F.sum(F.when(F.col("i") == BUCKETS, F.col("g")).otherwise(F.col("g") / F.col("z"))).alias("g")).collect():  # BUCKETS + 1 rows at most
            step[r["i"]] += r["g"] / n
        to = [x - rate * g for x, g in zip(look, step, strict=True)]
        look = [x + k / (k + 3) * (x - y) for x, y in zip(to, w, strict=True)]
        w = to
    rows.unpersist()
    return w[:-1], w[-1]


def judge(pages: DataFrame, model: tuple[list[float], float], rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_unwanted)."""
    rule, verdict = matched(rules)
    df = with_parts(pages.select("page_id", "url")).withColumn("f", F.expr(features()))
    df = df.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"), (1 / (1 + F.exp(-F.expr(score(*model))))).alias("p_unwanted"))
    own = F.when(F.col("p_unwanted") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return df.select("page_id", "host", "path", "rule", F.coalesce("listed", own).alias("verdict"), F.round("p_unwanted", 4).alias("p_unwanted"))


def op3_url_filter(spark, sf_dir):
    return judge(read(spark, sf_dir, "pages"), train(labelled_urls(spark)))
