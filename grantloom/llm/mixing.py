r"""Mixing sources to target weights (operator 2, DataFrame functions only): soft membership.

1. *Domains.* A naive Bayes classifier is fitted on labelled documents: ``labels`` gives each a
   domain (``toxic``, ``good``, ``poor``), and words and punctuation runs that occur markedly more
   often in one domain (``z`` standard deviations) become its features, however many there are.
   It gives every document a probability per domain. The fit uses at most ``sample`` labelled
   documents (those with the smallest hash), a documented bound; only the feature table, which
   that sample bounds, passes through the driver.
2. *Rates.* Documents that are surely of a domain without a share (by their label, or where they
   have none by their posterior) get rate 0 and take no part in the fit. The others' rates r, 0 or
   more, minimise the squared distance of the expected domain totals ``sum_i r_i * tokens_i * p_i``
   from the targets' shares of ``budget`` times the tokens at hand, in the metric of the inverse
   second moments of p, by accelerated projected gradient steps (restarted when they turn back)
   from rate 1. Where soft documents can't meet a target (none is free of a domain whose target is
   0, say), :func:`report` tells what is left by domain. With ``keep`` rates are 1 or more, so that
   mixing repeats documents rather than removing clean ones; the totals then start from what stays,
   and the shares end nearer to that than to the targets. A step needs the totals' residual only, one
   sum over the tokens grouped by p (to ``DIGITS`` digits), a table that does not grow with the
   corpus beyond half a million rows. A document's rate follows from its p and the list of steps by
   a fold; that table is rewritten with the iterates every few steps, so no expression gets
   long. Steps end when the root mean square change of a token's rate is below ``tolerance``.
3. *Copies.* A rate becomes a whole number of copies, its fraction decided by the doc_id's hash.

Edge cases: null and empty texts have no tokens and their domain probabilities are the prior's;
labels without a document or with nulls are left out; without labels every domain is equally
likely; repeated rows have rows of their own and equal rates; documents with a null doc_id are
mixed like those without a label; an empty table gives an empty result; :func:`mix` keeps all
columns of its input, whatever their names.
"""

from __future__ import annotations

import json
import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantloom.llm.common import free_name, read, release, written

DOMAINS = ["good", "poor", "toxic"]
DOMAIN_SQL = "case when toxic = 1 then 'toxic' when quality = 1 then 'good' else 'poor' end"
#: Shares of the expected tokens. With ``keep`` they are scaled so that every domain with a share grows
#: by HEADROOM at least. Soft documents that stay also bring tokens to domains without a share; there
#: HEADROOM times these is the target that rates from 1 up can reach.
TARGETS = {"good": 0.95, "poor": 0.05, "toxic": 0.0}
HEADROOM, SLOTS, SEED = 1.25, 1 << 11, 17
#: Rates follow from probabilities of so many digits: a step reads half a million groups at most.
DIGITS = 3
#: From this posterior on a document without a label is surely of its domain.
SURE = 0.99


def terms(t: str) -> str:
    """Distinct lower-case words and runs of punctuation."""
    return rf"array_distinct(concat(split(lower({t}), r'[\s\p{{Punct}}]+'), split({t}, r'[^\p{{Punct}}]+')))"


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, domain), one row per labelled document."""
    known = labels.filter("quality is not null and toxic is not null").select("doc_id", F.expr(DOMAIN_SQL).alias("domain"))
    return known.groupBy("doc_id").agg(F.min("domain").alias("domain"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6_000, z: float = 5.0) -> dict:
    """The classifier: per domain the prior's logarithm, and what each present feature adds (its
    log-likelihood ratio against all documents)."""
    known = labelled(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    seen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most ``sample`` rows of two short columns
    seen = written(seen.select("domain", F.expr(f"filter({terms('coalesce(text, char(0))')}, x -> x <> '')").alias("terms")), "labelled")
    n = {d: 0 for d in DOMAINS} | {r["domain"]: r["n"] for r in seen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    prior = [(n[d] + 1) / (total + len(DOMAINS)) for d in DOMAINS]
    counts = seen.select("domain", F.explode("terms").alias("term")).groupBy("term").agg(*[F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS])
    every = sum((F.col(d) for d in DOMAINS[1:]), F.col(DOMAINS[0]))
    share = every / F.lit(max(total, 1))
    off = [F.abs(F.col(d) - n[d] * share) / F.sqrt(n[d] * share * (1 - share) + 0.5) for d in DOMAINS]  # how many standard deviations a domain's count is off
    best = counts.filter(F.greatest(*off) >= z).orderBy("term").collect()
    words = {}
    for r in best:
        all_of_them = math.log((sum(r[d] for d in DOMAINS) + 0.5) / (total + 1))
        words[r["term"]] = [round(math.log((r[d] + 0.5) / (n[d] + 1)) - all_of_them, 4) for d in DOMAINS]
    return {"prior": [math.log(p) for p in prior], "words": words}


def with_posterior(df: DataFrame, model: dict, text: str, out: str) -> DataFrame:
    """``df`` with the array column ``out`` of probabilities, in the order of DOMAINS."""
    spark, found = df.sparkSession, free_name(df, f"{out}_found")
    slots: list[list[dict]] = [[] for _ in range(SLOTS)]
    if model["words"]:
        rows = spark.createDataFrame([(w,) for w in model["words"]], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(SLOTS)).alias("s")).collect()
        for r in rows:
            slots[r["s"]].append({"t": r["w"], "w": model["words"][r["w"]]})
    table = F.from_json(F.lit(json.dumps(slots)), "array<array<struct<t:string,w:array<double>>>>")
    own = F.expr(terms(f"coalesce(`{text}`, '')"))
    df = df.withColumn(found, own)
    df = df.withColumn(found, F.flatten(F.transform(found, lambda x: F.filter(F.get(table, F.pmod(F.xxhash64(x), F.lit(SLOTS)).cast("int")), lambda e: e["t"] == x))))
    score = [f"aggregate(`{found}`, {model['prior'][k]:.6f}D, (a, e) -> a + e.w[{k}])" for k in range(len(DOMAINS))]
    df = df.withColumn(found, F.expr(f"array({', '.join(score)})"))
    df = df.withColumn(found, F.expr(f"transform(`{found}`, s -> exp(greatest(s - array_max(`{found}`), -50D)))"))
    return df.withColumn(out, F.expr(f"transform(`{found}`, s -> round(s / aggregate(`{found}`, 0D, (a, x) -> a + x), 6))")).drop(found)


def residuals(narrow: DataFrame, rate: str, targets: list[float]) -> list[float]:
    sums = [F.sum(F.expr(f"({rate}) * tokens * p[{k}]")).alias(f"t{k}") for k in range(len(targets))]
    return [(x or 0.0) - t for x, t in zip(narrow.agg(*sums).first(), targets, strict=True)]


def metric_of(moments: np.ndarray) -> np.ndarray:
    """The inverse of the token-weighted second moments of p."""
    return np.linalg.inv(moments + 1e-6 * np.trace(moments) * np.eye(len(moments)))


def folded(steps: list[tuple[np.ndarray, float]], n: int, floor: float, rate: str = "1D", look: str = "1D") -> str:
    """SQL of a document's iterate after ``steps`` (multipliers, momentum) from (rate, look), over
    its ``p``: its rate, where the next step starts (look), and the last step's change (move) and
    whether it turned back (turn)."""
    each = ", ".join(f"named_struct('v', array({', '.join(f'{x:.17g}D' for x in v)}), 'b', {b:.17g}D)" for v, b in steps)
    to = f"greatest({floor}D, a.look - ({' + '.join(f'p[{k}] * s.v[{k}]' for k in range(n))}))"
    step = f"transform(array({to}), r -> named_struct('rate', r, 'look', r + s.b * (r - a.rate), 'move', (r - a.look) * (r - a.look), 'turn', (a.look - r) * (r - a.rate)))[0]"
    start = f"named_struct('rate', {rate}, 'look', {look}, 'move', 0D, 'turn', 0D)"
    return f"aggregate(array({each}), {start}, (a, s) -> {step})" if steps else start


def fit_rates(narrow: DataFrame, targets: list[float], rounds: int = 100, tolerance: float = 1e-5, floor: float = 0.0, rewrite: int = 8, every: DataFrame | None = None) -> str:
    """SQL expression of the rate over ``p`` (array of probabilities) for documents (tokens, p)
    and target totals per domain, ``floor`` at least. Distances are measured by the moments of
    ``every`` document, those of ``narrow`` if not given. Within reach the targets are met after a few
    steps; beyond it the steps come down on the least distance slowly, and a warning tells the
    residual if they are used up first."""
    n, k = len(targets), range(len(targets))
    first = (narrow if every is None else every).agg(F.sum("tokens"), *[F.sum(F.expr(f"tokens * p[{a}] * p[{b}]")) for a in k for b in k]).first()
    total = float(first[0] or 0)
    if total <= 0:
        return "1.0D"
    goal, moments = np.array(targets) / total, np.array(first[1:], float).reshape(n, n) / total
    metric = metric_of(moments)  # so the step length is 1
    state = narrow.select("tokens", "p", F.lit(1.0).alias("rate"), F.lit(1.0).alias("look"))
    begun = np.array(narrow.agg(*[F.sum(F.expr(f"tokens * p[{a}]")) for a in k]).first(), float) / total
    steps, done, t, e = [], 0, 1.0, np.nan_to_num(begun) - goal
    while len(steps) < rounds:
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        steps.append((metric @ e, (old - 1) / t))
        now = state.select("tokens", "p", F.expr(folded(steps[done:], n, floor, "rate", "look")).alias("x"))
        sums = [F.sum(F.expr(f"tokens * {c}")) for c in ["x.move", "x.turn", *[f"x.{y} * p[{a}]" for y in ("rate", "look") for a in k]]]
        sums = np.array(now.agg(*sums).first(), float) / total
        if sums[1] > 0:  # the momentum points back: go on from the rates themselves
            t, steps[-1], e = 1.0, (steps[-1][0], 0.0), sums[2 : 2 + n] - goal
        else:
            e = sums[2 + n :] - goal
        if sums[0] ** 0.5 <= tolerance:
            break
        if len(steps) - done == rewrite:
            x = F.expr(folded(steps[done:], n, floor, "rate", "look"))
            fresh = written(state.select("tokens", "p", x.alias("x")).select("tokens", "p", "x.rate", "x.look"), "rates")
            if done:
                release(state)
            state, done = fresh, len(steps)
    else:
        warnings.warn(f"mixing: residual {e.tolist()} after {rounds} steps", stacklevel=2)
    if done:
        release(state)
    return f"({folded(steps, n, floor)}).rate"


def totals(narrow: DataFrame) -> list[float]:
    return [(x or 0.0) for x in narrow.agg(*[F.sum(F.expr(f"tokens * p[{k}]")) for k in range(len(DOMAINS))]).first()]


def barred(df: DataFrame, labels: DataFrame, p: str, domains: list[str]) -> tuple[DataFrame, str]:
    """``df`` with a boolean column, and its name: whether a document is surely of one of
    ``domains``. Only labels that contradict the posterior are joined to whole documents."""
    out, known = free_name(df, "barred"), free_name(df, "known")
    sure = F.expr(" or ".join([f"`{p}`[{DOMAINS.index(d)}] >= {SURE}D" for d in domains]) or "false")
    told = labelled(labels).select("doc_id", F.col("domain").isin(domains).alias(known))
    wrong = df.select("doc_id", sure.alias("sure")).join(told, "doc_id").filter(f"sure <> `{known}`").select("doc_id", known).distinct()
    df = df.join(written(wrong, "overruled"), "doc_id", "left")
    return df.withColumn(out, F.coalesce(known, sure)).drop(known), out


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = 1.0, keep: bool = False) -> tuple[DataFrame, str, str, str]:
    """``docs`` with columns for tokens, probabilities and rate, and these columns' names."""
    t, p, r = free_name(docs, "tokens"), free_name(docs, "p"), free_name(docs, "rate")
    model = fit(docs, labels)
    df = with_posterior(docs, model, "text", p)
    df = df.withColumn(t, F.expr(r"cast(greatest(size(split(trim(BOTH ' \n\t' FROM coalesce(text, '')), r'\s+')), 0) as double)"))
    df = df.withColumn(t, F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, F.lit(0.0)).otherwise(F.col(t)))
    df = written(df, "mixing")
    alike = F.expr(f"transform(`{p}`, x -> round(x, {DIGITS}))").alias("p")
    every = written(df.groupBy(alike).agg(F.sum(t).alias("tokens")), "posteriors", rows=200_000)
    now = totals(every)
    df, out = barred(df, labels, p, [d for d in DOMAINS if targets[d] == 0])
    narrow = written(df.filter(f"not `{out}`").groupBy(alike).agg(F.sum(t).alias("tokens")), "staying", rows=200_000)
    if keep:
        scale = HEADROOM * max((x / targets[d] for x, d in zip(now, DOMAINS, strict=True) if targets[d] > 0), default=0.0)
        goals = [max(targets[d] * scale, HEADROOM * x) for d, x in zip(DOMAINS, totals(narrow), strict=True)]
    else:
        goals = [targets[d] / sum(targets.values()) * budget * sum(now) for d in DOMAINS]
    rate = fit_rates(narrow, goals, floor=1.0 if keep else 0.0, every=None if keep else every)
    release(narrow, every)
    return df.withColumn(r, F.expr(f"if(`{out}`, 0D, transform(array(transform(`{p}`, x -> round(x, {DIGITS}))), p -> {rate})[0])")), t, p, r


def report(df: DataFrame, tokens: str, p: str, rate: str, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(domain, before, after, share, target): expected tokens by domain before and after mixing,
    and the share of all that the domain reaches against the one it should have."""
    each = F.posexplode(F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(float(targets[d])).alias("target"), F.col(f"`{p}`")[k].alias("p")) for k, d in enumerate(DOMAINS)]))
    parts = df.select(F.col(tokens).alias("tokens"), F.col(rate).alias("rate"), each.alias("k", "d"))
    sums = parts.groupBy(F.col("d.domain").alias("domain"), F.col("d.target").alias("target")).agg(F.sum(F.col("tokens") * F.col("d.p")).alias("before"), F.sum(F.col("tokens") * F.col("d.p") * F.col("rate")).alias("after"))
    return sums.select("domain", "before", "after", F.expr("try_divide(after, sum(after) over ())").alias("share"), "target")  # a row per domain


def copies(doc_id: str, rate: str) -> Column:
    u = F.pmod(F.xxhash64(doc_id, F.lit(SEED)), F.lit(1_000_000)) / 1_000_000
    return (F.floor(rate) + F.when(u < F.col(rate) - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = 1.0, keep: bool = False) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say; with ``keep`` no document goes but those
    surely of a domain without a share."""
    df, _, _, r = mixed(docs, labels, targets, budget, keep)
    n = free_name(df, "copy")
    df = df.withColumn(n, F.explode(F.array_repeat(F.lit(1), copies("doc_id", r))))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_mixing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    df, t, p, r = mixed(docs, read(spark, sf_dir, "labels"))
    return df.select("doc_id", F.col(t).cast("long").alias("tokens"), *[F.col(p)[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], F.round(r, 6).alias("rate"), copies("doc_id", r).alias("copies"))
