"""Mixing documents to target weights with soft domain membership. DataFrame functions only.

A multinomial naive Bayes classifier over hashed words is trained on labelled rows and gives each document posterior
probabilities of the domains, calibrated on labelled rows that it has not seen. Nonnegative rates r then minimise the squared difference between the expected tokens of each
domain, sum of r * tokens * posterior, and the targets: projected gradient steps in the token-weighted metric, each of
which needs one aggregate of a few numbers (a residual per domain) over the table of posteriors. The rates are functions of
those residuals alone, so they are recomputed wherever they are needed and never stored.

Targets: weights by domain; the total is the smallest at which no domain has to shrink. The projection keeps every rate at
`least` or more: at 0 rates are merely nonnegative; at 1 no document is lost, and the total gets SLACK more, so that the
bound need not stand in the way of the targets. A domain without labelled rows or without
tokens has no part in the targets. Gradient steps that end before the residual is small warn with what is left of it.

Cases: null and empty texts have no tokens, equal posteriors, and a rate like any other; repeated rows get equal rates;
rows with one doc_id and different texts are told apart by a hash of the text, rows with a null doc_id too; very long texts
count whole, word by word; without labelled rows all rates are 1; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
import warnings
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import NO_ID, SPACE_CLASS, stage, unstage

#: Shares of the tokens of the mixture.
WEIGHTS = {"en": 0.50, "de": 0.19, "fr": 0.19, "es": 0.12}
#: Share added to the total where every document has to stay.
SLACK = 0.005
BUCKETS = 2048
#: At most about this many labelled rows train the classifier (chosen by a hash of doc_id).
LABELLED = 20_000
#: Gradient steps at most, and the share of all tokens that a domain may stay away from its target.
STEPS, TOLERANCE = 40, 1e-6
#: Held-out rows that each domain needs for a calibration; with fewer, all labelled rows teach and the first power holds.
HELD = 20
#: Powers of a text's number of words that may temper its evidence.
POWERS = (0.5, 0.35, 0.2, 0.1, 0.0)


def _words(docs: DataFrame, *keep: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    w = docs.select(*keep, F.posexplode_outer(F.array_remove(F.split(text, SPACE_CLASS), "")).alias("i", "w"))
    first = (F.coalesce("i", F.lit(0)) == 0).cast("int").alias("is_first")
    return w.select(*keep, F.pmod(F.xxhash64(F.lower("w")), F.lit(BUCKETS)).cast("int").alias("bucket"), F.col("w").isNotNull().alias("is_word"), first)


def train(docs: DataFrame, labels: DataFrame, domains: list[str], domain_col: str = "lang") -> tuple[DataFrame, Calibration] | None:
    """bucket and one log-probability column per domain (p0, p1, ...), BUCKETS rows, and the calibration of its posteriors.
    None without labelled rows. A fifth of the labelled rows calibrates what the others have taught, if that is HELD rows of
    each domain."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    total = own.count()
    share = min(1.0, LABELLED / total) if total else 1.0
    chosen = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(domain_col).cast("string").alias("domain")).where(F.col("domain").isin(domains))
    # the chosen labels are bounded by LABELLED, so the texts need not move
    rows = rows.join(F.broadcast(chosen), "doc_id", "left_semi").withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0)
    rows = stage(rows.withColumn("tkey", F.xxhash64("text")), "mixing-labelled")
    sizes = {r.domain: r.n for r in rows.groupBy("domain").agg(F.count_if("held").alias("n")).collect()}  # a row per domain
    enough = bool(sizes) and min(sizes.values()) >= HELD
    counts = stage(_words(rows.where("NOT held") if enough else rows, "domain").where("is_word").groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n")), "buckets")
    sums = {r.domain: r.n for r in counts.groupBy("domain").agg(F.sum("n").alias("n")).collect()}  # a row per domain
    known = [d for d in domains if sums.get(d)]
    if not known:
        unstage(rows, counts)
        return None
    every = counts.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    wide = every.join(counts.groupBy("bucket").pivot("domain", known).agg(F.first("n")), "bucket", "left")
    logs = [F.log((F.coalesce(F.col(f"`{d}`"), F.lit(0)) + 0.5) / F.lit(sums[d] + 0.5 * BUCKETS)).alias(f"p{domains.index(d)}") for d in known]
    model = stage(wide.select("bucket", *logs), "bayes")
    # at most about a fifth of LABELLED rows of a few numbers
    held = [r for r in _evidence(rows.where("held"), model, ["doc_id", "tkey", "domain"]).collect() if r.n_tokens] if enough else []
    unstage(rows, counts)
    return model, calibrated(held, [c for c in model.columns if c != "bucket"], {f"p{domains.index(d)}": d for d in known})


class Calibration(NamedTuple):
    """Evidence is divided by the number of words to this power, and gets a constant per domain."""

    power: float
    bias: dict[str, float]


def calibrated(held: list, columns: list[str], names: dict[str, str]) -> Calibration:
    """The power under which held-out rows' own domains are likeliest, word by word, and constants under which each domain
    gets as many of their tokens as it has. Domains without held-out rows get none."""

    def posterior(r, power, bias):
        scale = max(r.n_tokens**power, 1.0)
        logs = [(r[c] or 0.0) / r.n_rows / scale + bias[c] for c in columns]
        top = max(logs)
        odds = [math.exp(x - top) for x in logs]
        return [x / sum(odds) for x in odds]

    flat = dict.fromkeys(columns, 0.0)
    own = [next(k for k, c in enumerate(columns) if names[c] == r.domain) for r in held if r.domain in names.values()]
    held = [r for r in held if r.domain in names.values()]
    loss = lambda power: -sum(r.n_tokens * math.log(max(posterior(r, power, flat)[k], 1e-9)) for r, k in zip(held, own, strict=True))
    power = min(POWERS, key=loss) if held else POWERS[0]
    bias = dict(flat)
    true = [sum(r.n_tokens for r, k in zip(held, own, strict=True) if k == j) for j in range(len(columns))]
    for _ in range(20):
        given = [0.0] * len(columns)
        for r in held:
            for j, q in enumerate(posterior(r, power, bias)):
                given[j] += r.n_tokens * q
        for j, c in enumerate(columns):
            if true[j] and given[j]:
                bias[c] += max(-1.0, min(1.0, math.log(true[j] / given[j])))
    return Calibration(power, bias)


def _evidence(docs: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_rows, n_tokens (of one row) and the sums of the words' log-probabilities in each domain."""
    own = [c for c in model.columns if c != "bucket"]
    # the model has BUCKETS rows, whatever the input
    scored = _words(docs, *keys).join(F.broadcast(model), "bucket")
    sums = scored.groupBy(*keys).agg(F.sum(F.col("is_word").cast("long")).alias("t"), F.sum("is_first").alias("n_rows"), *[F.sum(F.when(F.col("is_word"), F.col(c))).alias(c) for c in own])
    return sums.select(*keys, (F.col("t") / F.col("n_rows")).alias("n_tokens"), "n_rows", *own)


def posteriors(docs: DataFrame, model: DataFrame, keys: list[str], how: Calibration | None = None) -> DataFrame:
    """keys, n_rows, n_tokens (of one row) and q<i>, the posterior of each domain of the model, per distinct key."""
    own = [c for c in model.columns if c != "bucket"]
    how = how or Calibration(POWERS[0], dict.fromkeys(own, 0.0))
    # words are not independent: their evidence is tempered by a power of their number
    scale = F.greatest(F.pow(F.col("n_tokens"), F.lit(how.power)), F.lit(1.0)) * F.col("n_rows")
    logs = [(F.coalesce(c, F.lit(0.0)) / scale + F.when(F.col("n_tokens") > 0, how.bias[c]).otherwise(0.0)).alias(f"_{c}") for c in own]
    scaled = _evidence(docs, model, keys).select(*keys, "n_tokens", "n_rows", *logs)
    top = F.greatest(*[F.col(f"_{c}") for c in own], F.lit(-math.inf))
    soft = [F.exp(F.col(f"_{c}") - top) for c in own]
    total = sum(soft[1:], soft[0])
    return scaled.select(*keys, F.col("n_tokens").cast("long").alias("n_tokens"), "n_rows", *[(s / total).alias(f"q{c[1:]}") for c, s in zip(own, soft, strict=True)])


def _solve(m: list[list[float]], v: list[float]) -> list[float]:
    """Solution of a small symmetric system, lightly damped."""
    n = len(v)
    a = [[*row, x] for row, x in zip(m, v, strict=True)]
    for i in range(n):
        a[i][i] += 1e-9 * (m[i][i] + 1e-9)
    for i in range(n):
        k = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[k] = a[k], a[i]
        for r in range(n):
            if r != i and a[i][i]:
                f = a[r][i] / a[i][i]
                a[r] = [x - f * y for x, y in zip(a[r], a[i], strict=True)]
    return [a[i][n] / a[i][i] if a[i][i] else 0.0 for i in range(n)]


def rate_column(steps: list[list[float]], q: list[str], least: float = 0.0) -> Column:
    """The rate after the given gradient steps, from 1, kept at least or more at each."""
    rate = F.lit(1.0)
    for step in steps:
        rate = F.greatest(F.lit(float(least)), rate - sum([F.col(c) * x for c, x in zip(q[1:], step[1:], strict=True)], F.col(q[0]) * step[0]))
    return rate


def fit(table: DataFrame, weights: dict[int, float], least: float = 0.0) -> tuple[list[list[float]], dict[int, float]]:
    """Gradient steps and the targets by domain number. table: n_tokens, n_rows, q<i>."""
    q = [f"q{i}" for i in weights]
    w = F.col("n_tokens") * F.col("n_rows")
    first = table.agg(*[F.sum(w * F.col(c)).alias(c) for c in q], *[F.sum(w * F.col(a) * F.col(b)).alias(f"{a}{b}") for a in q for b in q]).first()
    have = [first[c] or 0.0 for c in q]
    if not sum(have):
        return [], dict.fromkeys(weights, 0.0)
    live = [i for i, x in enumerate(have) if x > 0]
    total = max(have[i] / (list(weights.values())[i] or 1e-9) for i in live) * (1 + SLACK if least >= 1 else 1)
    targets = [total * x for x in weights.values()]
    metric = [[first[f"{a}{b}"] for b in q] for a in q]
    steps: list[list[float]] = []
    residual = [h - t if i in live else 0.0 for i, (h, t) in enumerate(zip(have, targets, strict=True))]
    while len(steps) < STEPS and max(map(abs, residual)) > TOLERANCE * total:
        steps.append(_solve(metric, residual))
        rated = table.withColumn("_rate", rate_column(steps, q, least))
        # rows at the bound do not move any further: the next step's metric is that of the others
        free = F.when(F.col("_rate") > least, w)
        now = rated.agg(*[F.sum(w * F.col(c) * F.col("_rate")).alias(c) for c in q], *[F.sum(free * F.col(a) * F.col(b)).alias(f"{a}{b}") for a in q for b in q]).first()
        residual = [now[c] - t if i in live else 0.0 for i, (c, t) in enumerate(zip(q, targets, strict=True))]
        inner = [[now[f"{a}{b}"] or 0.0 for b in q] for a in q]
        # a domain of which all rows are at the bound keeps the metric of all rows
        metric = [[inner[i][j] if min(inner[i][i], inner[j][j]) > 1e-3 * metric[i][i] else metric[i][j] for j in range(len(q))] for i in range(len(q))]
    if max(map(abs, residual)) > TOLERANCE * total:
        warnings.warn(f"after {len(steps)} steps a domain is {max(map(abs, residual)) / total:.2g} of all tokens from its target", stacklevel=2)
    return steps, dict(zip(weights, targets, strict=True))


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")


def _table(docs: DataFrame, labels: DataFrame, weights: dict[str, float], domain_col: str, least: float) -> tuple[DataFrame, list[list[float]], list[str]]:
    domains = list(weights)
    keyed = docs.select(_id(), F.xxhash64("text").alias("tkey"), "text")
    trained = train(docs, labels, domains, domain_col)
    if trained is None:
        counts = keyed.groupBy("doc_id", "tkey").agg(F.count(F.lit(1)).alias("n_rows"), F.first(F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE_CLASS), ""))).cast("long").alias("n_tokens"))
        return counts.withColumn("q0", F.lit(1.0)), [], ["q0"]
    model, how = trained
    own = [int(c[1:]) for c in model.columns if c != "bucket"]
    table = stage(posteriors(keyed, model, ["doc_id", "tkey"], how), "posteriors")
    unstage(model)
    steps, _ = fit(table, {i: weights[domains[i]] for i in own}, least)
    return table, steps, [f"q{i}" for i in own]


def copies_column(rate: Column) -> Column:
    """Whole copies whose mean is the rate: the fraction is decided by a hash of doc_id."""
    return (F.floor(rate) + (F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 20)) / F.lit(float(1 << 20)) < rate - F.floor(rate)).cast("int")).cast("int")


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, domain_col: str = "lang", least: float = 0.0) -> DataFrame:
    """doc_id, n_tokens, posteriors (by domain), rate and copies of each row."""
    weights = weights or WEIGHTS
    table, steps, q = _table(docs, labels, weights, domain_col, least)
    domains = list(weights)
    out = table.withColumn("rate", rate_column(steps, q, least)).withColumn("copies", copies_column(F.col("rate")))
    shares = F.map_from_arrays(F.array(*[F.lit(domains[int(c[1:])]) for c in q]), F.array(*q))
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_tokens", shares.alias("posteriors"), "rate", "copies", F.explode(F.array_repeat(F.lit(0), F.col("n_rows").cast("int"))).alias("_k")).drop("_k")


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, domain_col: str = "lang", least: float = 0.0) -> DataFrame:
    """docs with each row as often as its rate says."""
    table, steps, q = _table(docs, labels, weights or WEIGHTS, domain_col, least)
    copies = table.select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_tkey"), copies_column(rate_column(steps, q, least)).alias("_copies"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), _id().alias("_id"), F.xxhash64("text").alias("_tkey"))
    return rows.join(copies, ["_id", "_tkey"]).select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_k")).select("_row.*")
