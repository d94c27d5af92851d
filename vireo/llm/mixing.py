"""Mixing to target weights by soft domain membership, with DataFrame functions only.

A multinomial logistic regression over the words that tell the domains apart,
fitted to a table of labelled documents, gives every document a posterior over
the domains. Nonnegative document rates r then
minimise

    sum_k (sum_d r_d m_d p_dk - t_k)^2 / s_k  +  ridge * sum_d m_d (r_d - 1)^2

where m_d is the document's share of all tokens, p_dk its posterior, s_k the
expected share of domain k as it stands and t_k its target share. The
projected gradient step of a document depends on its posterior alone, so
documents whose posteriors round to the same share a rate, that of their mean
posterior: they are aggregated to cells once, with the exact totals of their
posteriors, each step aggregates the cells to one number per domain, and the
rates of the cells follow from replaying the steps.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, least_hashes, pick

PER_DOMAIN = 3_000      # labelled documents of each domain in the sample
FEATURES = 1_000        # words with a weight
LEAST_Z = 3.0
DIGITS = 2              # decimals of a posterior that tell cells apart: bounds their number
RIDGE = 1e-3
STEPS = 60
SETTLED = 1e-7          # or when no share moves by more than this in a step
CLOSE = 5e-3            # stop when no domain's share is further off than this part of its target
MARKS = "*&%$#!|"


@dataclass
class Model:
    domains: list
    bias: list           # log share of each domain for a text without a known word, up to a constant
    words: DataFrame     # feature, w0, w1, ...: at most FEATURES rows


def _words(rows: DataFrame, *keep) -> DataFrame:
    """One row per word: ``word`` ('' where a text has none) and its ``feature``."""
    text = F.lower(F.coalesce("text", F.lit("")))
    for c in "\n\t\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    out = rows.select(*keep, F.explode(F.split(text, " ")).alias("word"))
    last = F.substring("word", -1, 1)
    mark = F.when(last.isin(*MARKS), F.concat(F.lit("\u0001"), last))
    return out.withColumn("feature", F.coalesce(mark, F.rtrim("word", F.lit(".,;:?"))))


def fit(docs: DataFrame, labelled: DataFrame, domains, per_domain: int = PER_DOMAIN) -> Model:
    """Weights from ``labelled`` (doc_id, domain), at most ``per_domain`` documents of each of ``domains``.

    A document labelled with two domains counts for the first in the alphabet;
    null ids and other domains are left out.
    """
    rows = pick(labelled, "doc_id", "domain").where(F.col("doc_id").isNotNull() & F.col("domain").isin(*domains))
    rows = rows.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    n_all = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    sample = least_hashes(rows, "domain", per_domain)
    texts = pick(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id")     # bounded by per_domain
    seen = _words(texts, "doc_id", "domain").where("word <> ''").select("doc_id", "domain", "feature").distinct()
    have = {k: min(per_domain, n_all.get(k, 0)) for k in domains}
    total = sum(have.values())
    counts = seen.groupBy("feature").agg(*[F.count(F.when(F.col("domain") == k, 1)).alias(f"n{i}") for i, k in enumerate(domains)])
    n = [F.col(f"n{i}") for i in range(len(domains))]
    every = sum(n, F.lit(0))
    z = []
    for c, k in zip(n, domains):
        a, b = c + 0.5, every - c + 0.5
        odds = F.log(a / (have[k] + 1)) - F.log(b / (total - have[k] + 1))
        z.append(F.abs(odds) / F.sqrt(1 / a + 1 / b))
    best = F.greatest(*z) if len(z) > 1 else F.lit(0.0)
    chosen = counts.where(best >= LEAST_Z).orderBy(F.desc(best), "feature").limit(FEATURES)
    vocabulary = sorted(r["feature"] for r in chosen.select("feature").collect())
    schema = "feature string, " + ", ".join(f"w{i} double" for i in range(len(domains)))
    spark, grand = docs.sparkSession, sum(n_all.values())
    bias = [math.log((n_all.get(k, 0) + 0.5) / (grand + 0.5 * len(domains))) for k in domains]
    have = [k for k in domains if n_all.get(k)]
    if not vocabulary or len(have) < 2:
        return Model(list(domains), bias, spark.createDataFrame([], schema))
    known = seen.where(F.col("feature").isin(vocabulary))
    bags = known.groupBy("doc_id").agg(F.collect_set("feature").alias("bag"))      # at most FEATURES words each
    share = F.create_map(*[F.lit(x) for k in have for x in (k, n_all[k] / min(per_domain, n_all[k]))])
    number = F.create_map(*[F.lit(x) for i, k in enumerate(have) for x in (k, float(i))])
    rows = sample.join(bags, "doc_id", "left").select(
        number[F.col("domain")].alias("label"), share[F.col("domain")].alias("weight"),
        F.coalesce("bag", F.array().cast("array<string>")).alias("bag"))
    counter = CountVectorizerModel.from_vocabulary(vocabulary, "bag", "features").setBinary(True).setMinTF(0.0)
    learner = LogisticRegression(family="multinomial", weightCol="weight", regParam=1e-3, maxIter=40, standardization=False)
    fitted = learner.fit(counter.transform(rows))
    matrix, start = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    w = {k: matrix[i].tolist() for i, k in enumerate(have)}
    bias = [float(start[have.index(k)]) if k in have else -30.0 for k in domains]
    weights = [(f, *[w[k][j] if k in w else 0.0 for k in domains]) for j, f in enumerate(vocabulary)]
    return Model(list(domains), bias, spark.createDataFrame(weights, schema))


def posteriors(docs: DataFrame, model: Model, keys=("doc_id",)) -> DataFrame:
    """``keys``, tokens (words), p0, p1, ...: posterior over the domains of every whole text.

    A text without a known word, or a null text, has the bias alone. Rows that
    repeat stay apart.
    """
    rows = pick(docs, *keys, "text").withColumn("row", F.monotonically_increasing_id())
    k = range(len(model.domains))
    # each feature counts once for a document; '' and unknown words only count as tokens
    hit = _words(rows, "row", *keys).join(F.broadcast(model.words), "feature", "left")       # at most FEATURES rows
    once = hit.groupBy("row", *keys, F.when(F.col("w0").isNotNull(), F.col("feature")).alias("feature")).agg(
        F.count(F.when(F.col("word") != "", 1)).alias("n"), *[F.coalesce(F.max(f"w{i}"), F.lit(0.0)).alias(f"w{i}") for i in k])
    total = once.groupBy("row", *keys).agg(F.sum("n").alias("tokens"), *[F.sum(f"w{i}").alias(f"w{i}") for i in k])
    logit = [F.col(f"w{i}") + F.lit(model.bias[i]) for i in k]
    top = F.greatest(*logit) if len(logit) > 1 else logit[0]
    share = [F.exp(x - top) for x in logit]
    whole = sum(share, F.lit(0.0))
    return total.select(*keys, "tokens", *[(x / whole).alias(f"p{i}") for i, x in enumerate(share)])


def _cell(n):
    """The rounded posterior, which tells cells apart."""
    return [F.round(F.col(f"p{i}"), DIGITS).alias(f"q{i}") for i in range(n)]


def _cells(members, n):
    """q0, ..; tokens; p0, ..: the cell's mean posterior by tokens, so tokens x p is the exact total of its documents."""
    total = [F.when(F.sum("tokens") > 0, F.sum(F.col("tokens") * F.col(f"p{i}")) / F.sum("tokens")).otherwise(F.avg(f"p{i}")).alias(f"p{i}")
             for i in range(n)]
    return cut(members.groupBy(*_cell(n)).agg(F.sum("tokens").alias("tokens"), *total).coalesce(4))      # few rows, by the rounding


def _replay(n, steps):
    """Rate of a row with posterior columns p0.. after the given steps (one residual per domain each)."""
    if not steps:
        return F.lit(1.0)
    past = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])

    def step(rate, rho):
        slope = sum((F.col(f"p{i}") * F.get(rho, F.lit(i)) for i in range(n)), F.lit(0.0)) + RIDGE * (rate - 1.0)
        return F.greatest(F.lit(0.0), rate - slope / (1.0 + RIDGE))

    return F.aggregate(past, F.lit(1.0), step)


def fit_rates(members: DataFrame, targets) -> list:
    """Residual of every projected-gradient step, from ``members`` (tokens, p0, p1, ...)."""
    return _descend(_cells(members, len(targets)), targets)[0]


def _descend(cells, targets):
    """(residual of every step, [(share reached, share wanted), ..] after the last one)"""
    n = len(targets)
    p = [f"p{i}" for i in range(n)]
    mass = cells.agg(F.sum("tokens").alias("t"), *[F.sum(F.col("tokens") * F.col(c)).alias(c) for c in p]).first()
    if not mass["t"]:
        return [], []
    share = [mass[c] / mass["t"] for c in p]
    have = [i for i in range(n) if share[i] > 0]
    goal = [targets[i] / (sum(targets[j] for j in have) or 1.0) if i in have else 0.0 for i in range(n)]
    steps, last = [], None
    while True:
        rate = _replay(n, steps)
        now = cells.select("tokens", *p, rate.alias("r")).agg(*[F.sum(F.col("tokens") * F.col(c) * F.col("r")).alias(c) for c in p]).first()
        off = [now[c] / mass["t"] - goal[i] for i, c in enumerate(p)]
        settled = last is not None and max(abs(x - y) for x, y in zip(off, last)) < SETTLED
        if all(abs(x) <= CLOSE * g for x, g in zip(off, goal)) or settled or len(steps) == STEPS:
            return steps, [(x + g, g) for x, g in zip(off, goal)]
        last = off
        steps.append([off[i] / share[i] if share[i] > 0 else 0.0 for i in range(n)])


def mix(docs: DataFrame, labelled: DataFrame, targets: dict, keys=("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: ``keys``, tokens, p_<domain>.., rate, copies, relative.

    ``relative`` is the rate over that of the document which is most likely of the domain with the greatest target.

    ``targets``: domain -> share of the tokens wanted. ``copies`` is the rate
    rounded up or down by a hash of the keys, so that its expectation is the
    rate. Domains without any expected token have no say. Null and empty texts
    have no token and the rate of the priors; an empty table gives an empty result;
    without labelled rows all documents share one posterior, and the rate is one up to the ridge.
    Targets that the rates miss by more than ``CLOSE`` of them are named in a warning.
    """
    domains = sorted(targets)
    model = fit(docs, labelled, domains)
    members = cut(posteriors(docs, model, keys))
    n = len(domains)
    cells = _cells(members, n)
    steps, reached = _descend(cells, [targets[k] for k in domains])
    missed = [f"{k} {x:.4f} instead of {g:.4f}" for k, (x, g) in zip(domains, reached) if abs(x - g) > CLOSE * g]
    if missed:
        warnings.warn(f"mixing: after {len(steps)} steps the expected shares are off: {', '.join(missed)}", stacklevel=2)
    rates = cells.select(*[f"q{i}" for i in range(n)], _replay(n, steps).alias("rate"))
    q = [c for c in rates.columns if c != "rate"]
    out = members.select("*", *_cell(n)).join(F.broadcast(rates), q, "left").drop(*q)        # bounded by the rounding
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("copies"), *keys), 12) / float(1 << 52)
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).alias("copies")
    wanted = max(range(len(domains)), key=lambda i: targets[domains[i]])
    most = out.agg(F.max(F.struct(f"p{wanted}", "rate")).alias("top")).first()["top"]
    relative = (F.col("rate") / most["rate"] if most and most["rate"] > 0 else F.lit(1.0)).alias("relative")
    return out.select(*keys, "tokens", *[F.col(f"p{i}").alias(f"p_{k}") for i, k in enumerate(domains)], "rate", copies, relative)


def thinned(mixed: DataFrame) -> DataFrame:
    """The rows of ``mixed`` (keys doc_id, key) that stay when nothing may repeat.

    Each stays by chance (a hash of its keys) in proportion to its rate; those
    of the greatest rate all stay. So the expected shares of the domains are
    those of the rates, and a rare domain with a high target leaves few rows of the others.
    """
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("thinned"), "doc_id", "key"), 12) / float(1 << 52)
    most = mixed.agg(F.max("rate")).first()[0]
    return mixed.where(chance < F.col("rate") / most) if most else mixed
