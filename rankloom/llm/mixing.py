"""Soft-membership mixing: document rates whose expected token totals per domain match targets.

Domains come from a labelled table (good, poor, toxic). A logistic classifier predicts every document's domain posteriors p from all its
distinct words and a few shape marks; words are hashed to `buckets` weights, so that none is left out and the model has a fixed size. A bucket
counts the less, the more likely its counts are chance. The driver fits the weights on the bounded sample below; everything else is DataFrame functions.

Rates r minimise the squared distance of the totals sum(r * tokens * p_k) from the
targets, subject to r >= 0 (or >= 1 for documents likeliest of a domain that is to be kept whole; and r <= `most` where it is given), by
accelerated projected gradient steps, scaled document by document with the inverse masses of its domains, a metric in which the projection is
still a plain clip. The step length is safe (the inverse of a bound on the largest curvature); momentum starts anew when the error rises. Steps go
on until the totals are `close` to the targets (a thousandth, as the root of squares) or the error hasn't fallen by a part of `slow` in `patience` steps. A document's rate depends on its posteriors and the steps so far, so every iteration is one
aggregation of a narrow table, of which the driver gets as many numbers as domains.

The classifier is fitted on at most `sample_rows` labelled rows a domain (of those that are among the documents, the ones with the smallest hash of
their id), each domain weighing what it has of all labelled documents; tokens, posteriors, totals and rates cover all documents. Broadcast are these
ids; the driver gets at most `buckets` numbers of each sampled row.

Defined cases. Null text: empty, no tokens: its rate is 1 moved by its posteriors, it adds nothing to totals. Null doc_id: never a training
row. Repeated rows: each has its rate. Labels that contradict each other: toxic if one says so, good only if all do. No labels: all
posteriors are equal. Empty table: no rows. A given column that has a result's name gets `_given` behind it.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.shared import beside, release, settle

DOMAINS = ("good", "poor", "toxic")
WEIGHTS = {"good": 0.8, "poor": 0.15, "toxic": 0.05}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAKS = ".,;:|\t\n\x0b\f\r"
_PLAIN = "abcdefghijklmnopqrstuvwxyz .,\n"
_P = [f"p_{d}" for d in DOMAINS]


@dataclasses.dataclass
class Model:
    """Biases of the domains, and each domain's bucket weights but the first's, which are 0."""

    bias: list[float]
    weights: list[list[float]]


def domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of every labelled document."""
    seen = labels.where("doc_id IS NOT NULL AND quality IN (0, 1) AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("_t"), F.min("quality").alias("_q"))
    return seen.select("doc_id", F.when(F.col("_t") == 1, "toxic").when(F.col("_q") == 1, "good").otherwise("poor").alias("domain"))


def _marks(rest: Column, length: Column, share_repeated: Column) -> list[Column]:
    """Marks of a text's shape, as words that no text has: shares in steps on a log scale. Rest: what the text has beside plain letters."""
    size = F.greatest(length, F.lit(1))
    step = lambda part: F.floor(F.log2(F.least(F.lit(1.0), part) + 1 / 1024) * 1.5).cast("string")
    held = lambda letters: (F.length(rest) - F.length(F.translate(rest, letters, ""))) / size
    return [F.concat(F.lit("\x01upper"), step(held(_UPPER))), F.concat(F.lit("\x01signs"), step(held("#$%&*!|"))), F.concat(F.lit("\x01bars"), step(held("|"))), F.concat(F.lit("\x01repeat"), step(share_repeated))]


def _buckets(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (with _text) with n_tokens and _b: the buckets of distinct words, A-Z lower-cased, and shape marks. What is used more than once is a
    column of its own, which is computed once."""
    at = lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")
    words = F.split(F.translate("_text", _UPPER + _BREAKS, _UPPER.lower() + " " * len(_BREAKS)), " ")
    out = docs.withColumns({"_w": F.array_compact(F.transform(words, lambda w: F.when(w != "", at(w)))), "_rest": F.translate("_text", _PLAIN, ""), "_len": F.length("_text")}).drop("_text")
    out = out.withColumns({"n_tokens": F.size("_w").cast("long"), "_d": F.array_distinct("_w")}).drop("_w")
    marks = _marks(F.col("_rest"), F.col("_len"), 1 - F.size("_d") / F.greatest(F.col("n_tokens"), F.lit(1)))
    return out.withColumn("_b", F.array_union("_d", F.array(*map(at, marks)))).drop("_d", "_rest", "_len")


def _total(buckets: Column, model: Model) -> Column:
    """The sum of a document's weights; those of two domains, in thousandths, are the halves of one number."""
    if not model.weights[0]:
        return F.lit(0).cast("long")
    whole = [round(1000 * a) * (1 << 32) + round(1000 * b) for a, b in zip(*model.weights)]
    table = F.split(F.lit(",".join(map(str, whole))), ",").cast("array<bigint>")  # folded to one constant
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda s, b: s + F.get(table, b))


def _logits(total: Column, model: Model) -> list[Column]:
    low = F.pmod(total + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    high = F.shiftright(total - low, 32)
    return [F.lit(model.bias[0]), *[F.lit(b) + x / 1000.0 for b, x in zip(model.bias[1:], (high, low))]]


def _posteriors(logits: list[Column]) -> list[Column]:
    top = F.greatest(*logits)
    terms = [F.exp(z - top) for z in logits]
    return [t / sum(terms[1:], terms[0]) for t in terms]


def _minimise(f, x: np.ndarray, rounds: int = 80, memory: int = 10) -> np.ndarray:
    """A quasi-Newton descent (limited memory, backtracking) of f, which gives value and gradient."""
    value, slope = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, scales = -slope, []
        for s, y in reversed(past):
            scales.append((s * way).sum() / (s * y).sum())
            way = way - scales[-1] * y
        way = way * ((past[-1][0] * past[-1][1]).sum() / (past[-1][1] ** 2).sum() if past else 1 / max(1.0, np.sqrt((slope**2).sum())))
        for (s, y), scale in zip(past, reversed(scales)):
            way = way + s * (scale - (y * way).sum() / (s * y).sum())
        step, down = 1.0, (slope * way).sum()
        while True:
            new, new_slope = f(x + step * way)
            if new <= value + 1e-4 * step * down or step < 1e-9:
                break
            step /= 2
        if new >= value * (1 - 1e-6):
            break
        s, y = step * way, new_slope - slope
        if (s * y).sum() > 1e-12:
            past = [*past, (s, y)][-memory:]
        x, value, slope = x + s, new, new_slope
    return x


def _train(rows: list[tuple[int, list[int]]], share: np.ndarray, buckets: int, steady: float, ridge: float) -> Model:
    """A ridge logistic model of rows (domain, buckets), in which domain d weighs share[d] in all."""
    kinds, size = len(share), np.bincount([d for d, _ in rows], minlength=len(share))
    y = np.array([d for d, _ in rows])
    at, cell = np.repeat(np.arange(len(rows)), [len(b) for _, b in rows]), np.concatenate([np.array(b, np.int64) for _, b in rows])
    count = np.stack([np.bincount(cell[y[at] == d], minlength=buckets) for d in range(kinds)]).astype(float)
    every = count.sum(0)
    mean = every[None] * size[:, None] / len(rows)
    # the likelihood-ratio statistic of bucket against domain: what may be chance counts little
    told = 2 * (count * np.log(np.where(count > 0, count, 1) / np.where((count > 0) & (mean > 0), mean, 1))).sum(0)
    trust = np.maximum(told, 0) / (np.maximum(told, 0) + steady)
    use, v = trust[cell] > 0, trust[cell]
    at, cell, v = at[use], cell[use], v[use]
    weigh = (share / np.maximum(size, 1))[y] / (share * (size > 0)).sum()
    one = np.eye(kinds)[y]

    def loss(x):
        w, b = x[:, :-1], x[:, -1]
        z = np.stack([np.bincount(at, v * w[d][cell], len(rows)) for d in range(kinds)], 1) + b
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        g = (p - one) * weigh[:, None]
        grad = np.stack([np.bincount(cell, v * g[at, d], buckets) for d in range(kinds)]) + ridge * w
        return -(np.log(p[np.arange(len(rows)), y] + 1e-300) * weigh).sum() + ridge / 2 * (w**2).sum(), np.concatenate([grad, g.sum(0)[:, None]], 1)

    start = np.zeros((kinds, buckets + 1))
    start[:, -1] = np.log(share)
    x = _minimise(loss, start)
    x -= x[:1]
    return Model(x[:, -1].tolist(), [np.clip(w * trust, -30, 30).round(3).tolist() for w in x[1:, :-1]])


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 1500, buckets: int = 1 << 16, steady: float = 25.0, ridge: float = 3e-4) -> Model:
    # labels of documents that earlier stages dropped say nothing about these
    named = settle(domains(labels).join(docs.select("doc_id"), "doc_id", "left_semi"))
    share = {r.domain: r["count"] for r in named.groupBy("domain").count().collect()}
    total = sum(share.values())
    prior = np.array([(share.get(d, 0) + 1) / (total + len(DOMAINS)) for d in DOMAINS])
    if not total:
        return Model(np.log(prior).tolist(), [[] for _ in DOMAINS[1:]])
    ids = None
    for d in DOMAINS:
        part = named.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        ids = part if ids is None else ids.unionByName(part)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).join(F.broadcast(ids), "doc_id")
    rows = sorted((r.doc_id, DOMAINS.index(r.domain), sorted(r["_b"])) for r in _buckets(sample, buckets).collect())  # an order of their own, so that equal input gives an equal model
    release(named)
    return _train([(d, b) for _, d, b in rows], prior, buckets, steady, ridge)


def _after(state: Column, steps: list[list[float]], most: float | None) -> Column:
    """(r, before) after steps of (momentum, gradient by domain), each projected to what is allowed."""
    if not steps:
        return state

    def step(s: Column, g: Column) -> Column:
        at = s["r"] + F.get(g, 0) * (s["r"] - s["before"])
        pull = sum((F.get(g, i + 1) * F.col(p) for i, p in enumerate(_P)), F.lit(0.0)) * F.col("_d")
        r = F.greatest(F.col("_least"), at - pull)
        return F.struct((r if most is None else F.least(r, F.lit(float(most)))).alias("r"), s["r"].alias("before"))

    return F.aggregate(F.array(*[F.array(*map(F.lit, g)) for g in steps]), state, step)


def rates(known: DataFrame, weights: dict[str, float], keep: str | None = None, *, rounds: int = 200, close: float = 1e-3, slow: float = 0.02, patience: int = 5, deep: int = 12, most: float | None = None) -> tuple[DataFrame, dict[str, float]]:
    """known (a written table of n_tokens, posteriors and what else is there) with rates, and what is left: expected less targeted token
    totals as shares of the target.

    Targets are weights of all tokens; given a domain to keep, of as many tokens as make its weight what it has."""
    least = F.lit(0.0)
    if keep:
        least = F.when(F.col(f"p_{keep}") >= F.greatest(*_P), 1.0).otherwise(0.0)
    mass = known.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * F.col(p)).alias(p) for p in _P]).first()
    if not mass.n:
        return known.withColumn("rate", F.lit(1.0) if most is None else F.lit(min(1.0, float(most)))), {}
    norm = sum(weights.values())
    whole = mass[f"p_{keep}"] / (weights[keep] / norm) if keep else mass.n
    target = [weights[d] / norm * whole / mass.n for d in DOMAINS]
    scale = [max(mass[p] / mass.n, 1e-9) for p in _P]
    start = F.greatest(least, F.lit(1.0) if most is None else F.lit(min(1.0, float(most))))
    at = known.withColumns({"_d": sum((F.col(p) / F.lit(x) for p, x in zip(_P, scale)), F.lit(0.0)), "_share": F.col("n_tokens") / F.lit(float(mass.n)), "_least": least, "rate": start})
    narrow = ["_d", "_share", "_least", *_P]
    work = at.select(*narrow, F.struct(F.col("rate").alias("r"), F.col("rate").alias("before")).alias("_s"))
    bound = work.agg(*[F.sum(F.col("_share") * F.col("_d") * F.col(a) * F.col(b)).alias(f"{i}{j}") for i, a in enumerate(_P) for j, b in enumerate(_P)]).first()
    step = 1 / max(sum(bound[f"{i}{j}"] for j in range(len(_P))) for i in range(len(_P)))

    written, steps, recent, best, since, turn = None, [], [], math.inf, 0, 1.0
    for _ in range(rounds):
        momentum = (turn - 1) / ((1 + math.sqrt(1 + 4 * turn * turn)) / 2)
        now = work.withColumn("_s", _after(F.col("_s"), recent, most))
        ahead = F.col("_s.r") + F.lit(momentum) * (F.col("_s.r") - F.col("_s.before"))
        sums = now.agg(*[F.sum(F.col("_s.r") * F.col("_share") * F.col(p)).alias(p) for p in _P], *[F.sum(ahead * F.col("_share") * F.col(p)).alias(f"a_{p}") for p in _P]).first()
        off = [sums[p] - t for p, t in zip(_P, target)]
        error = sum(x * x for x in off)
        since = 0 if error < best * (1 - slow) else since + 1
        if error <= close**2 * sum(t * t for t in target) or since >= patience:
            break
        if error > best:  # too much momentum: a plain step comes next
            turn, momentum, there = 1.0, 0.0, off
        else:
            there = [sums[f"a_{p}"] - t for p, t in zip(_P, target)]
            turn = (1 + math.sqrt(1 + 4 * turn * turn)) / 2
        best = min(best, error)
        steps.append([momentum, *[step * x for x in there]])
        recent.append(steps[-1])
        if len(recent) == deep:  # a written table keeps the work of a step small
            work, recent = settle(work.select(*narrow, _after(F.col("_s"), recent, most).alias("_s"))), []
            if written is not None:
                release(written)
            written = work
    at = at.withColumn("rate", _after(F.struct(F.col("rate").alias("r"), F.col("rate").alias("before")), steps, most)["r"])
    if written is not None:
        release(written)
    return at.drop("_d", "_share", "_least").withColumn("rate", F.round("rate", 6)), {d: x / t if t else x for d, x, t in zip(DOMAINS, off, target)}


def mix(docs: DataFrame, labels: DataFrame, *, weights: dict[str, float] | None = None, keep: str | None = None, with_text: bool = True, most: float | None = None, **options) -> DataFrame:
    """docs (without the text, if it isn't asked for) with n_tokens, p_<domain> and rate: how often each document is to be read, in expectation,
    and at most `most` times, where that is given. The result's attribute `left` says what is left to the targets."""
    model = fit(docs, labels, **options)
    given = [c for c in docs.columns if with_text or c != "text"]
    inner = [f"_g{i}" for i in range(len(given))]
    known = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(given, inner)], F.coalesce("text", F.lit("")).alias("_text"))
    known = _buckets(known, len(model.weights[0]) or 1)
    known = known.select(*inner, "n_tokens", _total(F.col("_b"), model).alias("_t"))
    known = known.select(*inner, "n_tokens", *[x.alias(f"_z{i}") for i, x in enumerate(_logits(F.col("_t"), model))])
    known = known.select(*inner, "n_tokens", *[x.alias(p) for p, x in zip(_P, _posteriors([F.col(f"_z{i}") for i in range(len(DOMAINS))]))])
    known = settle(known)  # the texts are read once; every iteration reads a few numbers a row
    out, left = rates(known, weights or WEIGHTS, keep, most=most)
    results = ["n_tokens", *_P, "rate"]
    out = out.select(*[F.col(x).alias(c) for x, c in zip(inner, beside(given, results))], *results)
    out.left = left
    return out


def drawn(mixed: DataFrame) -> DataFrame:
    """Rows of mix() drawn at their rates, by a hash of id and text: a rate's whole part, and one more with its fraction's chance."""
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(F.col("rate") + chance).cast("int")
    return mixed.where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")
