"""Mixing sources to target weights by soft membership. DataFrame functions only.

A naive Bayes classifier over hashed words, fitted on documents that the labels
table marks as good, predicts how far each document belongs to each domain (here
its language). Every document gets a rate, how often it is to appear, so that
the expected tokens of each domain (words times rate times membership) match the
target weights: nonnegative least squares by projected gradient. One step moves
a document's rate against the domains' errors, as far as it belongs to them, and
puts it back between the bounds; the errors, and how far the rates went, by which the
next step is scaled, are distributed sums. A rate is a fold of a document's
memberships over all steps so far, so no state is kept between steps. Rates have no
upper bound, so a rare domain reaches its weight too. `copies` rounds the rate up or
down by the document's hash, so that its expectation is the rate.

The classifier is fitted on at most TRAIN_DOCUMENTS documents, those with the
smallest hash of doc_id; memberships and sums cover all documents.

Defined cases: a null or empty text has no words and belongs to each domain by
the prior; without labelled documents all memberships are equal and all rates 1;
labels that are repeated count once; documents of other domains than the targets'
belong to the targets' by their words, as all do; repeated rows
get the same rate each; a null doc_id is a row like any; an empty table gives no
row; other columns are ignored by `rates` and kept by `mixed_documents`."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm.common import documents, member_filter, saved, spare, table, text_key

TARGETS = {"de": 0.16, "en": 0.55, "es": 0.13, "fr": 0.16}
TRAIN_DOCUMENTS = 4000
BUCKETS = 1 << 12
SMOOTHING = 0.1
#: Words beyond this number add no certainty: their evidence is averaged.
EVIDENCE_WORDS = 50
#: Moves that are tried at most, and those of them with weighted errors.
MOST_STEPS, SCALED_STEPS = 120, 10
CLOSE = 1e-4
#: So many moves must take this share off the squared errors, or the fit has come to rest.
CALM, LEAST_GAIN = 6, 0.02


def _word_rows(docs: DataFrame, *more: str) -> DataFrame:
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+")
    each = docs.select(*more, F.posexplode(words).alias("at", "word"))
    return each.select(*more, "at", (F.col("word") != "").alias("is_word"), F.pmod(F.hash("word"), F.lit(BUCKETS)).alias("bucket"))


def train(docs: DataFrame, labels: DataFrame, domains: list[str], domain: str, most: int = TRAIN_DOCUMENTS) -> tuple[list[float], list[list[float]]]:
    """Log priors of the domains, and the log likelihoods of each bucket: a table of fixed size."""
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality = 1 and doc_id is not null")
    some = some.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(domain).alias("domain"), "text").join(F.broadcast(some), "doc_id").where(F.col("domain").isin(domains))
    sums = lambda condition: [F.count_if(condition & (F.col("domain") == d)).alias(f"n{i}") for i, d in enumerate(domains)]
    counted = _word_rows(rows, "domain").groupBy("bucket").agg(*sums(F.col("is_word")), *[x.alias(f"d{i}") for i, x in enumerate(sums(F.col("at") == 0))])
    found = {r.bucket: r for r in counted.collect()}
    size = [sum(r[f"n{i}"] for r in found.values()) for i in range(len(domains))]
    held = [sum(r[f"d{i}"] for r in found.values()) for i in range(len(domains))]
    prior = [math.log((h + 1) / (sum(held) + len(domains))) for h in held]
    share = lambda b, i: math.log(((found[b][f"n{i}"] if b in found else 0) + SMOOTHING) / (size[i] + SMOOTHING * BUCKETS))
    return prior, [[share(b, i) for i in range(len(domains))] for b in range(BUCKETS)]


def memberships(docs: DataFrame, prior: list[float], model: list[list[float]]) -> DataFrame:
    """doc_id, text_key, rows (repeated rows), n_tokens, p (one number for each domain; sum 1)."""
    k = range(len(prior))
    known = docs.sparkSession.createDataFrame([(b, *x) for b, x in enumerate(model)], "bucket int, " + ", ".join(f"l{i} double" for i in k))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    joined = _word_rows(keyed, "doc_id", "text_key").join(F.broadcast(known), "bucket")
    summed = joined.groupBy("doc_id", "text_key").agg(F.count_if(F.col("at") == 0).alias("rows"), F.count_if("is_word").alias("words"), *[F.coalesce(F.sum(F.when(F.col("is_word"), F.col(f"l{i}"))), F.lit(0.0)).alias(f"s{i}") for i in k])
    summed = summed.withColumn("n_tokens", (F.col("words") / F.col("rows")).cast("long"))
    weight = F.least(F.lit(1.0), F.lit(float(EVIDENCE_WORDS)) / F.greatest(F.col("n_tokens"), F.lit(1))) / F.col("rows")
    score = F.array(*[F.col(f"s{i}") * weight + prior[i] for i in k])
    summed = summed.withColumn("score", score).withColumn("top", F.array_max("score"))
    odds = F.transform("score", lambda x: F.exp(x - F.col("top")))
    total = F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
    summed = summed.withColumn("odds", odds).withColumn("total", total)
    return summed.select("doc_id", "text_key", "rows", "n_tokens", F.transform("odds", lambda x: x / F.col("total")).alias("p"))


def _dot(p: Column, errors: Column) -> Column:
    return F.aggregate(F.zip_with(p, errors, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def rate(p: Column, moves: list[list[float]], least: float, most: float, start: Column | None = None) -> Column:
    """The rate after all moves, each given as length times error of each domain; it starts at 1."""
    start = F.lit(1.0) if start is None else start
    if not moves:
        return start
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in m]) for m in moves])
    return F.aggregate(steps, start, lambda r, m: F.greatest(F.lit(least), F.least(F.lit(most), r - _dot(p, m))))


def fit_rates(known: DataFrame, weights: list[float], least: float, most: float = math.inf) -> list[list[float]]:
    """Moves of the projected gradient; known: rows, n_tokens, p. A move takes all rates against the gradient of the squared
    errors at once (rate - p * move), then puts each back between the bounds. Its length is that which would have made the
    last two gradients equal (Barzilai and Borwein), at least 1 / the largest eigenvalue of the domains' curvature; a move
    after which the errors are larger than after the last few is tried again shorter.

    The first moves weight each domain's error by its curvature, so that rare domains keep pace; where all weights can be
    met they come to an end within a few moves. If they do not, plain least squares follow. Where the errors fall no more
    (the documents can't meet the weights within the bounds) or after MOST_STEPS, the best rates so far stand, with a
    warning that names the errors left."""
    k = range(len(weights))
    p = [F.col("p")[i] for i in k]
    tokens = F.col("rows") * F.col("n_tokens")
    upper = [(i, j) for i in k for j in k if i <= j]
    sums = known.agg(*[F.sum(tokens * x) for x in p], *[F.sum(tokens * p[i] * p[j]) for i, j in upper]).first()
    start, bend = np.array([x or 0.0 for x in sums[: len(weights)]]), np.zeros((len(weights), len(weights)))
    for (i, j), x in zip(upper, sums[len(weights) :], strict=True):
        bend[i, j] = bend[j, i] = x or 0.0
    if not start.sum():
        return []
    target = np.array(weights)
    # Where no document may be left out, the smallest corpus in which the largest domain has its share; else as many tokens as there are.
    size = (start / target).max() if least >= 1 else start.sum()

    def after(moves: list[list[float]], move: list[float]) -> tuple[np.ndarray, float]:
        """The errors after one more move, and how far it took the rates (squares, by tokens)."""
        at = known.select("p", tokens.alias("t"), rate(F.col("p"), moves, least, most).alias("r"))
        at = at.withColumn("to", rate(F.col("p"), [move], least, most, F.col("r")))
        found = at.agg(*[F.sum(F.col("t") * F.col("to") * x) for x in p], F.sum(F.col("t") * (F.col("to") - F.col("r")) ** 2)).first()
        return np.array(found[:-1]) / size - target, found[-1] / size

    moves: list[list[float]] = []
    errors, left = start / size - target, MOST_STEPS
    for scale, tries in ((np.maximum(np.diag(bend) / size, 1e-12), SCALED_STEPS), (np.ones(len(weights)), MOST_STEPS)):
        shortest = 1 / np.linalg.eigvalsh(bend / size / np.sqrt(np.outer(scale, scale))).max()
        length, cost = shortest, lambda e: float((e * e / scale).sum())  # noqa: B023
        past, best = [cost(errors)], (cost(errors), len(moves), errors)
        while np.abs(errors).max() >= CLOSE and left > 0 and len(past) <= tries:
            if len(past) > CALM and min(past[-CALM:]) > (1 - LEAST_GAIN) * min(past[:-CALM]):
                break
            move, left = (length * errors / scale).tolist(), left - 1
            there, moved = after(moves, move)
            change = there - errors
            bent = cost(change)
            if not bent:
                break  # all rates that could move are at a bound, or the errors cancel out in each document
            if cost(there) > max(past[-4:]) and length > 1.001 * shortest:
                length = max(shortest, length * max(0.1, -float((errors * change / scale).sum()) / bent / 2))
                continue
            moves.append(move)
            errors = there
            past.append(cost(errors))
            if past[-1] < best[0]:
                best = (past[-1], len(moves), errors)
            length = min(max(moved / bent, shortest), 1000 * shortest)
        moves, errors = moves[: best[1]], best[2]
    if np.abs(errors).max() >= CLOSE:
        warnings.warn(f"mixing: the documents do not meet the weights; errors {[round(float(e), 6) for e in errors]}", RuntimeWarning, stacklevel=2)
    return moves


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain: str = "lang", least: float = 0.0, most: float = math.inf) -> DataFrame:
    """One row for each different document: doc_id, text_key, rows, n_tokens, p, rate, copies."""
    domains = sorted(targets)
    weights = [targets[d] / sum(targets.values()) for d in domains]
    prior, model = train(docs, labels, domains, domain)
    known = saved(memberships(docs, prior, model), "memberships")
    # without labelled documents nothing is known that a rate could follow
    moves = fit_rates(known, weights, least, most) if len(set(prior)) > 1 or any(len(set(x)) > 1 for x in model) else []
    by_hash = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(1 << 30)) / float(1 << 30)
    out = known.withColumn("rate", rate(F.col("p"), moves, least, most))
    # a rate within rounding of a whole number is that number
    near = F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-6, F.round("rate")).otherwise(F.floor(F.col("rate") + by_hash))
    return out.withColumn("copies", near.cast("long"))


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, least: float = 1.0) -> DataFrame:
    """The documents with their columns, each as often as its copies say."""
    key, other_id, other_key, times, nth = (spare(docs, n) for n in ("_key", "_other_id", "_other_key", "_times", "_nth"))
    changed = rates(docs, labels, targets, least=least).where("copies <> 1").select(F.col("doc_id").alias(other_id), F.col("text_key").alias(other_key), F.col("copies").alias(times))
    changed = saved(changed, "copies")
    keyed = docs.withColumn(key, text_key())
    maybe = member_filter(changed, other_key, on=key)
    some = keyed.where(maybe).join(changed, (F.col(key) == F.col(other_key)) & F.col("doc_id").eqNullSafe(F.col(other_id)), "left").withColumn(times, F.coalesce(times, F.lit(1).cast("long")))
    some = some.where(F.col(times) > 0).withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), times)))
    return keyed.where(~maybe).select(*docs.columns).union(some.select(*docs.columns))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rates(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    each = found.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return each.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(sorted(TARGETS))], "rate", "copies")
