"""Mixing sources to target weights with soft membership.

A classifier learnt from the label table gives each document a posterior over the domains ``clean``, ``low`` (quality 0) and
``toxic``. Nonnegative document rates r then make the expected tokens of each domain, sum of r * tokens * posterior, meet the
targets: least squares over the misses of the domains' shares, plus ``NEARNESS`` times the token-weighted squared distance of the rates from
1, so that targets which no nonnegative rates meet have an answer, and of many answers the nearest to 1 is taken.

The fit is projected gradient on the rates, r <- max(0, r - step * gradient), in a metric that weighs a document by its tokens and by
the share of the domains it is likely to be of, so that rare domains move as fast as common ones. The step is the inverse of the
largest curvature, from one distributed sum. Gradient and step depend on a document's posterior alone, so documents with equal posteriors
are summed up first, and every document's rate follows from its posterior and the rounds' misses.

Directions in which documents hardly differ converge slowly, so rounds start from the fit of a coarse copy: the documents' tokens by cell
of a grid over the posteriors, at most ``CELLS`` cells whatever the number of documents, fitted by the same method (accelerated) on the
driver. Then every document takes part in each round, one distributed sum of the domains' tokens, until rates change by less than
``TOLERANCE`` on the tokens' average; ``converged`` says whether that was so within ``ROUNDS``.

Defined results: null and empty texts have 0 tokens, a posterior and a rate; without labels every document is ``clean`` for
lack of anything else; of labels that disagree on a document the majority holds (``one_label``); repeated rows are equal; an
empty table gives an empty result; documents that tie, with equal posteriors, have equal rates. Domains without any tokens are left out of the fit and their target is shared out among the
others; without any tokens at all every rate is 1. Texts are read whole. Columns n_tokens, p_clean, p_low, p_toxic, rate and converged of the
input give way to the operator's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quality_classifier as qc
from . import textvec as tv
from .common import Saved, one_label, sized, with_text_columns

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.95, "low": 0.04, "toxic": 0.01}
BUCKETS = 1 << 18
ROUNDS, TOLERANCE, NEARNESS = 200, 1e-6, 3e-4
CELLS = 40_000
#: Rounds after which the rates so far are written out.
WRITTEN = 8


def _words(column: pa.Array) -> tv.Words:
    data, offsets = tv.utf8(column)
    data = tv.LOWER[data]
    return tv.Words(data, offsets, tv.ALNUM[data])


def _buckets(words: tv.Words) -> np.ndarray:
    return (words.hash >> tv.U(64 - 18)).astype(np.int64)


@dataclass
class Posteriors:
    """Trees for ``low`` and for ``toxic``, and the words' log-odds of toxicity by hash bucket."""

    odds: np.ndarray
    low: qc.Trees
    toxic: qc.Trees

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors (a row for each text) and tokens."""
        words = _words(column)
        low = self.low.score(qc.features(column))
        toxic = self.toxic.score(lexical(words, self.odds)) * (1 - low)
        return np.stack([1 - low - toxic, low, toxic], axis=1), words.counts


def lexical(words: tv.Words, odds: np.ndarray) -> np.ndarray:
    """Greatest log-odds, number and share of words with strong ones."""
    return _strength(odds[_buckets(words)], np.ones(len(words.hash), np.int64), words.at)


def _strength(odds: np.ndarray, times: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``lexical`` of texts whose words, from at[i] to at[i + 1], have ``odds`` and stand there so many ``times``."""
    full = at[1:] > at[:-1]
    most = np.zeros(len(full))
    if len(odds):
        most[full] = np.maximum.reduceat(odds, at[:-1][full])
    strong = tv.sums_by_text(np.where(odds > 3, times, 0), at)
    return np.stack([most, strong, strong / np.maximum(tv.sums_by_text(times, at), 1)], axis=1)


def _listed(x: np.ndarray) -> pa.Array:
    """An array of each row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> Posteriors:
    known = one_label(labels, id, "quality", "toxic").filter(F.col("quality").isNotNull() | F.col("toxic").isNotNull())
    rows = Saved(known, "mixing-labels")
    chosen = docs.select(id, F.col(text).alias("text")).join(sized(rows.df, rows.count()), id)

    def described(column: pa.Array) -> list[pa.Array]:
        x, words = qc.features(column), _words(column)
        b = _buckets(words)
        own = [np.unique(b[words.at[i] : words.at[i + 1]], return_counts=True) for i in range(len(words.counts))]
        return [_listed(x), *(pa.array([o[k] for o in own], pa.list_(pa.int64())) for k in (0, 1))]

    fields = [T.StructField("x", T.ArrayType(T.DoubleType())), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("buckets", "times"))]
    seen = Saved(with_text_columns(chosen, [id, "quality", "toxic"], described, fields), "mixing-features")
    # log-odds of toxicity of words in five labelled documents or more
    n = seen.df.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("n")).first()
    per = seen.df.select("toxic", F.explode("buckets").alias("b")).groupBy("b").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("n")).filter("t + n >= 5")
    odds = np.zeros(BUCKETS)
    for r in per.collect():  # BUCKETS rows at most
        odds[r["b"]] = np.log((r["t"] + 0.5) / ((n["t"] or 0) + 1)) - np.log((r["n"] + 0.5) / ((n["n"] or 0) + 1))
    if not n["t"]:
        odds[:] = 0
    low = seen.df.filter(F.col("quality").isNotNull()).select((1.0 - F.col("quality")).alias("y"), "x")
    low_trees = qc.grow_table(low, len(qc.FEATURES), trees=40)

    def strong(batches):  # from the counted words, so that texts are read once
        for batch in batches:
            buckets, times = batch.column("buckets"), batch.column("times").flatten().to_numpy()
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(buckets).to_numpy())])
            x = _strength(odds[buckets.flatten().to_numpy()], times, at)
            yield pa.RecordBatch.from_arrays([batch.column("y"), _listed(x)], names=["y", "x"])

    counted = seen.df.filter(F.col("toxic").isNotNull()).select(F.col("toxic").cast("double").alias("y"), "buckets", "times")
    toxic = Saved(counted.mapInArrow(strong, "y double, x array<double>"), "mixing-toxic")
    toxic_trees = qc.grow_table(toxic.df, 3, trees=60, depth=3)
    for learnt, trees in ((low, low_trees), (toxic.df, toxic_trees)):
        if learnt.isEmpty():
            trees.base = -40.0
    for written in (rows, seen, toxic):
        written.drop()
    return Posteriors(odds.astype(np.float32), low_trees, toxic_trees)


def _accelerated(tokens: np.ndarray, p: np.ndarray, wanted: np.ndarray, most: int = 50_000) -> np.ndarray:
    """The misses of the best rates for rows of posteriors ``p`` with shares ``tokens`` of all tokens."""
    step = 1 / (np.linalg.eigvalsh((p * tokens[:, None]).T @ p).max() + NEARNESS)
    rate = ahead = np.ones(len(tokens))
    t = 1.0
    for _ in range(most):
        miss = (p * (tokens * ahead)[:, None]).sum(0) - wanted
        following = np.maximum(0, ahead - step * (p @ miss + NEARNESS * (ahead - 1)))
        if (tokens * (ahead - following) * (following - rate)).sum() > 0:
            t = 1.0
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        moved, ahead = (tokens * np.abs(following - rate)).sum(), following + (t - 1) / later * (following - rate)
        rate, t = following, later
        if moved < TOLERANCE / 1000:
            break
    return (p * (tokens * rate)[:, None]).sum(0) - wanted


@dataclass
class Rates:
    """Rates as a function of the posteriors: where they start, the misses of each round (a number for each domain) and its step."""

    shares: list[float]
    step: float
    start: list[float]
    misses: list[list[float]] = field(default_factory=list)
    converged: bool = True

    def first(self, p: list[Column]) -> Column:
        """What rates are best at the misses that the coarse fit ends with: 1 - p . misses / NEARNESS, or 0."""
        return F.greatest(F.lit(0.0), sum((c * float(-x / NEARNESS) for c, x in zip(p, self.start, strict=True)), F.lit(1.0)))

    def after(self, p: list[Column], rate: Column, misses: list[list[float]]) -> Column:
        """``rate`` after rounds with ``misses``."""
        if not misses:
            return rate
        of = lambda xs: sum((c * float(x) for c, x in zip(p, xs, strict=True)), F.lit(0.0))
        pace = F.lit(self.step) / F.greatest(of(self.shares), F.lit(1e-12))
        for m in misses:
            rate = F.greatest(F.lit(0.0), rate * (1 - pace * NEARNESS) - pace * (of(m) - NEARNESS))
        return rate

    def column(self, posteriors: list[str]) -> Column:
        p = [F.col(c) for c in posteriors]
        return self.after(p, self.first(p), self.misses)


def fit_rates(members: DataFrame, tokens: str, posteriors: list[str], targets: list[float], rounds: int = ROUNDS) -> Rates:
    """The rates for ``members``, a table with token counts and posteriors."""
    k = len(posteriors)
    p, t = [F.col(c) for c in posteriors], F.col("__t")
    kinds = Saved(members.groupBy(*posteriors).agg(F.sum(F.col(tokens).cast("double")).alias("__t")).filter("__t > 0"), "kinds")
    row = kinds.df.agg(F.sum(t).alias("all"), *(F.sum(t * p[i]).alias(f"s{i}") for i in range(k))).first()
    total = row["all"] or 0.0
    if not total:
        kinds.drop()
        return Rates([1.0] * k, 0.0, [0.0] * k)
    shares = np.array([row[f"s{i}"] / total for i in range(k)])
    alive = shares > 1e-9
    wanted = np.where(alive, targets, 0.0)
    wanted = wanted / wanted.sum() if wanted.sum() > 0 else shares

    wide = int(CELLS ** (1 / max(k - 1, 1)))
    cells = [F.floor(c * wide).alias(f"__c{i}") for i, c in enumerate(p[1:])]
    coarse = kinds.df.groupBy(*cells).agg(F.sum(t).alias("n"), *(F.sum(t * c).alias(f"s{i}") for i, c in enumerate(p))).collect()  # CELLS rows or so
    n = np.array([r["n"] for r in coarse])
    start = _accelerated(n / total, np.array([[r[f"s{i}"] / r["n"] for i in range(k)] for r in coarse]), wanted)

    weight = sum((c * float(x) for c, x in zip(p, shares, strict=True)), F.lit(0.0))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = kinds.df.agg(*(F.sum(t * p[i] * p[j] / F.greatest(weight, F.lit(1e-12))).alias(f"m{i}_{j}") for i, j in pairs), F.min(weight).alias("least")).first()
    bend = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] / total for j in range(k)] for i in range(k)])
    step = 1 / (float(np.linalg.eigvalsh(bend).max()) + NEARNESS / max(row["least"], 1e-12))
    fit = Rates(shares.tolist(), step, np.where(alive, start, 0.0).tolist())
    kinds.df = kinds.df.withColumn("__rate", fit.first(p))
    since: list[list[float]] = []
    while len(fit.misses) < rounds:
        # one sum gives the domains' tokens now and how far the last round moved the rates
        before, now = (fit.after(p, F.col("__rate"), m) for m in (since[:-1], since))
        got = kinds.df.agg(*(F.sum(t * p[i] * now).alias(f"s{i}") for i in range(k)), F.sum(t * F.abs(now - before)).alias("moved")).first()
        if since and got["moved"] / total < TOLERANCE:
            break
        miss = [float(got[f"s{i}"] / total - wanted[i]) if alive[i] else 0.0 for i in range(k)]
        fit.misses.append(miss)
        since.append(miss)
        if len(since) > WRITTEN:
            written = Saved(kinds.df.withColumn("__rate", fit.after(p, F.col("__rate"), since[:-1])), "kinds")
            kinds.drop()
            kinds, since = written, since[-1:]
    else:
        fit.converged = False
    kinds.drop()
    return fit


def mix(docs: DataFrame, labels: DataFrame, keep: list[str], text: str = "text", id: str = "doc_id", targets: dict[str, float] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` with n_tokens, p_clean, p_low, p_toxic, rate and converged."""
    targets = targets or TARGETS
    shipped = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id, text))  # 1 MB of log-odds and a few thousand nodes

    def compute(column: pa.Array) -> list[pa.Array]:
        p, n = shipped.value(column)
        return [pa.array(n.astype(np.int64)), *(pa.array(p[:, i]) for i in range(len(DOMAINS)))]

    names = [f"p_{d}" for d in DOMAINS]
    fields = [T.StructField("n_tokens", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in names)]
    keep = [c for c in keep if c not in ("rate", "converged")]
    members = Saved(with_text_columns(docs, keep, compute, fields, text), "mixing")
    fit = fit_rates(members.df, "n_tokens", names, [targets[d] for d in DOMAINS])
    return members.df.withColumn("rate", fit.column(names)).withColumn("converged", F.lit(fit.converged))
