"""Mixing to target weights: posteriors of a classifier, and rates fitted by projected gradient.

A classifier learned from a bounded sample of the label table gives every document its posterior over the domains, rounded to
``1 / STEPS``.  Documents of one posterior get one rate, so tokens are first summed by posterior.  The rates, within [0, ``most``],
minimise the squared distance between the expected tokens of each domain and its target, over the tokens the domain has, plus ``NEAR``
times the squared distance of the rates from 1, which settles what the targets leave open.  The fit is a projected gradient: rates start
at 1, move along the gradient summed over the rounds, and are projected on [0, ``most``].  The gradient is scaled by the second moments of
the posteriors whose rates are still free, so about ten rounds suffice.  A round is one Spark aggregate over the posterior table that
weighs a dozen steps at once, always with the same plan; a handful of numbers reaches the driver.  Should ``ROUNDS`` rounds not bring
every domain to within ``CLOSE`` of where the best rates bring it, a warning and the column ``fit_gap`` of the report say so.  A document
is then taken ``floor(rate)`` times, and once more with a chance of the rest that depends on its id and text alone.

Targets are shares of a budget of tokens.  Without a given budget it is the largest one that asks of no domain to be ``kept`` more than
there is; by default that is every domain.  What the budget asks of another domain ends at the tokens it has, so a scarce domain that is
not kept stays below its share and costs the kept ones nothing.

A bounded number of labelled texts per domain is drawn among the documents at hand; a domain that has fewer leaves its part to the others.
Posteriors are then weighted back to the shares that the domains have among all labelled documents at hand.

Defined results: a null text has no tokens and the posterior of the empty text; without usable labels every posterior is even; if fewer
than two domains have labelled documents nothing can be told apart, so all rates are 1 and documents pass through unchanged; labels
of a document that disagree, or with nulls, are not learned from; an empty table gives an empty result; repeated rows share their rate
and draw; a very long text is read whole, as one row of one task; other columns pass through ``mix`` untouched.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailsift.llm.common import pieces, place_of, positional, stored, text_or_empty
from trailsift.llm.grams import DIMS, presence

LENGTHS = (1, 2, 3, 5)
LABELLED = 1_000  # bound of the labelled texts learned from, dealt evenly over the domains
STEPS = 100  # posteriors are multiples of 1 / STEPS
RIDGES = (0.01, 0.03, 0.1, 0.3, 1.0)  # tried by the classifier
SHARPNESS = (2.0, 4.0, 6.0, 8.0, 12.0)
ROUNDS = 30  # bound of the projected gradient rounds
CLOSE = 0.001  # of each domain's expected tokens to those of the best rates, as a share of its target
NEAR = 3e-4  # weight of staying near a rate of 1
DAMPED = (0.0, 0.01, 0.1, 1.0)  # parts of the supply added to the second moments: at 1 a step is safe whatever the posteriors
LENGTHS_TRIED = (1.0, 0.5, 0.25)


@dataclass
class Classifier:
    """Ridge regression over presence of n-grams, one domain against the rest; a softmax of its margins is the posterior."""

    domains: list[str]
    weights: np.ndarray  # features x domains
    bias: np.ndarray
    sharpness: float
    prior: np.ndarray  # share of each domain among the labels, over its share among the texts learned from
    learned: bool  # are there labelled texts of two domains or more?

    def posterior(self, rows: np.ndarray) -> np.ndarray:
        share = _softmax((_scaled(rows) @ self.weights + self.bias) * self.sharpness) * self.prior
        return share / share.sum(1, keepdims=True)


def _scaled(rows: np.ndarray) -> np.ndarray:
    return rows.astype(np.float32) / np.sqrt(np.maximum(rows.sum(1, dtype=np.int64), 1))[:, None].astype(np.float32)


def _softmax(margins: np.ndarray) -> np.ndarray:
    share = np.exp(margins - margins.max(1, keepdims=True))
    return share / share.sum(1, keepdims=True)


def fit(texts: list[bytes], labels: list[str], domains: Sequence[str], counts: dict[str, int] | None = None) -> Classifier:
    """``texts`` are packed presence rows; ``counts`` are the labelled documents they were drawn from, by domain.

    The ridge and the sharpness of the softmax are those with the best likelihood when each text is left out of its own prediction.
    """
    if not texts:
        return Classifier(list(domains), np.zeros((DIMS, len(domains)), np.float32), np.zeros(len(domains), np.float32), 1.0, np.ones(len(domains)), False)
    rows = np.unpackbits(np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1), axis=1).astype(np.float32)
    # In place: this is the largest array of the driver, LABELLED rows of DIMS numbers.
    rows /= np.sqrt(np.maximum(rows.sum(1), 1))[:, None]
    centre = rows.mean(0)
    rows -= centre
    truth = np.array(labels)[:, None] == np.array(domains)[None, :]
    shares = truth.mean(0)
    alike = (rows @ rows.T).astype(np.float64)
    best = (np.inf, None, 1.0)
    for ridge in RIDGES:
        inverse = np.linalg.inv(alike + ridge * np.eye(len(texts)))
        duals = inverse @ (truth - shares)
        left_out = truth - duals / np.diag(inverse)[:, None]
        for sharpness in SHARPNESS:
            loss = -np.log(_softmax(left_out * sharpness)[truth] + 1e-9).mean()
            best = min(best, (loss, duals, sharpness), key=lambda found: found[0])
    _, duals, sharpness = best
    weights = (rows.T @ duals).astype(np.float32)
    among = np.array([(counts or {}).get(d, 0) for d in domains], float)
    prior = np.where((among > 0) & (shares > 0), among / max(among.sum(), 1) / np.maximum(shares, 1e-12), 1.0)
    return Classifier(list(domains), weights, (shares - centre @ weights).astype(np.float32), sharpness, prior, bool((shares > 0).sum() > 1))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows = np.packbits(presence([t or "" for t in batch["text"].to_pylist()], LENGTHS, False), axis=1)
        yield pa.RecordBatch.from_arrays([batch["draw"], batch["domain"], pa.array([r.tobytes() for r in rows], pa.binary())], ["draw", "domain", "grams"])


def quotas(counts: dict[str, int], bound: int) -> dict[str, int]:
    """An even part of the bound for each domain; what small ones leave goes to the others."""
    out: dict[str, int] = {}
    for n, domain in enumerate(sorted(counts, key=lambda d: (counts[d], d))):
        out[domain] = min(counts[domain], (bound - sum(out.values())) // (len(counts) - n))
    return out


def learn(docs: DataFrame, labels: DataFrame, domains: Sequence[str], id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED) -> Classifier:
    """Fit on a bounded sample of the labelled documents.  ``labels`` has the id column and ``domain``."""
    agreed = labels.filter(F.col("domain").isin(*domains)).groupBy(id_col).agg(F.min("domain").alias("domain"), F.max("domain").alias("last"))
    agreed = agreed.filter((F.col("domain") == F.col("last")) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), "domain")
    # Only labels of documents at hand count, and each once, however often its document is repeated.
    held = stored(agreed.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi"), "labels-at-hand")
    counts = {r.domain: r.n for r in held.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], [], domains)
    drawn = held.withColumn("draw", F.xxhash64("id", F.lit("label")))
    parts = [drawn.filter(F.col("domain") == d).orderBy("draw", "id").limit(n) for d, n in quotas(counts, labelled).items() if n]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(reduce(DataFrame.union, parts)), "id")
    rows = texts.select("draw", "domain", "text").mapInArrow(_packed, "draw long, domain string, grams binary")
    kept = rows.groupBy("draw", "domain").agg(F.min("grams").alias("grams")).orderBy("draw", "domain").collect()
    return fit([bytes(r.grams) for r in kept], [r.domain for r in kept], domains, counts)


def _draw(own: Column, text: Column) -> Column:
    """A number from 0 to 1 that follows from id and text alone."""
    return F.pmod(F.xxhash64(own, text_or_empty(text), F.lit("take")), F.lit(2**52)) / F.lit(float(2**52))


def posteriors(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, draw (a number from 0 to 1 that follows from id and text), tokens, and posterior in steps of ``1 / STEPS``."""
    asked = docs.select(F.col(id_col).alias("id"), _draw(F.col(id_col), F.col(text_col)).alias("draw"), F.col(text_col).alias("text"))
    schema = T.StructType([asked.schema["id"], *T.StructType.fromDDL("draw double, tokens long, steps array<int>").fields])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [t or "" for t in batch["text"].to_pylist()]
            steps = _in_steps(model.posterior(presence(texts, LENGTHS, False)))
            tokens = pa.array([len(t.split()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["draw"], tokens, pa.array(steps.tolist(), pa.list_(pa.int32()))], schema.names)

    return asked.mapInArrow(judge, schema)


def _in_steps(posterior: np.ndarray) -> np.ndarray:
    """Whole steps that sum to ``STEPS``: the likeliest domain takes what rounding leaves."""
    steps = np.round(posterior * STEPS).astype(np.int32)
    steps[np.arange(len(steps)), posterior.argmax(1)] += STEPS - steps.sum(1, dtype=np.int32)
    return steps


@dataclass
class Rates:
    """The rate of a posterior: from 1 along the summed gradient of the domains, projected on [0, ``most``]."""

    slope: list[float]
    most: float
    left: float = 0.0  # largest gap of a domain that the fit left, as a share of its target

    def column(self) -> Column:
        along = reduce(lambda a, b: a + b, (F.col("steps")[i] * F.lit(x) for i, x in enumerate(self.slope)))
        return F.least(F.lit(self.most), F.greatest(F.lit(0.0), 1 - along / F.lit(float(STEPS))))

    def of(self, steps: np.ndarray) -> np.ndarray:
        return np.clip(1 - steps @ np.array(self.slope) / STEPS, 0.0, self.most)


def _evaluated(cells: DataFrame, slopes: np.ndarray, most: float) -> list[tuple[np.ndarray, float, np.ndarray]]:
    """For each of the slopes: expected tokens by domain, the potential of the rates, and the second moments of the posteriors free to move.

    One aggregate over the posterior table.  The slopes travel as one literal, so every round has the same plan and the same compiled code.
    """
    k = slopes.shape[1]
    given = F.from_json(F.lit(json.dumps(slopes.tolist())), T.ArrayType(T.ArrayType(T.DoubleType())))
    share = [F.col("steps")[i] / F.lit(float(STEPS)) for i in range(k)]
    along = reduce(lambda a, b: a + b, (s * F.col("slope")[i] for i, s in enumerate(share)))
    tokens, rate, at, top = F.col("tokens"), F.col("rate"), F.col("at"), F.lit(most)
    potential = F.when(at < 0, 0.0).when(at > top, top * at - top * top / 2).otherwise(at * at / 2)
    free = F.when((at >= 0) & (at <= top), tokens).otherwise(F.lit(0))
    moments = [F.sum(free * share[i] * share[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i + 1)]
    placed = cells.select("tokens", "steps", F.posexplode(given).alias("n", "slope")).withColumn("at", 1 - along).withColumn("rate", F.least(top, F.greatest(F.lit(0.0), at)))
    rows = placed.groupBy("n").agg(F.sum(tokens * potential).alias("potential"), *(F.sum(tokens * rate * s).alias(f"s{i}") for i, s in enumerate(share)), *moments).collect()
    full = lambda r: np.array([[r[f"m{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)], float)
    return [(np.array([r[f"s{i}"] for i in range(k)]), r["potential"], full(r)) for r in sorted(rows, key=lambda r: r["n"])]


def fit_rates(judged: DataFrame, targets: Sequence[float], budget: float | None = None, most: float = 1.0, kept: Sequence[int] = ()) -> Rates:
    """``targets`` are weights of the domains, in the order of the classifier; ``kept`` are the places of those that set the budget."""
    cells = stored(judged.groupBy("steps").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"), "posterior-tokens")
    k = len(targets)
    slope = np.zeros(k)
    first = _evaluated(cells, slope[None, :], most)
    if not first:
        return Rates(slope.tolist(), most)
    supply, potential, moments = first[0]
    supply = supply / min(most, 1.0)
    weights = np.array(targets, float) / sum(targets)
    if budget is None:
        asking = [i for i in range(k) if weights[i] > 0 and supply[i] > 0]
        budget = min((supply[i] / weights[i] for i in [i for i in asking if i in kept] or asking), default=0.0)
    wanted = np.minimum(budget * weights, supply * most)
    scale = np.where(supply > 0, supply, 1.0)
    counts = np.maximum(wanted, CLOSE * supply.sum())
    got = supply * min(most, 1.0)
    for _ in range(ROUNDS):
        gradient = got - wanted - NEAR * scale * slope
        if (np.abs(gradient) <= CLOSE * counts).all():
            break
        directions = [np.linalg.solve(moments + np.diag(max(NEAR, damped) * scale), gradient) for damped in DAMPED]
        tried = np.array([slope + length * d for d in directions for length in LENGTHS_TRIED])
        found = _evaluated(cells, tried, most)
        # The least potential: the rates minimise distance and potential together, so it falls from round to round.
        value = [p + wanted @ x + NEAR / 2 * (scale * x * x).sum() for x, (_, p, _) in zip(tried, found, strict=True)]
        n = int(np.argmin(value))
        slope, (got, potential, moments) = tried[n], found[n]
    gradient = got - wanted - NEAR * scale * slope
    left = float((np.abs(gradient) / counts).max())
    if left > CLOSE:
        warnings.warn(f"mixing: {ROUNDS} rounds leave a domain {left:.3g} of its target away from the best rates", stacklevel=2)
    return Rates(slope.tolist(), most, left)


def _rates(judged: DataFrame, model: Classifier, targets: dict[str, float], kept: Sequence[str]) -> Rates:
    return fit_rates(judged, list(targets.values()), kept=[list(targets).index(d) for d in kept]) if model.learned else Rates([0.0] * len(targets), 1.0)


def report(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", kept: Sequence[str] = ()) -> DataFrame:
    """Per document: id, tokens, posterior steps, rate, copies, and the gap that the fit left (0 to ``CLOSE`` unless it ended early)."""
    model = learn(docs, labels, list(targets), id_col, text_col)
    judged = stored(posteriors(docs, model, id_col, text_col), "posteriors")
    rates = _rates(judged, model, targets, kept)
    rated = judged.withColumn("rate", rates.column()).withColumn("fit_gap", F.lit(rates.left))
    copies = F.floor("rate") + F.when(F.col("draw") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return rated.withColumn("copies", copies.cast("int"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", kept: Sequence[str] = ()) -> DataFrame:
    """The documents as often as their rate says, with all their columns."""
    model = learn(docs, labels, list(targets), id_col, text_col)
    if not model.learned:
        return docs
    rates = _rates(posteriors(docs, model, id_col, text_col), model, targets, kept)
    at = docs.columns.index(text_col)
    renamed = positional(docs)
    schema, names = renamed.schema, renamed.columns
    asked = renamed.withColumn("draw", _draw(F.col(place_of(docs, id_col)), F.col(place_of(docs, text_col))))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rate = rates.of(_in_steps(model.posterior(presence([t or "" for t in batch.column(at).to_pylist()], LENGTHS, False))))
            copies = np.floor(rate) + (batch["draw"].to_numpy() < rate - np.floor(rate))
            chosen = batch.take(pa.array(np.repeat(np.arange(len(rate)), copies.astype(int))))
            yield pa.RecordBatch.from_arrays(chosen.columns[:-1], names)

    return asked.mapInArrow(take, schema).toDF(*docs.columns)
