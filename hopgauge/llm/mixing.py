"""Mixing documents to target weights over domains that are known for a part of them only.

A classifier is trained on a labelled table (doc_id, domain) and predicts for every document the posteriors of all domains: its soft
membership. A document of n tokens at rate r then stands for r * n * posterior expected tokens of each domain. Rates are fitted by
least squares: the domains' shares of the token budget shall match the targets, with a very small pull of every rate towards 1 and
with no rate below ``least`` (0 or more). At the optimum a projected gradient step from rate 1 leads to the very rates whose residual made the
step: r = max(least, 1 - posteriors . z) with pull * z = what the domains have too much. So a round is a distributed evaluation of such
projected steps: rows compute their rates for a few trial steps z, and one aggregation of a few numbers a domain gives each trial's
totals, objective and curvature over the rates that the bound does not hold; the driver goes on from the best trial in the direction of the
scaled remaining gradient, and never keeps a worse one. No row has a state, so a round costs one pass over a narrow table of posteriors.
The fit ends when what remains of the gradient is nearly zero; ``Rates.converged`` says whether it did within ``rounds``, and ``report``
what each domain wanted and reached (targets may be out of reach: no rate can take tokens away from a domain under ``least``, or
give them to one without any).

The classifier is a naive Bayes model over hashed word beginnings and over the signs and capitals around words. Its training sample is bounded
(at most ``sample`` labelled documents, chosen by hash); posteriors, token totals and rates cover all rows.

Defined results: a null or empty text has no tokens, the prior as its posterior, and a rate of 1, since no rate of it changes a total;
null domains and labels of unknown documents are ignored; a doc_id with several labels counts with the smallest; rows of one doc_id are mixed one by one;
without labels there is one domain; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopgauge.llm.common import frugal, remembered, table, written

BUCKETS = 1 << 14
#: The driver holds BUCKETS numbers and the square of it a domain.
MOST_DOMAINS = 256
#: Different words that a worker remembers.
MEMORY = 1 << 18
_CORE = re.compile(r"[^\W_]+(?:.*[^\W_]+)?")
#: Bucket of words that are all core, by case.
_BARE = {case: zlib.crc32(b"\0" + case.encode()) % BUCKETS for case in "Ul"}


def features(word: bytes) -> tuple[int, int]:
    """Buckets of a word: its beginning in lower case, and what is around it."""
    text = word.decode("utf-8", "surrogatepass")
    if text[:1].isalnum() and text[-1:].isalnum():  # most words: nothing is around
        inner = text
    else:
        core = _CORE.search(text)
        inner = core.group(0) if core else ""
    case = "U" if len(inner) > 1 and inner.isupper() else "l"
    begin = zlib.crc32(inner[:4].lower().encode("utf-8", "surrogatepass")) % BUCKETS
    if len(inner) == len(text):
        return begin, _BARE[case]
    around = text.replace(inner, case, 1) if inner else text[:4]
    return begin, zlib.crc32(b"\0" + around.encode("utf-8", "surrogatepass")) % BUCKETS


class _Buckets(dict):
    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = out = features(word)
        return out


@dataclass
class Classifier:
    """domains, their log priors, log probabilities of buckets (BUCKETS, domains)."""

    domains: list[str]
    prior: np.ndarray
    given: np.ndarray

    def posterior(self, words: list[bytes]) -> np.ndarray:
        """Evidence counts as that of at most 64 words, for words of a text are not independent."""
        score = self.prior.copy()
        if words:
            hits = np.array([features(w) for w in words])
            score += (self.given[hits[:, 0]] + self.given[hits[:, 1]]).sum(0) * (min(len(words), 64) / len(words))
        score = np.exp(score - score.max())
        return score / score.sum()


class _Numbers(dict):
    """Numbers of words from 1 in order of appearance; ``new`` holds those that are not in the rows yet."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        self.new.append(word)
        return n


class Remembering:
    """A classifier with a memory of words' log probabilities."""

    def __init__(self, model: Classifier) -> None:
        self.model = model
        self.numbers = _Numbers()
        self.rows = np.zeros((1, len(model.domains)), np.float32)

    def posteriors(self, texts: list[list[bytes]]) -> np.ndarray:
        if len(self.numbers) > MEMORY:
            self.numbers, self.rows = _Numbers(), self.rows[:1]
        n = np.array([len(w) for w in texts])
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(texts)), np.int64, int(n.sum()))
        if self.numbers.new:
            hits = np.array([features(w) for w in self.numbers.new])
            self.rows = np.concatenate([self.rows, (self.model.given[hits[:, 0]] + self.model.given[hits[:, 1]]).astype(np.float32)])
            self.numbers.new = []
        sums = np.zeros((len(texts), self.rows.shape[1]))
        full = np.flatnonzero(n)
        if len(full):
            sums[full] = np.add.reduceat(self.rows[numbers].astype(np.float64), np.r_[0, np.cumsum(n[full])[:-1]], axis=0)
        score = self.model.prior + sums * (np.minimum(n, 64) / np.maximum(n, 1))[:, None]
        score = np.exp(score - score.max(1, keepdims=True))
        return score / score.sum(1, keepdims=True)


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def fit_classifier(docs: DataFrame, labelled: DataFrame, sample: int = 20_000) -> Classifier:
    """docs: doc_id, text; labelled: doc_id, domain."""
    labels = labelled.where("domain IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("domain").cast("string")).alias("domain"))
    # at most sample short rows, hence the broadcast: no text is shuffled
    chosen = F.broadcast(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered("buckets", _Buckets)
        of: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        held: dict[str, Counter] = {}  # words not yet in the counts of buckets

        def settle(domain: str) -> None:
            words = held.pop(domain)
            if words:
                np.add.at(of[domain], np.array([known[w] for w in words]), np.fromiter(words.values(), np.int64, len(words))[:, None])

        for batch in batches:
            for text, domain in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                of.setdefault(domain, np.zeros(BUCKETS, np.int64))
                seen[domain] = seen.get(domain, 0) + 1
                words = held.setdefault(domain, Counter())
                words.update(_split(text.as_py()))
                if len(words) > MEMORY // MOST_DOMAINS:
                    settle(domain)
        for domain in list(held):
            settle(domain)
        for domain, counts in of.items():
            some = np.flatnonzero(counts)
            buckets, n = np.r_[-1, some], np.r_[seen[domain], counts[some]]
            yield pa.RecordBatch.from_arrays([pa.array([domain] * len(n)), pa.array(buckets.astype(np.int32)), pa.array(n)], ["domain", "bucket", "n"])

    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).join(chosen, "doc_id").select("text", "domain")
    # the check reads MOST_DOMAINS + 1 names at most
    if len(labels.select("domain").distinct().limit(MOST_DOMAINS + 1).collect()) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    rows = pairs.mapInArrow(frugal(counted), "domain string, bucket int, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = rows.column("domain").to_pylist()
    domains = sorted(set(names)) or ["all"]
    counts, prior = np.zeros((BUCKETS, len(domains))), np.zeros(len(domains))
    for domain, bucket, n in zip(names, rows.column("bucket").to_pylist(), rows.column("n").to_pylist(), strict=True):
        if bucket < 0:
            prior[domains.index(domain)] = n
        else:
            counts[bucket, domains.index(domain)] = n
    smooth = 0.1
    return Classifier(domains, np.log((prior + 1) / (prior + 1).sum()), np.log((counts + smooth) / (counts.sum(0) + smooth * BUCKETS)))


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, n_tokens (words), posteriors (array in the order of model.domains) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS and the number of domains
    name = zlib.crc32(model.given.tobytes())

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = remembered(("mixing", name), lambda: Remembering(sent.value))
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [_split(t.as_py()) for t in part.column(1)]
                p = classifier.posteriors(texts)
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), values], ["doc_id", "n_tokens", "posteriors"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(frugal(predict), "doc_id long, n_tokens long, posteriors array<double>")


@dataclass
class Rates:
    """The projected step z by domain and the least rate; shares before and after, targets (all of the tokens there are); whether the fit came to its end."""

    step: np.ndarray
    least: float
    natural: np.ndarray
    fitted: np.ndarray
    target: np.ndarray
    converged: bool = False

    def of(self, posteriors: np.ndarray) -> np.ndarray:
        return np.maximum(self.least, 1 - posteriors @ self.step)

    def column(self, posteriors: str) -> Column:
        dot = F.aggregate(F.zip_with(posteriors, F.array(*[F.lit(float(z)) for z in self.step]), lambda p, z: p * z), F.lit(0.0), lambda a, x: a + x)
        return F.greatest(F.lit(float(self.least)), 1 - dot)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


#: Lengths of the steps that a round tries, of the scaled one.
LENGTHS = (1.0, 0.5, 0.2, 0.05)


def fit_rates(members: DataFrame, targets: np.ndarray, budget: float = 1.0, least: float = 0.0, pull: float = 1e-8, rounds: int = 100, close: float = 1e-10) -> Rates:
    """members: n_tokens, posteriors (a written table, read once a round); targets: the domains' weights; budget: expected tokens over those there are."""
    d = len(targets)
    goal = budget * targets / targets.sum()
    held = 1 - least  # where posteriors . z reaches it, the bound holds the rate

    def evaluated(trials: np.ndarray) -> np.ndarray:
        """For each trial step: totals by domain, integral of the rates along the step, second moments of the free rows; and all tokens."""
        width = d + 1 + d * d

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(trials) * width + 1)
            for batch in batches:
                if not batch.num_rows:
                    continue
                n, p = batch.column(0).to_numpy().astype(np.float64), _matrix(batch.column(1))
                sums[-1] += n.sum()
                for k, z in enumerate(trials):
                    t = p @ z
                    free = t < held
                    m, q, inner = n[free], p[free], np.minimum(t, held)
                    along = inner - inner**2 / 2 + least * (t - inner)
                    sums[k * width : (k + 1) * width] += np.r_[(n * np.maximum(least, 1 - t)) @ p, n @ along, ((q * m[:, None]).T @ q).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["i", "x"])

        rows = members.select("n_tokens", "posteriors").mapInArrow(part, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(len(trials) * width + 1)
        for r in rows:
            out[r["i"]] = r["x"]
        return out[:-1].reshape(-1, width) / max(out[-1], 1.0)

    def value(z: np.ndarray, found: np.ndarray) -> float:
        return 0.5 * pull * z @ z + goal @ z - found[d]

    z = np.zeros(d)
    found = evaluated(z[None])[0]
    rates, shrink = Rates(z, least, found[:d] / max(1.0, least), found[:d], goal), 1.0
    for _ in range(rounds):
        gradient = pull * z - (found[:d] - goal)
        if np.abs(gradient).max() <= close:
            rates.converged = True
            break
        way = -np.linalg.solve(found[d + 1 :].reshape(d, d) + pull * np.eye(d), gradient)
        trials = z + shrink * np.array(LENGTHS)[:, None] * way
        results = evaluated(trials)
        values = [value(t, x) for t, x in zip(trials, results, strict=True)]
        best = int(np.argmin(values))
        # far from the end the objective decides, near it (where it does not change any more) the gradient
        flatter = [np.abs(pull * t - (x[:d] - goal)).max() for t, x in zip(trials, results, strict=True)]
        if not values[best] < value(z, found) and min(flatter) < 0.9 * np.abs(gradient).max() and np.abs(gradient).max() < 1e-7:
            best = int(np.argmin(flatter))
        elif not values[best] < value(z, found):
            shrink *= LENGTHS[-1]
            if shrink < 1e-9:
                rates.converged = bool(np.abs(gradient).max() <= 1e3 * close)
                break
            continue
        z, found, shrink = trials[best], results[best], 1.0
        rates.step, rates.fitted = z, found[:d]
    return rates


def shares(members: DataFrame, domains: int) -> np.ndarray:
    """The domains' shares of all expected tokens at rate 1."""
    sums = members.select(*[F.sum(F.col("n_tokens") * F.col("posteriors")[i]).alias(f"d{i}") for i in range(domains)]).first()
    natural = np.array([x or 0.0 for x in sums])
    return natural / max(natural.sum(), 1e-300)


def mix(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | Callable[[dict[str, float]], dict[str, float]] | None = None,
    power: float = 0.5, budget: float | None = 1.0, least: float = 0.0, sample: int = 20_000,
) -> tuple[DataFrame, Classifier, Rates]:
    """doc_id, n_tokens, posteriors, rate of every row; the classifier; the fit.

    weights: target weight by domain (others 0), or a function that makes it of the domains' natural shares; without it, these shares to
    the given power. budget None: just so many expected tokens that no domain needs fewer than it has. Weights that are negative or not
    finite are an error, as are more than MOST_DOMAINS domains.
    """
    model = fit_classifier(docs, labelled, sample)
    members = written(memberships(docs, model), "memberships")
    natural = shares(members, len(model.domains))
    if callable(weights):
        weights = weights(dict(zip(model.domains, natural.tolist(), strict=True)))
    targets = natural**power if weights is None else np.array([float(weights.get(d, 0.0)) for d in model.domains])
    if not (np.isfinite(targets) & (targets >= 0)).all():
        raise ValueError("target weights must be finite and not negative")
    if not targets.sum():
        targets = np.ones(len(targets))
    targets = targets / targets.sum()
    if budget is None:
        budget = float((natural[targets > 0] / targets[targets > 0]).max())
    fit = fit_rates(members, targets, budget, least)

    rate = F.when(F.col("n_tokens") > 0, fit.column("posteriors")).otherwise(1.0)
    return members.withColumn("rate", rate), model, fit


def report(spark: SparkSession, model: Classifier, fit: Rates) -> DataFrame:
    """domain, natural, target, reached, residual (shares of the tokens there are), converged: one row a domain."""
    rows = [(name, float(a), float(b), float(c), float(c - b), fit.converged) for name, a, b, c in zip(model.domains, fit.natural, fit.target, fit.fitted, strict=True)]
    return spark.createDataFrame(rows, "domain string, natural double, target double, reached double, residual double, converged boolean")


def quality_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, domain: language and labelled quality of the documents with a label."""
    by = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("label"))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    return some.join(by, "doc_id").select("doc_id", F.concat(F.coalesce("lang", F.lit("?")), F.when(F.col("label") == 1, "/good").otherwise("/poor")).alias("domain"))


def good_first(natural: dict[str, float]) -> dict[str, float]:
    """Weights of ``quality_domains``: square roots of the shares, so that small languages gain, and none for poor texts."""
    return {domain: 0.0 if domain.endswith("/poor") else share**0.5 for domain, share in natural.items()}


def resample(docs: DataFrame, rated: DataFrame) -> DataFrame:
    """docs repeated (or dropped) so that each row's expected number of copies is its doc_id's rate; the fraction is decided by hash.

    Rows without an id, and those whose id has no rate, stay as they are.
    """
    long = max(len(c) for c in docs.columns)
    of, n = "_of" + "_" * long, "_n" + "_" * long  # names that no column has
    by = rated.groupBy(F.col("doc_id").alias(of)).agg(F.max("rate").alias(n)).where(F.col(of).isNotNull())
    uniform = F.pmod(F.xxhash64(of, F.lit("copies")), F.lit(1 << 30)) / (1 << 30)
    copies = by.select(of, (F.floor(n) + (uniform < F.col(n) - F.floor(n)).cast("int")).cast("int").alias(n))
    every = docs.hint("merge").join(copies, docs["doc_id"].cast("long") == F.col(of), "left")
    return every.select(*[docs[f"`{c}`"] for c in docs.columns], F.explode(F.array_repeat(F.lit(0), F.coalesce(n, F.lit(1)))).alias(n)).drop(n)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rated, model, fit = mix(docs, quality_domains(docs, table(spark, sf_dir, "labels")), weights=good_first)
    best = F.array_position("posteriors", F.array_max("posteriors")).cast("int")
    of = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), best)
    return rated.select(
        "doc_id", "n_tokens", of(model.domains).alias("domain"), F.array_max("posteriors").alias("posterior"), "rate",
        of(fit.target.tolist()).alias("domain_target"), of(fit.fitted.tolist()).alias("domain_reached"), F.lit(fit.converged).alias("converged"),
    )
