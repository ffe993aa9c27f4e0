"""Mixing documents to target weights when a document belongs to several domains by degrees.

A classifier learned from a table of labels says with which probability a document belongs to each domain. Rates
of the documents (how often each is used) are then fitted so that the expected tokens of each domain, rate times
tokens times probability summed over all documents, meet the targets: nonnegative least squares by projected
gradient steps. The unknowns are as many as the documents, but a step depends on all of them through one sum per
domain only; so each step is one aggregation, and a document's rate follows from its own row and the few vectors
of the steps so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitespec.llm.common import materialize
from sitespec.llm.shingles import mixed, word_hashes

#: Hashed words of the classifier, and figures of a text beside them.
HASHED, FIGURES = 1 << 16, 6
#: Bound of the training sample: so many labelled documents, chosen by a hash of their id.
SAMPLE_DOCS = 8000
EPOCHS, RATE, DECAY = 6, 0.4, 1e-5
#: Largest number of domains: sums and the matrix of a step have this many entries a side.
MOST_DOMAINS = 64
STEPS, CLOSE, GAIN, SMALLEST = 24, 1e-4, 0.02, 0.01


@dataclass
class Classifier:
    """Logistic regression over hashed words and figures: softmax(sum of the rows + figures @ dense)."""

    domains: list[str]
    words: np.ndarray
    dense: np.ndarray

    def posterior(self, words: np.ndarray, figures: np.ndarray) -> np.ndarray:
        x = figures @ self.dense
        if len(words):
            x = x + self.words[words].sum(axis=0) / np.sqrt(len(words))
        x = np.exp(x - x.max())
        return x / x.sum()


def features(text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    """Tokens (words between white space), distinct hashed words, and figures of a whole text."""
    hashes = word_hashes(text)
    n = len(hashes)
    distinct = np.unique((mixed(hashes) >> np.uint64(48)).astype(np.int32))
    codes = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    size = max(1, len(codes))
    counts = np.bincount(codes, minlength=256)
    signs = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    figures = [1, len(distinct) / max(1, n), signs / size * 5, counts[48:58].sum() / size * 5, counts[65:91].sum() / size * 5, np.log1p(n) / 8]
    return n, distinct, np.array(figures, np.float32)


def fit_classifier(texts: list[str | None], labels: list[str], epochs: int = EPOCHS, seed: int = 5) -> Classifier:
    """Stochastic gradient descent with per-weight rates over labelled texts."""
    domains = sorted(set(labels))
    if len(domains) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    rows = [features(t)[1:] for t in texts]
    number = [domains.index(x) for x in labels]
    model = Classifier(domains, np.zeros((HASHED, len(domains)), np.float32), np.zeros((FIGURES, len(domains)), np.float32))
    seen_words, seen_dense = np.full_like(model.words, 1e-3), np.full_like(model.dense, 1e-3)
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            words, figures = rows[i]
            g = model.posterior(words, figures)
            g[number[i]] -= 1
            if len(words):
                step = g / np.sqrt(len(words)) + DECAY * model.words[words]
                seen_words[words] += step**2
                model.words[words] -= RATE * step / np.sqrt(seen_words[words])
            step = figures[:, None] * g
            seen_dense += step**2
            model.dense -= RATE * step / np.sqrt(seen_dense)
    return model


def learn_domains(texts: DataFrame, domains: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Classifier:
    """Train on at most ``sample_docs`` documents of ``texts`` (doc_id, text) with a row in ``domains`` (doc_id, domain).

    The bound is a documented parameter; the documents are the first in the order of a hash of their id. Rows
    without id or domain are left out; without any row left, there is one domain, ``all``. Ids are matched before
    any text is read, so no text is shuffled.
    """
    usable = domains.filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    usable = usable.join(texts.select("doc_id"), "doc_id", "left_semi")
    # At most sample_docs rows: a broadcast of a known size.
    chosen = F.broadcast(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))
    rows = texts.select("doc_id", "text").join(chosen, "doc_id").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["domain"], r["text"] or ""))
    if not rows:
        return Classifier(["all"], np.zeros((HASHED, 1), np.float32), np.zeros((FIGURES, 1), np.float32))
    return fit_classifier([r["text"] for r in rows], [r["domain"] for r in rows])


def membership(text: Column, model: Classifier) -> Column:
    """struct(tokens long, posterior array<double>) of a whole text, in the order of ``model.domains``."""
    kind = pa.struct([("tokens", pa.int64()), ("posterior", pa.list_(pa.float64()))])

    def run(texts: pa.Array) -> pa.Array:
        tokens, rows = [], []
        for value in texts:
            n, words, figures = features(value.as_py())
            tokens.append(n)
            rows.append(model.posterior(words, figures).astype(np.float64))
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * len(model.domains)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.empty(0)))
        return pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), lists], fields=list(kind))

    return F.arrow_udf(run, "struct<tokens:bigint,posterior:array<double>>")(text)


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, tokens, posterior) of ``docs`` (doc_id, text); the narrow table that the fit goes over."""
    found = docs.select("doc_id", membership(F.col("text"), model).alias("_m"))
    return found.select("doc_id", "_m.tokens", "_m.posterior")


def _rate(steps: list[np.ndarray], lower: float) -> Column:
    """A document's rate after ``steps``, from 1: each takes tokens * (posterior . step) off, never below ``lower``."""
    rate = F.lit(max(1.0, lower))
    for step in steps:
        along = F.lit(0.0)
        for i, x in enumerate(step):
            along = along + F.get("posterior", F.lit(i)) * F.lit(float(x))
        rate = F.greatest(F.lit(float(lower)), rate - F.col("tokens") * along)
    return rate


def _sums(members: DataFrame, rate: Column, k: int, lower: float) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of the domains at a rate, and the second moments of the rows above the lower bound."""
    rows = members.select(rate.alias("r"), "tokens", *(F.get("posterior", F.lit(i)).alias(f"p{i}") for i in range(k)))
    square = F.when(F.col("r") > lower, F.col("tokens") * F.col("tokens").cast("double")).otherwise(0.0)
    row = rows.agg(
        *(F.sum(F.col("r") * F.col("tokens") * F.col(f"p{i}")).alias(f"s{i}") for i in range(k)),
        *(F.sum(square * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)),
    ).first()
    gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    return np.array([row[f"s{i}"] or 0.0 for i in range(k)]), gram


def fit_rates(members: DataFrame, weights: np.ndarray, lower: float = 0.0, budget: float | None = None) -> tuple[Column, dict]:
    """The rate of each row of ``members`` (tokens, posterior), and a report of the fit.

    Targets are ``weights`` (normalised) times ``budget`` tokens; without a budget, all tokens there are, or, with
    a lower bound above 0, as many as let every domain reach its share without going below that bound. Each step
    takes the gradient of the squared distance in the metric of the second moments of the rows above the bound,
    and projects. A step that doesn't bring the targets nearer is taken back and shortened. Ends when the distance
    is below ``CLOSE`` of the budget, or no step brings it nearer by more than ``GAIN`` of itself.
    """
    k = len(weights)
    steps: list[np.ndarray] = []
    sums, gram = _sums(members, F.lit(max(1.0, lower)), k, -1.0)
    have = sums / max(1.0, lower)
    weights = np.asarray(weights, float) / np.sum(weights)
    if budget is None:
        positive = weights > 0
        budget = float(have.sum()) if lower <= 0 else float(np.max(lower * have[positive] / weights[positive], initial=have.sum()))
    target = weights * budget
    apart = float(np.abs(sums - target).sum())
    size, tries = 1.0, 0
    while apart > CLOSE * max(budget, 1) and size > SMALLEST and tries < STEPS:
        tries += 1
        # The metric: second moments of the rows that can still move either way.
        step = size * np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ (sums - target)
        now, moments = _sums(members, _rate([*steps, step], lower), k, lower)
        distance = float(np.abs(now - target).sum())
        if distance < apart * (1 - GAIN):
            steps, sums, gram, apart, size = [*steps, step], now, moments, distance, min(1.0, 2 * size)
        else:
            size /= 4
    report = {"target": target.tolist(), "reached": sums.tolist(), "before": have.tolist(), "steps": len(steps), "tries": tries}
    return _rate(steps, lower), report


def _fit(
    docs: DataFrame, domains: DataFrame, weights: dict[str, float], lower: float, budget: float | None,
    sample_docs: int, texts: DataFrame | None,
) -> tuple[Classifier, DataFrame, Column, dict]:
    model = learn_domains(docs if texts is None else texts, domains, sample_docs)
    wanted = np.array([float(weights.get(d, 0.0)) for d in model.domains])
    if not wanted.sum():
        wanted[:] = 1.0
    members = materialize(memberships(docs, model), "memberships")
    rate, report = fit_rates(members, wanted, lower, budget)
    return model, members, rate, report | {"domains": model.domains}


def mixing_rates(
    docs: DataFrame, domains: DataFrame, weights: dict[str, float], lower: float = 0.0,
    budget: float | None = None, sample_docs: int = SAMPLE_DOCS, texts: DataFrame | None = None,
) -> tuple[DataFrame, dict]:
    """((doc_id, tokens, domain, p_domain, rate), report) of ``docs`` (doc_id, text).

    ``domains`` (doc_id, domain) labels some documents of ``texts`` (by default ``docs``), from which the
    classifier is learned; ``weights`` are shares by domain, 0 where a domain is not named (if none of the learned
    domains is named, all are equal). ``domain`` is the likeliest one. NULL and empty texts have no tokens and keep
    the rate 1 (or the lower bound, if that is more). Rows stay as they are, repeated ones and NULL ids included;
    other columns are not looked at.
    """
    model, members, rate, report = _fit(docs, domains, weights, lower, budget, sample_docs, texts)
    best = F.array_max("posterior")
    names = F.array(*(F.lit(d) for d in model.domains))
    out = members.select(
        "doc_id", "tokens", F.get(names, F.array_position("posterior", best) - 1).alias("domain"), best.alias("p_domain"), rate.alias("rate")
    )
    return out, report


def copies(rate: Column, *key: Column | str) -> Column:
    """Whole uses of a row at a rate: the rate rounded down, and one more with the chance of the rest, by a hash of ``key``."""
    chance = F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixed_documents(docs: DataFrame, domains: DataFrame, weights: dict[str, float], lower: float = 0.0) -> DataFrame:
    """``docs`` with each row as often as its rate says; the columns stay. See ``mixing_rates``.

    A row's rate follows from its own text and the few numbers of the fit, so it is computed in place: no text is
    shuffled. The part of a rate beyond a whole number is drawn by a hash of doc_id.
    """
    model, _, rate, _ = _fit(docs, domains, weights, lower, None, SAMPLE_DOCS, None)
    # Names of their own, so that columns of docs with the fit's names are left alone.
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), membership(F.col("text"), model).alias("m"))
    uses = kept.select("row", F.col("m.tokens").alias("tokens"), F.col("m.posterior").alias("posterior"))
    uses = uses.select("row", copies(rate, "row.doc_id").alias("n")).filter("n > 0")
    return uses.select("row", F.explode(F.sequence(F.lit(1), "n"))).select("row.*")


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of ``labels``, with quality and toxicity as the domain (``q1t0`` and so on)."""
    return labels.filter("quality is not null and toxic is not null").select(
        "doc_id", F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("domain")
    )
