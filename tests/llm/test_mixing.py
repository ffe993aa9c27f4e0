import numpy as np
from pyspark.sql import functions as F

from sitespec.llm.mixing import copies, domains_of, fit_classifier, fit_rates, mixed_documents, mixing_rates

SCHEMA = "doc_id long, text string, lang string, rate int, domain string"


def projected(tokens, posterior, target, lower, steps=20_000):
    """Plain projected gradient, small steps, all in one place."""
    a = tokens[:, None] * posterior
    r = np.full(len(a), max(1.0, lower))
    size = 1 / np.linalg.norm(a.T @ a, 2)
    for _ in range(steps):
        r = np.maximum(lower, r - size * (a @ (a.T @ r - target)))
    return a.T @ r


def test_rates_meet_the_targets(spark):
    random = np.random.default_rng(1)
    tokens, posterior = random.integers(0, 500, 300), random.dirichlet([0.3] * 3, 300)
    rows = spark.createDataFrame([(int(t), p.tolist()) for t, p in zip(tokens, posterior, strict=True)], "tokens long, posterior array<double>")
    for weights, lower in (([0.5, 0.3, 0.2], 0.0), ([0.9, 0.09, 0.01], 0.0), ([0.4, 0.3, 0.3], 1.0)):
        rate, report = fit_rates(rows, np.array(weights), lower)
        found = np.array([r.r for r in rows.select(rate.alias("r")).collect()])
        sums = found * tokens @ posterior
        target = np.array(report["target"])
        assert found.min() >= lower and np.allclose(sums, report["reached"], rtol=1e-6)
        best = projected(tokens.astype(float), posterior, target, lower)
        assert np.abs(sums - target).sum() <= np.abs(best - target).sum() + 0.02 * target.sum()


def test_classifier_learns_words():
    texts = ["good words here now"] * 30 + ["clown scum words here"] * 30
    model = fit_classifier(texts, ["a"] * 30 + ["b"] * 30)
    from sitespec.llm.mixing import features

    assert model.posterior(*features("scum of a clown")[1:]).argmax() == 1
    assert model.posterior(*features("good one")[1:]).argmax() == 0
    assert np.isclose(model.posterior(*features(None)[1:]).sum(), 1)


def test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labelled = domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rates, report = mixing_rates(docs, labelled, {"q1t0": 0.7, "q0t0": 0.3})
    assert rates.count() == docs.count() and report["domains"] == sorted(report["domains"])
    assert rates.filter("rate < 0 or rate is null or p_domain > 1").count() == 0
    rows = [(1, None, "x", 0, "d"), (1, None, "x", 0, "d"), (None, "a b", "x", 0, "d"), (3, "w " * 50_000, "x", 0, "d"), (4, "", "x", 0, "d")]
    odd = spark.createDataFrame(rows, SCHEMA)
    got = mixed_documents(odd, labelled, {"q1t0": 1.0}, lower=1.0)
    assert got.columns == odd.columns and {r.doc_id for r in got.collect()} == {1, None, 3, 4}
    assert mixed_documents(odd.limit(0), labelled, {}).collect() == []
    none = mixing_rates(odd, labelled.limit(0), {})[0].collect()
    assert len(none) == 5 and all(r.domain == "all" and abs(r.rate - 1) < 1e-9 for r in none)


def test_copies_keep_the_rate(spark):
    rows = spark.range(20_000).select("id", copies(F.lit(1.3), "id").alias("n"))
    assert 1.28 < rows.agg(F.avg("n")).first()[0] < 1.32
