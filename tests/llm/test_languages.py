import zlib

import numpy as np
import pytest

from sitespec.llm.byte_cnn import WINDOW, WIDTHS, Predictor, _step, as_windows, identify_languages, learn_languages, train
from sitespec.llm import byte_cnn

SCHEMA = "doc_id long, text string, lang string, held_out int, score string"


@pytest.fixture(scope="module")
def net(spark, sf_dir):
    return learn_languages(spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet"))


def test_held_out_accuracy(spark, sf_dir, net):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").collect()
    out = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    found = Predictor(net).texts([d.text for d in out])
    assert np.mean([f[0] == d.lang for f, d in zip(found, out, strict=True)]) > 0.95


def test_tables_are_the_convolution(net):
    windows = as_windows("Ein kurzer Text, äöü. ".encode() * 40)
    emb, features = net.embedding[windows], []
    for width, w, b in zip(WIDTHS, net.filters, net.biases, strict=True):
        # the last places of a window count where all widths fit
        columns = np.concatenate([emb[:, k : WINDOW - 3 + k] for k in range(width)], axis=2)
        features.append(np.maximum((columns @ w + b).max(axis=1), 0))
    x = np.concatenate(features, axis=1) @ net.output + net.offset
    x = np.exp(x - x.max(axis=1, keepdims=True))
    assert np.allclose(Predictor(net).windows(windows), x / x.sum(axis=1, keepdims=True), atol=1e-4)


def test_gradients():
    random = np.random.default_rng(0)
    windows = random.integers(0, 256, (5, WINDOW)).astype(np.uint8)
    net = train(windows, ["a", "b", "a", "b", "b"], steps=1)
    for p in net.parameters():
        p[...] = p.astype(np.float32)
    number = np.array([0, 1, 0, 1, 1])

    def loss():
        features = []
        for width, w, b in zip(WIDTHS, net.filters, net.biases, strict=True):
            columns = np.concatenate([net.embedding[windows][:, k : WINDOW - width + 1 + k] for k in range(width)], axis=2)
            features.append(np.maximum((columns @ w + b).max(axis=1), 0))
        x = (np.concatenate(features, axis=1) @ net.output + net.offset).astype(np.float64)
        x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
        return -x[np.arange(5), number].mean()

    for p, g in zip(net.parameters(), _step(net, windows, number), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[at], 1e-2
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 0.15 * abs(g[at]) + 1e-4


def test_odd_texts(spark, net, monkeypatch):
    monkeypatch.setattr(byte_cnn, "STEPS", 20)
    texts = [None, "", "123 !?", "The and of the", "the " * 100_000, "é"]
    rows = [(k, t, "en" if k % 2 else None, 0, "s") for k, t in enumerate(texts)] + [(None, "la mer", "fr", 0, "s"), (3, "The and of the", "en", 0, "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in identify_languages(docs).collect()}
    assert {(k, "und", 0.0) for k in range(3)} <= got and len(got) == 7
    assert all(0 <= s <= 1 and lang in ("en", "fr", "und") for _, lang, s in got)
    assert identify_languages(docs.limit(0)).collect() == []
    unlabelled = identify_languages(docs.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_labels_are_no_inputs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(byte_cnn.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, identify_languages(d).collect())) for d in (docs, other))
    assert a == b
