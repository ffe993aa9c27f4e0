"""Language ID by a byte convolutional network: filters of several widths, max pooling and softmax, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitespec.llm.common import release_memory

#: Bytes of a window; texts are cut into windows from end to end.
WINDOW = 256
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 12, 8
#: Bound of the training sample: so many labelled documents, chosen by a hash of their id, with so many windows each.
SAMPLE_DOCS, SAMPLE_WINDOWS = 4000, 2
STEPS, BATCH, RATE = 350, 64, 0.01
UNDETERMINED = "und"
_PART = 96


@dataclass
class Network:
    """Byte embedding, filters by width (width * embedding, filters), and the output layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    output: np.ndarray
    offset: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.output, self.offset]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _step(net: Network, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Gradients of the cross entropy of a batch."""
    n, size = windows.shape
    emb = net.embedding[windows]
    pooled, kept = [], []
    for width, w, b in zip(WIDTHS, net.filters, net.biases, strict=True):
        columns = np.concatenate([emb[:, k : size - width + 1 + k] for k in range(width)], axis=2)
        act = columns @ w + b
        best = act.argmax(axis=1)
        top = np.take_along_axis(act, best[:, None], axis=1)[:, 0]
        pooled.append(np.maximum(top, 0))
        kept.append((columns, best, top > 0))
    features = np.concatenate(pooled, axis=1)
    out = _softmax(features @ net.output + net.offset)
    out[np.arange(n), labels] -= 1
    out /= n
    d_features = out @ net.output.T
    d_embedding = np.zeros_like(net.embedding)
    d_filters, d_biases = [], []
    rows = np.arange(n)[:, None]
    for i, (width, w) in enumerate(zip(WIDTHS, net.filters, strict=True)):
        columns, best, live = kept[i]
        d = d_features[:, i * FILTERS : (i + 1) * FILTERS] * live
        picked = columns[rows, best]  # n, filters, width * embedding
        d_filters.append(np.einsum("nf,nfc->cf", d, picked))
        d_biases.append(d.sum(axis=0))
        back = (d[:, :, None] * w.T[None]).reshape(n, FILTERS, width, EMBEDDING)
        for k in range(width):
            np.add.at(d_embedding, windows[rows, best + k], back[:, :, k])
    return [d_embedding, *d_filters, *d_biases, features.T @ out, out.sum(axis=0)]


def train(windows: np.ndarray, labels: list[str], steps: int = STEPS, seed: int = 11) -> Network:
    """Fit the network by Adam on labelled windows (n, WINDOW) of bytes."""
    languages = sorted(set(labels))
    random = np.random.default_rng(seed)
    scale = lambda *shape: (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    net = Network(
        languages, (random.standard_normal((256, EMBEDDING)) * 0.5).astype(np.float32),
        [scale(w * EMBEDDING, FILTERS) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        scale(len(WIDTHS) * FILTERS, len(languages)), np.zeros(len(languages), np.float32),
    )
    number = np.array([languages.index(x) for x in labels], np.int64)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    for t in range(1, steps + 1):
        pick = random.integers(0, len(number), BATCH)
        for p, g, m, v in zip(net.parameters(), _step(net, windows[pick], number[pick]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * min(1, 2 - 2 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
    return net


class Predictor:
    """The trained network with its filters as tables over pairs of bytes: two look-ups a place instead of products."""

    def __init__(self, net: Network):
        self.net = net
        tables = [np.einsum("be,kef->kbf", net.embedding, w.reshape(width, EMBEDDING, FILTERS)) for width, w in zip(WIDTHS, net.filters, strict=True)]
        none = np.zeros((256, FILTERS), np.float32)
        at = lambda i, k: tables[i][k] if k < WIDTHS[i] else none
        pair = lambda k: np.concatenate([(at(i, k)[:, None] + at(i, k + 1)[None]).reshape(65536, FILTERS) for i in range(len(WIDTHS))], axis=1)
        self.low = pair(0) + np.concatenate(net.biases)
        self.high = pair(2)

    def windows(self, windows: np.ndarray) -> np.ndarray:
        """Posteriors of windows (n, WINDOW)."""
        out = []
        for a in range(0, len(windows), _PART):
            part = windows[a : a + _PART].astype(np.int32)
            pairs = part[:, :-1] << 8 | part[:, 1:]
            act = self.low.take(pairs[:, :-2], axis=0)
            act += self.high.take(pairs[:, 2:], axis=0)
            out.append(_softmax(np.maximum(act.max(axis=1), 0) @ self.net.output + self.net.offset))
        return np.concatenate(out) if out else np.empty((0, len(self.net.languages)), np.float32)

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text: the mean posterior of its windows, weighted by their bytes."""
        cut, sizes = [], []
        for text in texts:
            data = text.encode("utf-8", "surrogatepass") if text and any(map(str.isalpha, text)) else b""
            sizes.append(len(data))
            cut.append(as_windows(data))
        posteriors = self.windows(np.concatenate(cut)) if cut else np.empty((0, 1))
        out, at = [], 0
        for windows, size in zip(cut, sizes, strict=True):
            if not size:
                out.append((UNDETERMINED, 0.0))
                continue
            n = len(windows)
            weights = np.full(n, WINDOW)
            weights[-1] = size - (n - 1) * WINDOW
            mean = (weights / size) @ posteriors[at : at + n]
            at += n
            best = int(mean.argmax())
            out.append((self.net.languages[best], float(min(1.0, mean[best]))))
        return out


def as_windows(data: bytes) -> np.ndarray:
    """The bytes in rows of WINDOW, the last one filled with zeros."""
    n = -(-len(data) // WINDOW)
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn_languages(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Network | None:
    """Train on at most ``sample_docs`` labelled documents (doc_id, text, lang) outside the held-out part.

    The sample is bounded: documents in the order of a hash of their id, windows at hashed places of the whole
    text. None where no document is labelled.
    """
    usable = docs.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    chosen = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    place = lambda k: F.pmod(F.xxhash64("doc_id", k), F.greatest(F.length("text") - WINDOW + 1, F.lit(1))) + 1
    windows = F.transform(F.sequence(F.lit(1), F.lit(SAMPLE_WINDOWS)), lambda k: F.substring(F.col("text"), place(k), F.lit(WINDOW)))
    # At most sample_docs ids: a broadcast of a known size.
    rows = usable.join(F.broadcast(chosen), "doc_id").select("doc_id", "lang", windows.alias("windows")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["windows"]))
    texts = [(w, r["lang"]) for r in rows for w in r["windows"] if any(map(str.isalpha, w))]
    if not texts:
        return None
    data = [w.encode("utf-8", "surrogatepass")[:WINDOW].ljust(WINDOW, b"\0") for w, _ in texts]
    return train(np.frombuffer(b"".join(data), np.uint8).reshape(-1, WINDOW), [lang for _, lang in texts])


def language_of(text: Column, net: Network | None) -> Column:
    """struct(lang string, score double) of a whole text; ``und`` and 0 where it is NULL or has no letter.

    Without a network (nothing was labelled) every text is ``und``.
    """
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    made: list[Predictor] = []  # the tables are made once a task, not for each of its batches

    def predict(texts: pa.Array) -> pa.Array:
        if net and not made:
            made.append(Predictor(net))
        predictor = made[0] if made else None
        out = []
        for low in range(0, len(texts), 256):
            part = texts.slice(low, 256).to_pylist()
            out += predictor.texts(part) if predictor else [(UNDETERMINED, 0.0)] * len(part)
        release_memory()
        return pa.array([{"lang": a, "score": b} for a, b in out], kind)

    return F.arrow_udf(predict, "struct<lang:string,score:double>")(text)


def identify_languages(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of ``docs`` (doc_id, text, lang): trained on the labelled part, applied to all.

    Predictions look at texts alone. Repeated rows and NULL ids stay; other columns are not looked at; an empty
    table gives no rows.
    """
    found = language_of(F.col("text"), learn_languages(docs, sample_docs))
    rows = docs.select("doc_id", held_out().alias("held_out"), found.alias("_found"))
    return rows.select("doc_id", "held_out", F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"))
