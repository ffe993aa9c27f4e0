import hashlib
import math
import re
import struct

import xxhash

from sitespec.llm.imatch import LEAST_IDF, MOST_IDF, WIDTHS, fingerprints

SCHEMA = "doc_id long, text string, n_chars int, term string, key_id int"


def h(data, seed=42):
    value = xxhash.xxh64_intdigest(data, seed)
    return value - 2**64 if value >= 2**63 else value


def chain(values, seed=42):
    for v in values:
        seed = h(struct.pack("<q", v), seed & (2**64 - 1))
    return seed


def terms(text):
    return {h(w.encode()) for w in re.findall(r"[^\W_]+", text.lower())}


def brute(texts):
    n, counts = len(texts), {}
    for text in texts:
        for t in terms(text):
            counts[t] = counts.get(t, 0) + 1
    band = {t for t, c in counts.items() if n * 2**-MOST_IDF <= c <= n * 2**-LEAST_IDF}

    def kept(text):
        out = []
        for s, width in enumerate(WIDTHS):
            inside = sorted(t for t in terms(text) & band if h(struct.pack("<i", s), h(struct.pack("<q", t)) & (2**64 - 1)) % width == 0)
            out.append(f"{chain(inside) & (2**64 - 1):016x}" if inside else "")
        return "-".join(out) if any(out) else f"text:{h(text.encode()) & (2**64 - 1):x}"

    return kept


def likeness(a, b):
    pairs = list(zip(a.split("-"), b.split("-"), strict=False))
    some = [p for p in pairs if p[0] or p[1]] if len(a.split("-")) == len(b.split("-")) else [("", "x")]
    return 1.0 if a == b else sum(x == y for x, y in some) / max(1, len(some))


def test_same_as_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(120).collect()
    rows = sorted((d.doc_id, d.text) for d in docs)
    rows[3], rows[8], rows[20] = (rows[3][0], None), (rows[8][0], ""), (rows[20][0], rows[21][1])
    frame = spark.createDataFrame([(i, t, 0, "t", 1) for i, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: r for r in fingerprints(frame).collect()}
    texts = [t or "" for _, t in rows]
    kept = brute(texts)
    for k, (doc_id, _) in enumerate(rows):
        text, following = texts[k], texts[(k + 1) % len(texts)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (kept(text), kept(edited))
        if len(r.fingerprint.split("-")) == len(r.edited_fingerprint.split("-")) > 1:
            assert math.isclose(r.near_edited, likeness(r.fingerprint, r.edited_fingerprint))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert got[rows[20][0]].fingerprint == got[rows[21][0]].fingerprint and got[rows[20][0]].near_next == 1.0
    near = [r for r in got.values() if r.n_chars > 200]
    assert sum(r.near_edited for r in near) > 5 * sum(r.near_next for r in near if r.near_next < 1)


def test_odd_tables(spark):
    assert fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    one = fingerprints(spark.createDataFrame([(1, "ab cd", 0, "t", 1)], SCHEMA)).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"ab ca").hexdigest()
    rows = [(None, "x", 0, "t", 1), (2, "y", 0, "t", 1), (2, "y", 0, "t", 1), (2, "z", 0, "t", 1)]
    got = fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["2", "2", "2", "None"]


def test_no_python_in_the_plan(spark, sf_dir):
    plan = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
