import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitespec.llm.hard_negatives import BLOCK_ROWS, InvertedIndex, Windows, fill_windows, mine_hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, row string, anchor int, rank int"


def brute(rows, anchor, n_pos=5, n_neg=3, low=50, high=95):
    kept = [
        (i, [math.floor(256 * x) for x in e], label) for i, e, label in rows
        if None not in (i, e, label) and all(x is not None and math.isfinite(x) for x in e)
    ]
    out = []
    for i, e, label in kept:
        if not anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(e, f)), j, other == label) for j, f, other in kept if j != i]
        for p, j, _ in sorted(s for s in scored if s[2])[:n_pos]:
            fits = sorted((s, k) for s, k, same in scored if not same and -low * p <= -100 * s <= -high * p)
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(fits[:n_neg], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in mine_hard_negatives(frame, F.col("vec_id") % 10 == 0, **options).collect())


def test_index_finds_all_above_the_threshold():
    rng = np.random.default_rng(1)
    for scale in (1, 3):
        rows = np.floor(256 * rng.normal(size=(700, 37)) * np.exp(-np.arange(37) / (4 * scale)))
        queries = rows[::90] + np.floor(20 * rng.normal(size=(8, 37)))
        scores = queries @ rows.T
        for level in (-1e9, 0, 0.2, 0.5, 0.9):
            least = scores.max(1) * level if level >= 0 else np.full(8, level)
            q, r, s = InvertedIndex(rows).search(queries, least)
            want = np.argwhere(scores >= least[:, None])
            assert sorted(zip(q.tolist(), r.tolist())) == [tuple(x) for x in want.tolist()]
            assert (scores[q, r] == s).all()


def test_index_leaves_out_what_norms_cover():
    rows = np.zeros((10, 64))
    rows[:, :8], rows[:, 8:] = 100, 1
    index = InvertedIndex(rows)
    index.rows[:, 8:] = np.nan  # touched only if a row's rest is looked up
    assert len(index.search(np.full((1, 64), 10.0), np.array([20_000]))[0]) == 0


def test_windows_over_many_blocks():
    rng = np.random.default_rng(2)
    n = 2 * BLOCK_ROWS + 77
    rows = np.floor(30 * rng.normal(size=(n, 12)))
    ids, labels = rng.permutation(n), rng.integers(0, 3, n)
    anchors, own, of = rows[:20], ids[:20], labels[:20]
    scores = (anchors @ rows.T).astype(np.int64)
    high = np.column_stack([scores.max(1) // 2, scores.max(1) // 3, np.full(20, -5)])
    low = np.column_stack([scores.max(1) // 4, scores.max(1) // 3 - 1, np.full(20, 0)])
    windows = Windows(low, high, 3)
    fill_windows(rows, ids, labels, anchors, own, of, False, windows)
    for a in range(20):
        for k in range(2):
            fits = sorted((-s, i) for s, i, g in zip(scores[a], ids, labels) if g != of[a] and low[a, k] <= s <= high[a, k])[:3]
            got = [(-s, i) for s, i in zip(windows.score[a, k], windows.row[a, k]) if i != 2**62]
            assert got == fits


def test_same_as_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 9))
    rows = [(i, (base[i % 6] * rng.uniform(0.3, 1) + 0.1 * rng.normal(size=9)).tolist(), int(rng.integers(3))) for i in range(240)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(30)] + [(1100 + i, rows[3][1], 1) for i in range(8)]  # ties
    rows += [(5, None, 1), (None, [1.0], 1), (7, [1.0] * 9, None), (2000, [None] * 9, 1), (2010, [math.nan] * 9, 1), (2020, [math.inf] * 9, 0)]
    rows += [(2030, [], 1), (2040, [0.5], 2), (2050, [1.0] * 12, 0), (2060, [0.0] * 9, 1), (-10, [-0.3] * 9, 2)]
    rows += [(11, rows[11][1], rows[11][2]), (13, rows[3][1], 2)]  # repeated rows and ids
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 10 == 0) and len(got) > 150
    few = mined(spark, rows, positives=2, negatives=1, low=10, high=99)
    assert few == brute(rows, lambda i: i % 10 == 0, 2, 1, 10, 99)


def test_large_components_and_empty_tables(spark):
    rows = [(i, [1e6 + i, 1e5 * i, 1.0], i % 2) for i in range(40)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    assert mined(spark, []) == [] and mined(spark, rows[:1]) == [] and mined(spark, rows[1:5]) == []
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(i, [1e9 * 256], i % 2) for i in range(11)])
