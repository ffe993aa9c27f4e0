import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sitespec.llm.graph import components
from sitespec.llm.minmax_dedup import BANDS, ROWS, _promising_of, band_keys, intersections, near_duplicates, signature, without_near_duplicates
from sitespec.llm.shingles import PIECE, shingle_set, word_hashes

SCHEMA = "doc_id long, text string, component_id int, key string"


def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a < b and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i), find(i) == i) for i, s in sets))


def corpus():
    chance = random.Random(2)
    word = lambda: "".join(chance.choices("abcdefgh", k=4))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, "é É one"), (8, "É é one")]
    common = [word() for _ in range(60)]
    for group in range(6):
        base = [word() for _ in range(40 + 30 * group)]
        for k in range(25):
            text = list(base)
            for _ in range(chance.randrange(0, 2 + group)):
                text[chance.randrange(len(text))] = word()
            rows.append((100 + 40 * group + k, " ".join(text)))
    for k in range(40):  # a passage that many share
        rows.append((500 + k, " ".join(common + [word() for _ in range(k % 20)])))
    return rows


def test_shingles_by_pieces():
    text = "Aa bb\tcc " * (PIECE // 6) + "end"
    assert len(word_hashes(text)) == len(text.split())
    assert len(shingle_set(text)) == len(shingles(text))
    assert (word_hashes("x" * 5000 + " y")[1:] == word_hashes("y")).all()


def test_signature_and_sizes():
    values = np.sort(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    a, b = signature(values), signature(values[:2500])
    low, high = slice(0, BANDS // 2), slice(BANDS // 2, None)
    assert a.shape == (BANDS, ROWS) and (a[low] <= b[low]).all() and (a[high] >= b[high]).all()
    assert abs((a == b).mean() - 0.5) < 0.2 and len(set(band_keys(a).tolist())) == BANDS
    got = intersections([values[:100], values[50:150], values[120:130]], np.array([0]), np.array([1, 2]))
    assert got.tolist() == [[50, 0]]


def test_pairs_that_only_seem_to_have_met_are_compared():
    """Band 0 differs above the low byte alone, so its bucket was not shared; the pair meets in band 3 first."""
    one = np.random.default_rng(3).integers(0, 2**32, (BANDS, ROWS), dtype=np.uint32)
    other = one.copy()
    other[0, 2] ^= 1 << 20
    other[[1, 2], 0] ^= 1
    values = [one, other]

    def kept(band):
        return _promising_of(85)(pa.table({
            "key": [7, 7], "band": [band] * 2, "i": [0, 0], "j": [0, 0], "side": [0, 1], "id": [1, 2], "label": [1, 2], "n_shingles": [400, 400],
            "bands": [band_keys(v).tolist() for v in values], "sketch": [v.astype(np.uint8).tobytes() for v in values],
        })).num_rows

    assert kept(3) == 2 and kept(4) == 0


def test_same_as_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], SCHEMA).repartition(4)
    for percent in (85,):
        got = sorted(map(tuple, near_duplicates(docs, percent).collect()))
        assert got == brute(rows, percent)
    kept = without_near_duplicates(docs, 85)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in brute(rows, 85) if r[3]]


def test_odd_tables(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    text = "a b c d e f g"
    rows = [(None, text, 0, "k"), (3, text, 0, "k"), (3, text, 0, "k"), (9, text, 0, "k"), (9, "other words in here now ok", 0, "k")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (3, 3, True), (3, 3, True), (9, 3, False), (9, 9, True)]


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 900), (900, 1000), (5000, 5000)]
    got = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(201)] + [(900, 900), (1000, 900)]


@pytest.mark.parametrize("percent", [50, 79])
def test_percent_below_what_the_bands_carry(spark, percent):
    with pytest.raises(ValueError, match="miss too many"):
        near_duplicates(spark.createDataFrame([], SCHEMA), percent)
