import numpy as np

from sitespec.llm.binary_codes import as_vector, encode, layout, near_vectors, rotation, unit

SCHEMA = "vec_id long, embedding array<float>, name string, label int"


def brute(rows, least=0.9):
    data = {i: as_vector(v) for i, v in rows}
    ids = sorted(data)
    links = {
        i: [j for j in ids if j != i and data[i] is not None and data[j] is not None and len(data[i]) == len(data[j])
            and unit(data[i]) @ unit(data[j]) >= least]
        for i in ids
    }
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (i, len(links[i]), min(seen), min(seen) == i)
    return [out[i] for i in ids]


def vectors():
    random = np.random.default_rng(4)
    rows = []
    for group in range(12):
        base = random.standard_normal(64)
        for k in range(18):
            rows.append((base + random.standard_normal(64) * (0.05 * (k % 8))).astype(np.float32).tolist())
    rows += [rows[0]] * 30 + [[2 * x for x in rows[0]]]
    rows += [None, [], [0.0] * 64, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [1e-30] * 64, [1.0] * 64, [1.0] * 32, [3.0] * 32]
    return list(enumerate(rows))


def test_same_as_all_pairs(spark):
    rows = vectors()
    got = near_vectors(spark.createDataFrame([(i, v, "n", 1) for i, v in rows], SCHEMA).repartition(3)).collect()
    want = brute(rows)
    got = sorted(map(tuple, got))
    links, found = sum(r[1] for r in want), sum(r[1] for r in got)
    assert 0.99 * links <= found <= links
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.95 * len(want)


def test_empty_and_missing_ids(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    one = [(None, [1.0, 2.0], "n", 1), (5, [1.0, 2.0], "n", 1), (4, [1.0, 2.0], "n", 1)]
    got = near_vectors(spark.createDataFrame(one, SCHEMA)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, 0, None, True), (4, 1, 4, True), (5, 1, 4, False)]))


def test_estimates_are_unbiased_and_within_the_bound():
    random = np.random.default_rng(9)
    bits, tables = layout(10_000, 0.9)
    turn = rotation(64, bits * tables)
    assert np.allclose(turn.T @ turn, np.eye(64))
    errors = []
    for _ in range(400):
        a, b = random.standard_normal(64), random.standard_normal(64)
        b = unit(a) + 0.5 * unit(b)
        keys, code, factor = encode(b, bits, tables)
        signs = np.unpackbits(np.frombuffer(code, np.uint8), count=len(turn)) * 2.0 - 1
        estimate = (turn @ unit(a)) @ signs / np.sqrt(len(turn)) / factor
        bound = np.sqrt(1 - factor**2) / factor / np.sqrt(len(turn) - 1)
        errors.append((estimate - unit(a) @ unit(b)) / bound)
        assert len(keys) == 4 * tables
    assert abs(np.mean(errors)) < 0.25 and np.abs(errors).max() < 5


def test_buckets_follow_the_size():
    for n in (10, 10_000, 10**9):
        bits, tables = layout(n, 0.9)
        agree = (1 - np.arccos(0.9) / np.pi) ** bits
        assert (1 - agree) ** tables <= 0.005 and n / 2**bits < 20
