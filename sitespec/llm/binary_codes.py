"""Near-duplicate embeddings by randomised-rotation binary codes with correction factors.

A unit vector is rotated at random into more dimensions and kept as signs, with one number: the inner product
between the signs (as a unit vector) and the rotated vector. Divided by that number, the inner product of the signs
with any other rotated vector is an unbiased estimate of the cosine, with a known spread; only pairs whose
confidence bound reaches the threshold are computed in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitespec.llm.common import materialize
from sitespec.llm.graph import components

#: Chance that a pair just at the threshold shares no bucket; pairs above it are missed less often.
MISS = 0.005
#: Standard deviations of the estimate by which a pair may fall short and still be computed in full.
DEVIATIONS = 4.0
BLOCK = 128
FIELDS = "id long, mult long, keys binary, code binary, factor float, vector binary"


def layout(n: int, least: float) -> tuple[int, int]:
    """Bits of a key and number of keys for ``n`` distinct vectors: buckets of a few, whatever ``n``, at chance ``MISS``."""
    bits = max(6, math.ceil(math.log2(max(n, 2))) - 3)
    agree = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-agree))


@lru_cache(maxsize=4)
def rotation(size: int, wanted: int) -> np.ndarray:
    """Random orthogonal matrices below each other, scaled to keep lengths: at least ``wanted`` rows."""
    random = np.random.default_rng(size)
    parts = max(1, math.ceil(wanted / size))
    return np.concatenate([np.linalg.qr(random.standard_normal((size, size)))[0] for _ in range(parts)]) / math.sqrt(parts)


def as_vector(value: list | None) -> np.ndarray | None:
    """The vector in double precision; None where it is null, empty, zero or holds null or non-finite components."""
    if not value:
        return None
    vector = np.array(value, np.float64)
    return vector + 0.0 if np.isfinite(vector).all() and vector.any() else None


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that lengths neither over- nor underflow."""
    vectors = vectors / np.abs(vectors).max(axis=-1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=-1, keepdims=True)


def encode(vector: np.ndarray, bits: int, tables: int) -> tuple[bytes, bytes, float]:
    """Bucket keys (4 bytes each), packed signs, and the correction factor."""
    turned = rotation(len(vector), bits * tables) @ unit(vector)
    signs = turned > 0
    factor = np.abs(turned).sum() / math.sqrt(len(turned))
    keys = signs[: bits * tables].reshape(tables, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))
    return keys.astype("<u4").tobytes(), np.packbits(signs).tobytes(), float(factor)


def _named(vectors: DataFrame) -> DataFrame:
    """(vec_id, name, vector): doubles as bytes, and 128 bits of hash of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [as_vector(v.as_py()) for v in batch.column(1)]
            data = [None if v is None else v.tobytes() for v in found]
            names = [None if d is None else xxhash.xxh3_128_digest(d) for d in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array(data, pa.binary())], ["vec_id", "name", "vector"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, name binary, vector binary")


def _coded(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [encode(np.frombuffer(v, np.float64), bits, tables) for v in batch.column("vector").to_pylist()]
            keys, codes, factors = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("mult"), pa.array(keys, pa.binary()), pa.array(codes, pa.binary()), pa.array(factors, pa.float32()), batch.column("vector")],
                ["id", "mult", "keys", "code", "factor", "vector"],
            )

    return classes.select("id", "mult", "vector").mapInArrow(run, FIELDS)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of either side, and which pairs are this group's: no earlier bucket in common, each pair once."""
    side, ids = table.column("side").to_numpy(), table.column("id").to_numpy()
    keys = np.array([np.frombuffer(k, "<u4") for k in table.column("keys").to_pylist()])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    earlier = keys[:, : table.column("t")[0].as_py()]
    pairs = ~(earlier[left][:, None] == earlier[right]).any(axis=2) if earlier.shape[1] else np.ones((len(left), len(right)), bool)
    if table.column("i")[0].as_py() == table.column("j")[0].as_py():
        pairs &= ids[left][:, None] < ids[right]
    return left, right, pairs


def _promising_of(least: float):
    """The members of a group's pairs whose confidence bound reaches ``least``."""

    def run(table: pa.Table) -> pa.Table:
        left, right, pairs = _sides(table)
        keep = np.zeros(table.num_rows, bool)
        if pairs.any():
            vectors = np.array([np.frombuffer(table.column("vector")[int(k)].as_py(), np.float64) for k in left])
            codes = np.array([np.frombuffer(table.column("code")[int(k)].as_py(), np.uint8) for k in right])
            factors = table.column("factor").to_numpy()[right].astype(np.float64)
            turn = rotation(vectors.shape[1], codes.shape[1] * 8 - 7)
            signs = np.unpackbits(codes, axis=1, count=len(turn)).astype(np.float32) * 2 - 1
            turned = (unit(vectors) @ turn.T).astype(np.float32)
            estimate = (turned @ signs.T) / math.sqrt(len(turn)) / factors
            bound = DEVIATIONS * np.sqrt(np.maximum(0, 1 - factors**2)) / factors / math.sqrt(max(1, len(turn) - 1))
            pairs &= estimate + bound >= least
            keep[left], keep[right] = pairs.any(axis=1), pairs.any(axis=0)
        return table.select(["t", "key", "i", "j", "side", "id"]).filter(pa.array(keep))

    return run


def _links_of(least: float):
    """Number of links of each member by exact cosines, and as few links as hold the linked ones together."""

    def run(table: pa.Table) -> pa.Table:
        left, right, pairs = _sides(table)
        ids, mult = table.column("id").to_numpy(), table.column("mult").to_numpy()
        a, b, n = [], [], []
        if pairs.any():
            vectors = unit(np.array([np.frombuffer(v, np.float64) for v in table.column("vector").to_pylist()]))
            linked = pairs & (vectors[left] @ vectors[right].T >= least)
            for rows, counts in ((left, linked @ mult[right]), (right, linked.T @ mult[left])):
                some = counts > 0
                a += ids[rows][some].tolist()
                n += counts[some].tolist()
            b = [None] * len(a)
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            for i, j in zip(*np.nonzero(linked), strict=True):
                x, y = int(ids[left[i]]), int(ids[right[j]])
                if find(x) != find(y):
                    root[find(x)] = find(y)
                    a.append(x)
                    b.append(y)
                    n.append(None)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def near_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of ``vectors`` (vec_id long, embedding array), one row per row.

    Vectors with cosine >= ``least`` in double precision are linked; ``n_links`` counts the other vectors linked
    directly, ``component_id`` is the smallest vec_id reachable, ``kept`` says that it is the vector's own. Null,
    empty or zero vectors and those with null or non-finite components link with nothing; neither do vectors of
    different lengths. Rows without vec_id get NULL component_id, no links, and are kept. Other columns are not
    looked at; vec_id is taken as unique.

    How: equal vectors are one class with a multiplicity. A class is put in a bucket by each of several groups of
    bits of its code; as many groups as make a pair just at the threshold meet with chance 1 - ``MISS``, of as
    many bits as keep buckets of unrelated vectors small. Buckets are compared block against block, each pair
    once, in the first bucket that it shares: first one side's codes with the other side's rotated vectors, then
    exact cosines for the members of pairs within the bound. Links are counted where they are found, and only
    those that hold the members together are emitted.
    """
    named = materialize(_named(vectors), "vectors")
    real = named.filter("name is not null and vec_id is not null")
    classes = real.groupBy("name").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("mult"))
    classes = materialize(classes, "classes")
    holders = classes.join(real.select(F.col("vec_id").alias("id"), "name", "vector"), ["name", "id"])
    bits, tables = layout(classes.count(), least)
    coded = materialize(_coded(holders, bits, tables), "codes")
    key = [F.xxhash64(F.length("vector"), F.lit(t), F.substring("keys", 4 * t + 1, 4)) for t in range(tables)]
    banded = coded.select("id", F.posexplode(F.array(*key)).alias("t", "key"))
    sizes = banded.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = banded.join(sizes, ["t", "key"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = materialize(members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "members")
    left = members.select("t", "key", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"), "id")
    right = members.select("t", "key", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "id")
    with_codes = left.join(coded.select("id", "keys", "vector", F.lit(None).cast("binary").alias("code"), F.lit(0.0).cast("float").alias("factor")), "id")
    with_codes = with_codes.unionByName(right.join(coded.select("id", "keys", F.lit(None).cast("binary").alias("vector"), "code", "factor"), "id"))
    group = ["t", "key", "i", "j"]
    schema = "t int, key long, i int, j int, side int, id long"
    promising = materialize(with_codes.groupBy(*group).applyInArrow(_promising_of(least), schema), "promising")
    exact = promising.join(coded.select("id", "mult", "keys", "vector"), "id")
    found = materialize(exact.groupBy(*group).applyInArrow(_links_of(least), "a long, b long, n long"), "links")
    counts = found.filter("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    merged = components(found.filter("b is not null").select("a", "b"))
    facts = classes.join(counts, "id", "left").join(merged, "id", "left").filter("mult > 1 or n is not null")
    facts = facts.select("name", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = named.select("vec_id", "name").join(facts, "name", "left")
    known = F.col("vec_id").isNotNull()
    component = F.when(known, F.coalesce("component_id", "vec_id"))
    return out.select(
        "vec_id",
        F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
