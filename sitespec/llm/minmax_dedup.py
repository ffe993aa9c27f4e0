"""Near-duplicate documents by min-max hashing: one hash evaluation gives a minimum and a maximum to band."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitespec.llm.common import materialize, release_memory
from sitespec.llm.graph import components
from sitespec.llm.id_filter import IdBits
from sitespec.llm.shingles import WIDTH, mixed, shingle_set

#: Permutations; each keeps its smallest and its largest value, so a signature has twice as many values.
PERMUTATIONS = 60
#: Values of a band. With 24 bands of 5, a pair of similarity 0.85 shares a band but for a chance below 1e-6.
ROWS = 5
BANDS = 2 * PERMUTATIONS // ROWS
#: Documents of a block that are compared with those of another block at a time.
BLOCK = 64
#: Pairs whose signatures agree this many standard deviations less than linked ones would are not compared in full.
DEVIATIONS = 5.0
#: The chance to share no band that a pair at the threshold may have at most (7.3e-5 at 0.80, 7.7e-7 at 0.85).
MISS = 1e-4
_RANDOM = np.random.default_rng(97)
_A = _RANDOM.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_B = _RANDOM.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_WEIGHTS = _RANDOM.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK, _COLUMNS = 2048, 1 << 14


def signature(shingles: np.ndarray) -> np.ndarray:
    """Bands by rows: minima of all permutations, then maxima. ``shingles`` must not be empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(PERMUTATIONS, 2**32 - 1, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    for at in range(0, len(x), _CHUNK):
        h = x[at : at + _CHUNK, None] * _A + _B
        np.minimum(low, h.min(axis=0), out=low)
        np.maximum(high, h.max(axis=0), out=high)
    return np.concatenate([low, high]).reshape(BANDS, ROWS)


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key a band; equal bands at different places have different keys."""
    keys = (values.astype(np.uint64) * _WEIGHTS).sum(axis=1, dtype=np.uint64)
    return mixed(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _arrays(docs: DataFrame, schema: str, make) -> DataFrame:
    """Rows that ``make`` gives for the ids and texts of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):  # sets of many long texts must not meet in one array
                part = batch.slice(low, 256)
                yield make(part.column(0), part.column(1))
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, sketch) of ``docs`` (doc_id, text).

    ``set_key`` names the shingle set (128 bits of its hash), ``bands`` are the band keys, ``sketch`` the lowest
    byte of each signature value. Without words there is no set: 0, and NULLs.
    """
    import xxhash

    def make(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        counts, names, bands, sketches = [], [], [], []
        for text in texts:
            found = shingle_set(text.as_py(), width)
            counts.append(len(found))
            if len(found):
                values = signature(found)
                names.append(xxhash.xxh3_128_digest(found.tobytes()))
                bands.append(band_keys(values))
                sketches.append(values.astype(np.uint8).tobytes())
            else:
                names.append(None)
                bands.append(None)
                sketches.append(None)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(counts, pa.int64()), pa.array(names, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
            ["doc_id", "n_shingles", "set_key", "bands", "sketch"],
        )

    return _arrays(docs, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary", make)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def make(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        sets = [shingle_set(t.as_py(), width).tobytes() for t in texts]
        return pa.RecordBatch.from_arrays([ids, pa.array(sets, pa.binary())], ["id", "shingles"])

    return _arrays(docs, "id long, shingles binary", make)


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered ``left`` with those numbered ``right``."""
    values = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    number = np.cumsum(np.diff(values, prepend=values[:1]) != 0)
    shared = np.bincount(number)[number] > 1
    number, owners = number[shared], owners[shared]
    number = np.cumsum(np.diff(number, prepend=number[:1]) != 0)
    out = np.zeros((len(left), len(right)), np.float64)
    for low in range(0, (number[-1] + 1) if len(number) else 0, _COLUMNS):
        a, b = np.searchsorted(number, [low, low + _COLUMNS])
        held = np.zeros((len(sets), min(_COLUMNS, int(number[-1]) + 1 - low)), np.float32)
        held[owners[a:b], number[a:b] - low] = 1
        out += held[left] @ held[right].T
    return out.round().astype(np.int64)


def _links_of(percent: int):
    """For a group with two sides: links between them that join different labels, as few as needed for that."""

    def compare(table: pa.Table) -> pa.Table:
        ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
        side = table.column("side").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            sizes = np.array([len(s) for s in sets])
            inter = intersections(sets, left, right)
            union = sizes[left][:, None] + sizes[right] - inter
            linked = (100 * inter >= percent * union) & (labels[left][:, None] != labels[right])
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            for i, j in zip(*np.nonzero(linked), strict=True):
                a, b = find(int(labels[left[i]])), find(int(labels[right[j]]))
                if a != b:
                    root[a] = b
                    out.append((int(ids[left[i]]), int(ids[right[j]])))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return compare


def _promising_of(percent: int):
    """For a group with two sides: the members of pairs whose sketches agree enough, and share no earlier bucket."""
    values = BANDS * ROWS
    p = percent / 100
    least = p * values - DEVIATIONS * (p * (1 - p) * values) ** 0.5

    def compare(table: pa.Table) -> pa.Table:
        ids, labels, side, sizes = (table.column(c).to_numpy() for c in ("id", "label", "side", "n_shingles"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, BANDS, ROWS)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        keep = np.zeros(len(ids), bool)
        if len(left) and len(right):
            band = table.column("band")[0].as_py()
            bands = np.array(table.column("bands").to_pylist())[:, :band]
            same = sketch[left][:, None] == sketch[right]
            ratio = np.minimum(sizes[left][:, None], sizes[right]) * 100 >= percent * np.maximum(sizes[left][:, None], sizes[right])
            pairs = (same.sum(axis=(2, 3)) >= least) & ratio & (labels[left][:, None] != labels[right])
            # Whole keys decide: sketches may agree in a band whose values differ, and then the pair never met there.
            pairs &= ~(bands[left][:, None] == bands[right]).any(axis=2)
            keep[left], keep[right] = pairs.any(axis=1), pairs.any(axis=0)
        return table.select(["key", "i", "j", "side", "id", "label"]).filter(pa.array(keep))

    return compare


def _blocks(counted, ids, block: int):
    """A block number below ``ceil(counted / block)`` by the hash of the id."""
    return F.pmod(F.xxhash64(ids), F.ceil(counted / F.lit(block))).cast("int")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (doc_id, text) of ``docs`` with one of the ids (distinct); of the others next to none is shuffled."""
    return IdBits(ids).held(docs.select("doc_id", "text"), "doc_id").join(ids, "doc_id", "left_semi")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of ``docs`` (doc_id long, text), one row per row.

    Documents are linked where 100 * intersection >= percent * union of their sets of ``width``-word shingles;
    ``component_id`` is the smallest doc_id reachable and ``kept`` says that it is the document's own. Texts
    without words (NULL, empty, white space) link with nothing. Rows without doc_id get NULL component_id and
    are kept. doc_id is taken as unique: rows that share one get a row each, by the class of their own text.
    Other columns are not looked at.

    How: equal sets are one class, held by its smallest id. Class holders are banded by min-max signatures. In
    each bucket, every member is compared in full with the smallest one (the leader); what that links is one
    component, so a large group of near copies costs one comparison per copy and band at most. What is left,
    pairs of non-leaders in different components, is compared block against block: first the sketches, with the
    size ratio, then the full sets of those that may still be linked. No pair is left out for the size of its
    bucket, no bucket meets in one task, and only links that join components are emitted. Raises ValueError for a ``percent``
    at which a pair shares no band with a chance above ``MISS``.
    """
    if (1 - (percent / 100) ** ROWS) ** BANDS > MISS:
        raise ValueError(f"{BANDS} bands of {ROWS} values would miss too many pairs at {percent} percent")
    prints = materialize(fingerprints(docs, width), "fingerprints")
    real = prints.filter("set_key is not null and doc_id is not null")
    classes = real.groupBy("set_key").agg(F.min("doc_id").alias("holder"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes, "classes")
    holders = real.join(classes.select("set_key", F.col("holder").alias("doc_id")), ["set_key", "doc_id"], "left_semi")
    holders = holders.dropDuplicates(["set_key", "doc_id"])
    banded = holders.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).filter("leader < last")
    members = materialize(banded.join(buckets.drop("last"), "key"), "members")
    sets = materialize(_sets(_only(docs, members.select(F.col("id").alias("doc_id")).distinct()), width), "sets")

    def compared(groups: DataFrame, keys: list[str]) -> DataFrame:
        rows = groups.join(sets, "id")
        return rows.groupBy(*keys).applyInArrow(_links_of(percent), "a long, b long")

    # Leaders against the members of their buckets.
    pairs = members.filter("id <> leader").select("leader", "id").distinct()
    many = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.join(many, "leader").select("leader", "id", _blocks(F.col("n"), F.col("id"), BLOCK).alias("chunk"))
    pairs = materialize(pairs, "pairs")
    leaders = pairs.select("leader", "chunk").distinct().select("leader", "chunk", F.col("leader").alias("id"), F.lit(0).alias("side"))
    star = leaders.unionByName(pairs.select("leader", "chunk", "id", F.lit(1).alias("side")))
    first = materialize(compared(star.withColumn("label", F.col("id")), ["leader", "chunk"]), "links")

    # What is still apart within a bucket.
    found = materialize(components(first), "components")
    labelled = members.join(found, "id", "left").withColumn("label", F.coalesce("component_id", "id"))
    lead = found.select(F.col("id").alias("leader"), F.col("component_id").alias("_lead"))
    labelled = labelled.join(lead, "leader", "left").withColumn("other", F.col("label") != F.coalesce("_lead", "leader"))
    labelled = labelled.filter("id <> leader").select("key", "band", "id", "label", "other")
    counts = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("n_all"), F.count_if("other").alias("n_other"))
    counts = counts.filter("n_other > 0 and n_all > 1")
    open_rows = materialize(labelled.join(counts, "key").join(
        holders.select(F.col("doc_id").alias("id"), "n_shingles", "bands", "sketch"), "id"), "open")
    other_blocks = F.sequence(F.lit(0), F.ceil(F.col("n_other") / BLOCK).cast("int") - 1)
    all_blocks = F.sequence(F.lit(0), F.ceil(F.col("n_all") / BLOCK).cast("int") - 1)
    columns = ["key", "band", "i", "j", "side", "id", "label", "n_shingles", "bands", "sketch"]
    left = open_rows.filter("other").withColumn("i", _blocks(F.col("n_other"), F.col("id"), BLOCK))
    left = left.withColumn("j", F.explode(all_blocks)).withColumn("side", F.lit(0)).select(columns)
    right = open_rows.withColumn("j", _blocks(F.col("n_all"), F.col("id"), BLOCK))
    right = right.withColumn("i", F.explode(other_blocks)).withColumn("side", F.lit(1)).select(columns)
    schema = "key long, i int, j int, side int, id long, label long"
    promising = left.unionByName(right).groupBy("key", "i", "j").applyInArrow(_promising_of(percent), schema)
    promising = materialize(promising, "promising")
    second = materialize(compared(promising, ["key", "i", "j"]), "links")

    merged = materialize(components(first.unionByName(second)), "components")
    named = classes.join(merged, classes["holder"] == merged["id"], "left")
    named = named.filter("n > 1 or component_id is not null").select("set_key", F.coalesce("component_id", "holder").alias("component_id"))
    out = prints.join(named, "set_key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), kept.alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 85, width: int = WIDTH) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; all columns stay.

    Of rows that share a doc_id, all stay or go.
    """
    gone = materialize(near_duplicates(docs, percent, width).filter("not kept").select("doc_id").distinct(), "gone")
    bits = IdBits(gone)
    # Only rows that the bit set holds are shuffled; it holds none without doc_id.
    rest = bits.held(docs, "doc_id").join(gone, "doc_id", "left_anti").select(*docs.columns)
    return bits.others(docs, "doc_id").unionByName(rest)
