"""Hard negatives: rows of other labels whose score lies in a window below that of an anchor's positives."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitespec.llm.common import materialize

#: Rows of a part and anchors of a part: a task holds one part of each at a time.
PART_ROWS, PART_ANCHORS = 8192, 2048
#: Rows that one inverted index covers, anchors that ask it together, and dimensions whose postings go together.
BLOCK_ROWS, BLOCK_ANCHORS, SLAB = 2048, 256, 16
#: Depths of a search between the highest possible score and the lowest one that still matters.
LEVELS = (0.9, 0.75, 0.5, 0.25, 0.0)
#: Components are multiplied by this and rounded down.
UNIT = 256
_NONE, _ALL = -(2**62), 2**62


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Whole components as float64; shorter vectors are filled with zeros."""
    sizes = np.asarray(pc.list_value_length(vectors), np.int64)
    flat = np.asarray(pc.list_flatten(vectors), np.float64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.floor(UNIT * flat)
    return out


def _widened(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def _rest_norms(matrix: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norm of what is left of each row from each cut on."""
    squares = np.cumsum(np.square(matrix)[:, ::-1], 1)[:, ::-1]
    return np.sqrt(np.column_stack([squares, np.zeros(len(matrix))])[:, cuts])


class InvertedIndex:
    """Postings of slabs of dimensions, the heaviest first: a row is listed in a slab only while what is left of it matters.

    Once the norm of the rest of a row, times that of the rest of any query, is below the lowest threshold, the row
    can't reach a threshold by the rest alone; its rest isn't listed and is looked up only for rows that survive.
    """

    def __init__(self, rows: np.ndarray):
        self.order = np.argsort(-np.square(rows).sum(0), kind="stable")
        self.rows = rows[:, self.order]
        self.cuts = [*range(0, rows.shape[1], SLAB), rows.shape[1]]
        self.norms = _rest_norms(self.rows, self.cuts)

    def reach(self, queries: np.ndarray) -> np.ndarray:
        """For each query, a bound of its scores."""
        return np.sqrt(np.square(queries).sum(1)) * self.norms[:, 0].max(initial=0) * (1 + 1e-9) + 1

    def search(self, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (query, row, score) with a score of at least the query's threshold."""
        queries = queries[:, self.order]
        norms = _rest_norms(queries, self.cuts)
        slack = 1 + 1e-9 * norms[:, 0].max(initial=0) * self.norms[:, 0].max(initial=0)
        floor = least - slack
        listed = self.norms[:, :-1] * norms[:, :-1].max(0, initial=0) >= floor.min(initial=0)
        depth = listed.sum(1)  # in how many slabs a row is listed
        rows = np.flatnonzero((depth > 0) | (floor.min(initial=0) <= 0))
        depth, sums = depth[rows], np.zeros((len(rows), len(queries)), self.rows.dtype)
        for number, (start, end) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            some = depth > number
            if not some.any():
                break
            if some.all():
                sums += self.rows[rows, start:end] @ queries[:, start:end].T
            else:
                sums[some] += self.rows[rows[some], start:end] @ queries[:, start:end].T
            # the rest of a row adds at most the product of the norms of both rests
            at = np.minimum(depth, number + 1)
            alive = (sums + self.norms[rows, at][:, None] * norms[:, number + 1] >= floor).any(1) if some.all() else (
                sums + self.norms[rows, at][:, None] * norms[:, at].T >= floor
            ).any(1)
            rows, depth, sums = rows[alive], depth[alive], sums[alive]
        for number, (start, end) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            late = depth <= number
            if late.any():
                sums[late] += self.rows[rows[late], start:end] @ queries[:, start:end].T
        place, found = np.nonzero(sums >= least)
        return found, rows[place], sums[place, found].astype(np.int64)


class Windows:
    """For each anchor some windows of scores, each with the best ``size`` rows found so far."""

    def __init__(self, low: np.ndarray, high: np.ndarray, size: int):
        self.low, self.high, self.size = low, high, size
        self.score = np.full((*low.shape, size), _NONE, np.int64)
        self.row = np.full((*low.shape, size), _ALL, np.int64)
        self.score[low > high] = _ALL  # no window: nothing can enter, and it counts as full

    def floor(self, anchors: np.ndarray) -> np.ndarray:
        """The least score that may still enter a window of the anchors."""
        return np.maximum(self.low[anchors], self.score[anchors, :, -1]).min(1)

    def full(self, anchors: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether all windows are full of rows with at least this score."""
        return (self.score[anchors, :, -1] >= least[:, None]).all(1)

    def add(self, anchors: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        for k in range(self.low.shape[1]):
            good = (scores <= self.high[anchors, k]) & (scores >= self.low[anchors, k]) & (scores >= self.score[anchors, k, -1])
            if not good.any():
                continue
            touched, of = np.unique(anchors[good], return_inverse=True)
            of = np.concatenate([of, np.repeat(np.arange(len(touched)), self.size)])
            score = np.concatenate([scores[good], self.score[touched, k].ravel()])
            row = np.concatenate([rows[good], self.row[touched, k].ravel()])
            order = np.lexsort((row, -score, of))
            first = np.searchsorted(of[order], np.arange(len(touched)))
            taken = order[first[:, None] + np.arange(self.size)]
            self.score[touched, k], self.row[touched, k] = score[taken], row[taken]


def fill_windows(
    rows: np.ndarray, ids: np.ndarray, labels: np.ndarray,
    anchors: np.ndarray, own: np.ndarray, of: np.ndarray, same: bool, windows: Windows,
) -> None:
    """Fill the anchors' windows from the rows of their own label or of the others, best scores and smallest ids first.

    Block by block, each anchor starts with a high threshold, which is lowered until its windows are full or no
    lower score can enter. What earlier blocks have found raises the lowest threshold.
    """
    by_label = np.argsort(of, kind="stable")  # anchors of a label ask together: they tend to look alike
    groups = np.split(by_label, np.flatnonzero(np.diff(of[by_label])) + 1) if same else [by_label]
    for group in groups:
        mine = np.flatnonzero(labels == of[group[0]]) if same and len(group) else np.arange(len(rows))
        for start in range(0, len(mine), BLOCK_ROWS):
            part = mine[start : start + BLOCK_ROWS]
            index = InvertedIndex(rows[part])
            for first in range(0, len(group), BLOCK_ANCHORS):
                asking = group[first : first + BLOCK_ANCHORS]
                _fill(index, ids[part], labels[part], anchors, own, of, same, windows, asking)


def _fill(
    index: InvertedIndex, ids: np.ndarray, labels: np.ndarray,
    anchors: np.ndarray, own: np.ndarray, of: np.ndarray, same: bool, windows: Windows, asking: np.ndarray,
) -> None:
    reach = index.reach(anchors[asking])
    top = np.minimum(reach, windows.high[asking].max(1))
    floor = np.maximum(windows.floor(asking), -reach)
    before = np.full(len(asking), np.inf)
    active = np.flatnonzero(floor <= top)
    for level in LEVELS:
        if not len(active):
            break
        least = floor[active] + level * (top - floor)[active]
        found, row, score = index.search(anchors[asking[active]], least)
        anchor = asking[active[found]]
        good = ((labels[row] == of[anchor]) == same) & (ids[row] != own[anchor]) & (score < before[active[found]])
        windows.add(anchor[good], ids[row[good]], score[good])
        before[active] = least
        active = active[~windows.full(asking[active], least)]


def _exact(rows: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both of one width, as doubles where all products are whole in them, else as 64-bit numbers."""
    width = max(rows.shape[1], anchors.shape[1])
    rows, anchors = _widened(rows, width), _widened(anchors, width)
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(anchors).max(initial=0)) * max(width, 1)
    if most >= 2**62:
        raise ValueError("components are too large for scores of 64 bits")
    return (rows, anchors) if most < 2**52 else (rows.astype(np.int64), anchors.astype(np.int64))


def _part(percent: int, score: np.ndarray, up: bool) -> np.ndarray:
    """percent / 100 of whole scores, rounded up or down, without overflow."""
    sign = -1 if up else 1
    return sign * (sign * score // 100 * percent + sign * score % 100 * percent // 100)


def _search(rows: pa.Table, anchors: pa.Table, size: int, same: bool, low: int, high: int) -> pa.Table:
    schema = pa.schema([("anchor", pa.int64()), ("positive", pa.int64()), ("positive_score", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    if not len(rows) or not len(anchors):
        return schema.empty_table()
    row_values, anchor_values = _exact(*(_matrix(c.combine_chunks()) for c in (rows["vector"], anchors["query"])))
    positives = anchors["positives"].to_pylist()
    most = max(len(p) for p in positives)
    scores = np.zeros((len(positives), most), np.int64)
    there = np.zeros(scores.shape, bool)
    for i, found in enumerate(positives):
        scores[i, : len(found)] = [p["score"] or 0 for p in found]
        there[i, : len(found)] = True
    least, greatest = (np.full(scores.shape, x) for x in (_NONE, _ALL)) if same else (_part(low, scores, True), _part(high, scores, False))
    windows = Windows(np.where(there, least, _ALL), np.where(there, greatest, _NONE), size)
    ids, labels, own, of = (c.to_numpy() for c in (rows["vec_id"], rows["label"], anchors["own"], anchors["of"]))
    fill_windows(row_values, ids, labels, anchor_values, own, of, same, windows)
    anchor, window, place = np.nonzero((windows.row != _ALL) & (windows.score != _ALL))
    columns = [
        anchors["anchor"].to_numpy()[anchor], [positives[a][w]["vec_id"] for a, w in zip(anchor, window, strict=True)],
        scores[anchor, window], windows.row[anchor, window, place], windows.score[anchor, window, place],
    ]
    return pa.table([pa.array(c, pa.int64()) for c in columns], schema=schema)


def _best(rows: DataFrame, anchors: DataFrame, parts: tuple[int, int], size: int, same: bool, low: int = 0, high: int = 0) -> DataFrame:
    """The best rows of every window: each part of the rows meets each part of the anchors in one task."""
    left = rows.withColumn("anchor_part", F.explode(F.sequence(F.lit(0), F.lit(parts[1] - 1))))
    right = anchors.withColumn("row_part", F.explode(F.sequence(F.lit(0), F.lit(parts[0] - 1))))
    key = ["row_part", "anchor_part"]
    found = (
        left.groupBy(*key).cogroup(right.groupBy(*key))
        .applyInArrow(
            lambda a, b: _search(a, b, size, same, low, high),
            "anchor long, positive long, positive_score long, vec_id long, score long",
        )
    )
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)  # tasks cut theirs before the shuffle


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors`` (vec_id, embedding, label).

    A score is the inner product of two vectors whose components are multiplied by 256 and rounded down, exact in
    whole numbers. An anchor's positives are its best rows of the same label; for each, the best rows of other
    labels whose score is between ``low`` and ``high`` percent of the positive's. Ties go to the smaller vec_id.
    Every part of the rows is searched for every part of the anchors by a threshold join over an inverted index
    that leaves out what norms cover; parts are of a fixed size and dealt by row number, so copies don't gather.

    Rows with a NULL vec_id, label or vector, or a NULL or non-finite component, take no part. Missing components
    of shorter and empty vectors count as 0. Rows with the anchor's own vec_id are neither its positives nor its
    negatives; other repeated rows each take a place, and a repeated anchor has its rows repeated. Anchors without
    positives, and positives without negatives, give no row, nor does an empty table; other columns go. Components
    so large that a score could leave 62 bits are refused with an error.
    """
    value = F.col("embedding").cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"),
        F.col("embedding").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), finite.alias("_finite"),
    ).filter("vec_id IS NOT NULL AND label IS NOT NULL AND _finite").drop("_finite")
    usable = materialize(usable.withColumn("row", F.monotonically_increasing_id()), "vectors")  # written: numbers stay
    counts = usable.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("m")).first()
    parts = (max(1, -(-counts.n // PART_ROWS)), max(1, -(-counts.m // PART_ANCHORS)))

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

    rows = usable.select("vec_id", "label", "vector", dealt(parts[0]).alias("row_part"))
    # names of their own: both sides of a cogroup come from one table
    named = {"row": "anchor", "vec_id": "own", "label": "of", "vector": "query"}
    anchors = usable.filter("is_anchor").select(
        *(F.col(c).alias(name) for c, name in named.items()), dealt(parts[1]).alias("anchor_part")
    )
    pair = "array<struct<vec_id:bigint,score:bigint>>"
    asked = anchors.withColumn("positives", F.array(F.struct(F.lit(None), F.lit(None))).cast(pair))
    near = _best(rows, asked, parts, positives, same=True)
    found = near.groupBy("anchor").agg(F.collect_list(F.struct("vec_id", "score")).cast(pair).alias("positives"))
    asked = materialize(anchors.join(found, "anchor"), "positives")
    far = _best(rows, asked, parts, negatives, same=False, low=low, high=high)
    return far.join(asked.select("anchor", F.col("own").alias("anchor_id")), "anchor").select(
        "anchor_id", F.col("positive").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
