"""Source divergence audit: how the sources of each language differ in their words, in exact whole numbers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitespec.llm.common import materialize

#: Letters in lower case and all bytes beyond ASCII stay; every other byte becomes a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text that are split at a time, up to the next space.
SLICE = 1 << 20
#: Terms that a task adds up before it hands the counts on; a text's own terms may come on top.
TERMS = 100_000
#: Sources of a block: a task compares one block with another in a matrix of this side.
SIDE = 256
#: Tasks that share the terms of two blocks, so that a language with a third of all text isn't one task.
SALTS = 16
#: Least documents of a language that hold a kept term, the smoothing of counts, and the unit of rates.
LEAST_DOCS, SMOOTHING, UNIT = 30, 5, 1_000_000_000
TOP = 50

_COUNTED = "lang string, source string, term string, n long, docs long"


def term_counts(text: bytes) -> Counter:
    """Terms of one document with their occurrences; long texts are split slice by slice."""
    blank = text.translate(TABLE)
    if len(blank) <= SLICE:
        return Counter(blank.split())
    counts: Counter = Counter()
    at = 0
    while at < len(blank):
        end = blank.find(b" ", at + SLICE)
        end = len(blank) if end < 0 else end
        counts.update(blank[at:end].split())
        at = end
    return counts


def _rows(counts: dict, docs: dict) -> pa.RecordBatch:
    keys = list(counts)
    columns = [pa.array([k[i] for k in keys], pa.binary()).cast(pa.string()) for i in range(2)]
    terms = pa.array([k[2] for k in keys], pa.binary()).cast(pa.string())
    values = [pa.array([t[k] for k in keys], pa.int64()) for t in (counts, docs)]
    return pa.RecordBatch.from_arrays([*columns, terms, *values], ["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n, docs) added up over runs of documents; a NULL term marks a group that occurs."""
    counts: dict = {}
    docs: dict = {}
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).cast(pa.binary()).to_pylist() for i in range(3)), strict=True):
            group = (lang, source)
            mark = (*group, None)
            counts[mark] = counts.get(mark, 0) + 1
            docs[mark] = docs.get(mark, 0) + 1
            for term, n in term_counts(text).items():
                key = (*group, term)
                counts[key] = counts.get(key, 0) + n
                docs[key] = docs.get(key, 0) + 1
            if len(counts) >= TERMS:
                yield _rows(counts, docs)
                counts, docs = {}, {}
    if counts:
        yield _rows(counts, docs)


def _rate(count: str, total: str = "total", terms: str = "terms") -> Column:
    """1 + floor(UNIT * (count + SMOOTHING) / (total + SMOOTHING * terms)), in decimals that hold any count; 0 without terms."""
    above = f"CAST({UNIT} AS DECIMAL(10,0)) * CAST({count} + {SMOOTHING} AS DECIMAL(19,0))"
    below = f"CAST({total} + {SMOOTHING} * {terms} AS DECIMAL(19,0))"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + ({above}) DIV ({below}) ELSE 0L END")


class _Blocks:
    """Distances between the sources of two blocks, added up over the terms of one run of rows."""

    def __init__(self, lang: str, left: list[dict], right: list[dict], terms: int, same: bool):
        self.lang, self.same = lang, same
        self.names = [np.array([e["source"] for e in side], object) for side in (left, right)]
        self.absent = [np.array([e["rate"] for e in side], np.int64) for side in (left, right)]
        self.apart = np.abs(self.absent[0][:, None] - self.absent[1])
        self.sums = self.apart * terms
        self.rows: list[list[tuple[int, int, int]]] = []

    def add(self, entries: list[dict], left: int, right: int) -> None:
        self.rows.append([(e["place"] % SIDE, e["rate"], e["place"] // SIDE) for e in entries])
        if len(self.rows) >= 1024:
            self.flush(left, right)

    def flush(self, left: int, right: int) -> None:
        """Rates of a run of terms as two matrices, absent ones filled in; the sums counted these terms as absent from all."""
        if not self.rows:
            return
        sides = [np.tile(absent, (len(self.rows), 1)) for absent in self.absent]
        for number, block in ((0, left), (1, right)):
            for row, entries in enumerate(self.rows):
                for place, rate, of in entries:
                    if of == block:
                        sides[number][row, place] = rate
        for i in range(sides[0].shape[1]):
            self.sums[i] += np.abs(sides[0][:, i : i + 1] - sides[1]).sum(0)
        self.sums -= self.apart * len(self.rows)
        self.rows = []

    def out(self) -> Iterator[pa.RecordBatch]:
        ways = [(self.names, self.sums)] if self.same else [(self.names, self.sums), (self.names[::-1], self.sums.T)]
        for (sources, items), sums in ways:
            for source, line in zip(sources, sums, strict=True):
                other = items != source
                columns = [[self.lang] * int(other.sum()), [source] * int(other.sum()), items[other], line[other]]
                types = (pa.string(), pa.string(), pa.string(), pa.int64())
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "item", "value"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of (head, terms ...) of one language, two blocks and one salt to the sums of their pairs of sources."""
    blocks, key = None, (0, 0)
    for batch in batches:
        for row in batch.to_pylist():
            if row["terms"] is None:
                blocks.add(row["entries"], *key)
                continue
            if blocks:
                blocks.flush(*key)
                yield from blocks.out()
            key = (row["left_block"], row["right_block"])
            blocks = _Blocks(row["lang"], row["left"], row["right"], row["terms"], key[0] == key[1])
    if blocks:
        blocks.flush(*key)
        yield from blocks.out()


def _pairs(rates: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language, in both directions.

    Sources are numbered and cut into blocks of ``SIDE``; a term goes to the pairs of blocks that hold one of its
    sources, spread over ``SALTS`` tasks, and each task keeps one matrix of two blocks at a time. Terms that no
    source of the two blocks holds differ by the rates of absent terms alone, which the head of a run accounts for.
    """
    block = F.floor(F.col("place") / SIDE).cast("int")
    absent = groups.select("lang", "terms", block.alias("block"), F.struct("place", "source", _rate("0L").alias("rate")).alias("e"))
    lists = absent.groupBy("lang", "terms", "block").agg(F.array_sort(F.collect_list("e")).alias("side"))
    heads = (
        lists.select("lang", "terms", F.col("block").alias("left_block"), F.col("side").alias("left"))
        .join(lists.select("lang", F.col("block").alias("right_block"), F.col("side").alias("right")), "lang")
        .filter("left_block <= right_block")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        .withColumn("terms", F.when(F.col("salt") == 0, F.col("terms")).otherwise(F.lit(0).cast("long")))
    )
    present = F.array_distinct(F.transform("entries", lambda e: F.floor(e["place"] / SIDE).cast("int")))
    with_any = F.transform(
        present,
        lambda b: F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda x: F.struct(F.least(b, x).alias("left_block"), F.greatest(b, x).alias("right_block")),
        ),
    )
    of_two = F.filter("entries", lambda e: F.floor(e["place"] / SIDE).isin(F.col("at.left_block"), F.col("at.right_block")))
    terms = (
        rates.groupBy("lang", "blocks", "term").agg(F.collect_list(F.struct("place", "rate")).alias("entries"))
        .withColumn("at", F.explode(F.array_distinct(F.flatten(with_any))))
        .select("lang", "at.*", of_two.alias("entries"), F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int").alias("salt"))
    )
    key = ["lang", "left_block", "right_block", "salt"]
    runs = heads.unionByName(terms, allowMissingColumns=True).repartition(*key)
    runs = runs.sortWithinPartitions(*key, F.col("terms").isNull())
    parts = runs.mapInArrow(_compare, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of ``docs`` (text, lang, source).

    Part ``pair``: the distance of a source to each other source of its language, over all terms that at least
    ``least_docs`` documents of the language hold. Part ``term``: the terms that a source uses more than its
    language does, the ``top`` ones. Each document is cut into terms by one byte table and counted by itself; tasks
    add the counts up before they are shuffled, so a source with a third of all documents leaves a row per task
    and term. NULL text, lang and source are read as empty; empty texts hold no term, and their groups still have
    pairs (value 0 where the language keeps no term). Repeated rows count each time, ties rank by the bytes of
    the item, other columns go, and an empty table gives no row.
    """
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    parts = docs.select(*columns).mapInArrow(_count, _COUNTED)
    counts = materialize(
        parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts"
    )
    words = counts.filter("term IS NOT NULL")
    kept = words.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = kept.filter(F.col("docs") >= least_docs).drop("docs")
    found = materialize(words.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept")

    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    sums = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = Window.partitionBy("lang")
    places = (F.row_number().over(by_lang.orderBy("source")) - 1).alias("place")  # one row per source
    last = F.floor((F.count(F.lit(1)).over(by_lang) - 1) / SIDE).cast("int")
    groups = counts.filter("term IS NULL").join(langs, "lang", "left").join(sums, ["lang", "source"], "left").select(
        "lang", "source", places, (last + 1).alias("blocks"),
        *(F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("terms", "lang_total", "total")),
    )
    groups = materialize(groups, "groups")
    rates = found.join(groups, ["lang", "source"]).withColumn("rate", _rate("n"))

    over = F.col("rate") - _rate("lang_n", "lang_total")
    more = rates.select("lang", "source", F.col("term").alias("item"), over.alias("value")).filter("value > 0")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    tops = more.withColumn("rank", ranked).filter(F.col("rank") <= top)  # tasks keep their own top before the shuffle
    pairs = _pairs(rates, groups).withColumn("rank", ranked)
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*out).unionByName(tops.withColumn("part", F.lit("term")).select(*out))
