"""A bit set of ids that tells, within the task that reads a row, whether the row can matter to a join at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitespec.llm.common import materialize

#: Bits per id, and the most bits of a set: 262,144 rows of 64 bits, whatever the number of ids.
BITS, MOST_BITS = 16, 1 << 24


class IdBits:
    """The bits of a frame of one column of ids, 16 an id up to ``MOST_BITS``, as rows of 64.

    It holds all of the ids and few others; beyond the bound it fills up and holds more. So it may be broadcast at any
    size of the corpus, and what it holds needs an exact join: it only spares the shuffle of rows that cannot be
    meant. All of it runs on the JVM; no worker sees a row.
    """

    def __init__(self, ids: DataFrame):
        name = ids.columns[0]
        size = max(64, min(MOST_BITS, BITS * ids.count()))
        self.size = 1 << (size - 1).bit_length()
        at = ids.filter(F.col(name).isNotNull()).select(self._place(F.col(name)).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, at & 63)")).alias("_bits"))
        self.words = materialize(words, "bits")

    def _place(self, ids: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(41), ids), F.lit(self.size)).cast("int")

    def _join(self, rows: DataFrame, name: str, how: str) -> DataFrame:
        place = F.when(F.col(name).isNotNull(), self._place(F.col(name)))
        is_set = F.call_function("getbit", F.col("_bits"), place.bitwiseAND(63)) == 1
        on = (F.shiftright(place, 6) == F.col("_word")) & is_set
        return rows.join(F.broadcast(self.words), on, how)

    def held(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows whose id may be one of the set; none with a NULL id."""
        return self._join(rows, name, "left_semi")

    def others(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows whose id is none of the set, and those with a NULL id."""
        return self._join(rows, name, "left_anti")
