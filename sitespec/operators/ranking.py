"""Row numbers within a domain that never gather a domain in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitespec.schemas import materialize

SALTS = 32


def number_within(
    df: DataFrame, group: list[str], order: list[str], name: str, size_name: str | None = None
) -> DataFrame:
    """Add ``name`` = 1, 2, 3 ... within ``group`` by ``order``, and the group's size on request.

    ``row_number() over (partition by group)`` would sort the largest group in
    a single task. Here the rows are range-partitioned by group and order
    together, so a large group spreads over many tasks; each task numbers its
    own rows, and the few (group, partition) counts, added up, give the offsets.
    ``order`` must be total within the group.
    """
    ranged = df.sort(*group, *order).select("*", F.monotonically_increasing_id().alias("_pos"))
    # Written once: the layout must not be computed twice.
    placed = materialize(ranged.withColumn("_part", F.shiftright("_pos", 33)), "ranged")
    counts = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    # At most one row per group and partition reaches this window.
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group, "_part", "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("_size"),
    )
    number = F.col("_pos") - F.col("_first") + F.col("_before") + 1
    out = [*df.columns, number.alias(name)]
    if size_name:
        out.append(F.col("_size").alias(size_name))
    return placed.join(offsets, [*group, "_part"]).select(*out)


def join_per_domain(df: DataFrame, small: DataFrame, how: str, spread: Column) -> DataFrame:
    """Join rows with a table of one row per domain, whatever the share of the largest domain.

    The domain table is repeated once per salt and the rows are salted by
    ``spread``, so a hot domain is split over ``SALTS`` tasks. If the domain
    table turns out small, the adaptive planner broadcasts it instead.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, ["domain", "_salt"], how).drop("_salt")
