"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitespec.llm.common import materialize

ROUNDS = 60


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _toward(pairs: DataFrame) -> DataFrame:
    """For pairs (u, v): each v with the smallest of u and all its partners. Mins are taken before the join."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) in any order to (id, component_id): the smallest id reachable, for every id that has a link.

    Each round is two joins of the links with one minimum per node, so nothing is gathered per component; a
    node with very many links is one key of a join, which the adaptive planner can split. Rounds grow with the
    logarithm of the longest path. Every round is written to the shared folder, which cuts the lineage.
    Repeated links and links of an id to itself are allowed, NULL ends are dropped.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = materialize(links.filter("a <> b and a is not null and b is not null").distinct(), "links")
    state = _state(links)
    for _ in range(ROUNDS):
        if not state[0]:
            break
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        large = _toward(both).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        small = _toward(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select("u", "m"))
        links = materialize(small.filter("a <> b").distinct(), "links")
        before, state = state, _state(links)
        if before == state:
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = links.select("b").distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(
        roots.select("b", F.col("b").alias("component_id"))
    )
