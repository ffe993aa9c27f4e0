"""POSIX path functions and API route resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitespec.functions.strings import let
from sitespec.functions.urls import url_path


def posix_dirname(path: Column) -> Column:
    return let(
        F.regexp_extract(path, r"(?s)^(.*/)", 1),
        lambda head: F.when(head.rlike(r"^/*$"), head).otherwise(F.regexp_replace(head, r"/+$", "")),
    )


def posix_join(a: Column, b: Column) -> Column:
    return (
        F.when(F.startswith(b, F.lit("/")), b)
        .when((a == "") | F.endswith(a, F.lit("/")), F.concat(a, b))
        .otherwise(F.concat(a, F.lit("/"), b))
    )


def posix_normpath(path: Column) -> Column:
    """Drop ``.``, ``..``, doubled and trailing slashes; exactly two leading slashes survive."""
    return let(path, _normpath)


def _normpath(path: Column) -> Column:
    lead = (
        F.when(path.rlike(r"^//(?!/)"), F.lit("//"))
        .when(F.startswith(path, F.lit("/")), F.lit("/"))
        .otherwise(F.lit(""))
    )
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))

    def step(acc: Column, s: Column) -> Column:
        up = s == ".."
        can_pop = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) != "..")
        return (
            F.when(up & can_pop, F.slice(acc, F.lit(1), F.size(acc) - 1))
            .when(up & F.startswith(path, F.lit("/")), acc)
            .otherwise(F.array_append(acc, s))
        )

    body = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), step), "/")
    return F.coalesce(F.nullif(F.concat(lead, body), F.lit("")), F.lit("."))


def route_root(file_path: Column, base: Column) -> Column:
    """Folder that the endpoint literals of the script at ``file_path`` are relative to.

    A base that starts with ``http`` stands for ``/api``; any other is relative
    to the script's own folder.
    """
    return let(
        F.struct(posix_dirname(file_path).alias("folder"), base.alias("base")),
        lambda b: F.when(F.startswith(b.base, F.lit("http")), F.lit("/api"))
        .when(b.base == "", b.folder)
        .otherwise(posix_normpath(posix_join(b.folder, b.base))),
    )


def route_below(root: Column, literal: Column) -> Column:
    """Route of an endpoint literal: normalised first, cut at ``?`` after.

    Absolute URLs give their path.
    """
    relative = let(
        F.substring_index(posix_normpath(posix_join(root, literal)), "?", 1),
        lambda route: F.when(F.startswith(route, F.lit("/")), route).otherwise(F.concat(F.lit("/"), route)),
    )
    return F.when(literal.rlike(r"^https?://"), url_path(literal)).otherwise(relative)


def resolve_route(file_path: Column, base: Column, literal: Column) -> Column:
    """Route of an endpoint literal found in the script at ``file_path``."""
    return let(route_root(file_path, base), lambda root: route_below(root, literal))
