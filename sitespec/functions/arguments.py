"""Arguments of calls and entries of object literals, cut at the commas outside all inner brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitespec.functions.strings import find_all, let

PART = "struct<raw:string,masked:string>"
ENTRY = "struct<key:string,raw:string,masked:string>"

# What may be sent in a call's options, by library.
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
_VERBS = "|".join(METHODS)


def between(text: Column, first: Column, last: Column) -> Column:
    """Characters strictly between two places, counted from 0."""
    return F.substring(text, first + 2, last - first - 1)


def parts(raw: Column, masked: Column) -> Column:
    """``array<PART>`` of a list, cut at its own commas; brackets of strings don't count, as the masked text has none."""
    tokens = find_all(masked, r"[^(){}\[\],]*+[(){}\[\],]|[^(){}\[\],]++$", 0)
    start = F.struct(
        F.lit(0).alias("pos"), F.lit(0).alias("depth"), F.lit(0).alias("from"),
        F.array().cast("array<struct<at:int,size:int>>").alias("cuts"),
    )

    def step(acc: Column, token: Column) -> Column:
        last, end = F.right(token, F.lit(1)), acc["pos"] + F.length(token)
        depth = acc["depth"] + F.when(last.isin("(", "[", "{"), 1).when(last.isin(")", "]", "}"), -1).otherwise(0)
        is_cut = (last == ",") & (acc["depth"] == 0)
        cut = F.array(F.struct(acc["from"].alias("at"), (end - 1 - acc["from"]).alias("size")))
        return F.struct(
            end.alias("pos"), depth.alias("depth"), F.when(is_cut, end).otherwise(acc["from"]).alias("from"),
            F.when(is_cut, F.concat(acc["cuts"], cut)).otherwise(acc["cuts"]).alias("cuts"),
        )

    def cuts(acc: Column) -> Column:
        rest = F.struct(acc["from"].alias("at"), (acc["pos"] - acc["from"]).alias("size"))
        return F.concat(acc["cuts"], F.array(rest))

    def cut(text: Column, c: Column) -> Column:
        return F.substring(text, c["at"] + 1, c["size"])

    pieces = F.transform(F.aggregate(tokens, start, step, cuts), lambda c: F.struct(cut(raw, c).alias("raw"), cut(masked, c).alias("masked")))
    return F.filter(pieces, lambda p: p["raw"].rlike(r"\S"))


def entries(part: Column) -> Column:
    """``array<ENTRY>`` of an object literal, ``JSON.stringify(...)`` around it left out; other values have none.

    Spread values and methods aren't entries; of a name alone (``{a}``) the value is empty.
    """
    opens = rf"^\s*+(?:JSON\.stringify\s*+\(\s*+)?\{{"

    def inner(p: Column) -> Column:
        first = F.length(F.regexp_extract(p["masked"], opens, 0)) - 1
        last = F.length(p["masked"]) - F.length(F.regexp_extract(p["masked"], r"\}[\s)]*+$", 0))
        return let(
            F.struct(between(p["raw"], first, last).alias("raw"), between(p["masked"], first, last).alias("masked")),
            lambda body: F.transform(parts(body["raw"], body["masked"]), entry),
        )

    def entry(p: Column) -> Column:
        key = r"^\s*+[\"'`]?([\w$\-]++)[\"'`]?\s*+(?::|$)"
        colon = F.length(F.regexp_extract(p["raw"], key, 0))
        return F.struct(
            F.regexp_extract(p["raw"], key, 1).alias("key"),
            F.substring(p["raw"], colon + 1, F.length(p["raw"])).alias("raw"),
            F.substring(p["masked"], colon + 1, F.length(p["raw"])).alias("masked"),
        )

    found = let(part, lambda p: F.when(p["masked"].rlike(opens), F.filter(inner(p), lambda e: e["key"] != "")))
    return F.coalesce(found, F.array().cast(f"array<{ENTRY}>"))


def value_of(of: Column, *keys: str) -> Column:
    """The value (``PART``) of the first entry with one of the names; NULL without."""
    entry = F.get(F.filter(of, lambda e: e["key"].isin(*keys)), F.lit(0))
    return F.when(entry.isNotNull(), F.struct(entry["raw"].alias("raw"), entry["masked"].alias("masked")))


def key_names(of: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(of, lambda e: e["key"])))


def literal(part: Column) -> Column:
    """The text of a literal that a value begins with; NULL without."""
    return F.nullif(F.regexp_extract(part["raw"], r"^\s*+[\"'`]([^\"'`]*+)", 1), F.lit(""))


def identifier(part: Column) -> Column:
    return F.nullif(F.regexp_extract(part["masked"], r"^\s*+([\w$]++)\s*+$", 1), F.lit(""))
