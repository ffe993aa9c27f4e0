"""Calls of scripts with their arguments and the functions around them: scopes, wrappers, call libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitespec.functions import arguments as args
from sitespec.functions import javascript as js
from sitespec.functions.lexing import bracket_events, event_calls, masked_js
from sitespec.functions.strings import built_once, find_all, let
from sitespec.operators.pages import javascript_pages, unfold
from sitespec.schemas import materialize

KEYS = ("domain", "file_path")
GET, POST = "GET", "POST"

# Calls that reach a backend by themselves.
BACKEND = ("fetch", "apiCall")
STYLES = ("axios", "ky", "superagent", "jquery_ajax", "xhr")

_VERBS = "|".join(m.lower() for m in args.METHODS)


@built_once
def _masked(text: str) -> Column:
    return masked_js(F.col(text))


@built_once
def _events(masked: str) -> Column:
    return bracket_events(F.col(masked))


def masked_scripts(pages: DataFrame) -> DataFrame:
    """(domain, file_path, text, masked) of every script page."""
    return javascript_pages(pages).select("domain", F.col("path").alias("file_path"), "text", _masked("text").alias("masked"))


def masked_scopes(pages: DataFrame) -> DataFrame:
    """For each literal in a ``fetch`` or ``apiCall``: the text from the nearest ``{`` before the call to its ``}``.

    Braces and calls in strings and comments don't count. ``scope`` is NULL where that brace never closes, and the
    line where there is none.
    """
    scripts = masked_scripts(pages)
    events = F.filter(_events("masked"), lambda e: (e["kind"] == "call") & _callee(e["name"]).isin(*BACKEND))
    at = scripts.select(*KEYS, "text", "masked", F.explode_outer(events).alias("e")).filter("e IS NOT NULL")
    literal = F.regexp_extract(args.between(F.col("text"), F.col("e.start"), F.col("e.end")), r"^\s*+[\"'`]([^\"'`]++)", 1)
    scoped = at.select(
        *KEYS, F.col("e.line").alias("line_no"), literal.alias("endpoint_literal"),
        _masked_scope("text", "masked", "e").alias("scope"),
    )
    return scoped.filter("endpoint_literal <> ''")


def _callee(name: Column) -> Column:
    """Last name of a dotted one."""
    return F.regexp_extract(name, r"([\w$]++)$", 1)


@built_once
def _masked_scope(text: str, masked: str, event: str) -> Column:
    return js.enclosing_scope(F.col(text), F.col(event)["start"] + 1, F.col(masked))


def code_calls(pages: DataFrame) -> DataFrame:
    """One row per call outside strings and comments, and per function body, of the script pages.

    Columns: domain, file_path, kind (``call`` or ``function``), name, line_no, start, end, root, awaited, the
    function around a call (or the function itself) with depth and parameters, and the arguments of a call.
    """
    # The texts end here: a row for each call holds its own arguments only.
    scripts = masked_scripts(pages).select(*KEYS, _calls("text", "masked").alias("events"))
    one = unfold(scripts.select(*KEYS, F.explode_outer("events").alias("e")))
    return one.select(
        *KEYS, "e.kind", "e.name", F.col("e.line").alias("line_no"), "e.start", "e.end", "e.root", "e.awaited",
        F.col("e.fn.name").alias("function"), F.coalesce("e.fn.depth", F.lit(0)).alias("depth"),
        F.col("e.fn.p_open").alias("function_start"), "e.parameters", "e.arguments",
    )


@built_once
def _calls(text: str, masked: str) -> Column:
    return event_calls(F.col(text), F.col(masked))


def call_functions(calls: DataFrame) -> DataFrame:
    """The innermost function around each backend call: domain, file_path, line_no, function, depth.

    Outside all functions ``function`` is NULL and ``depth`` 0.
    """
    backend = (F.col("kind") == "call") & _callee(F.col("name")).isin(*BACKEND)
    return calls.filter(backend).select(*KEYS, "line_no", F.col("name").alias("callee"), "function", "depth")


# Wrappers -----------------------------------------------------------------


def _passes(part: Column, parameters: Column) -> Column:
    """Number (from 0) of the first parameter that a value is made from; NULL without."""
    words = find_all(part["masked"], r"(?<![\w$.])([\w$]++)", 1)
    hits = F.transform(parameters, lambda p, i: F.when((p != "") & F.array_contains(words, p), i))
    return F.array_min(F.array_compact(hits))


def _sends(part: Column) -> Column:
    """Whether a value is something to send: an object literal or a name, not a literal or function."""
    return part["masked"].rlike(r"^\s*+(?:\{|\[|JSON\.stringify|new\s|[\w$.]++\s*+$)")


def wrappers(calls: DataFrame, backend: tuple[str, ...] = BACKEND) -> DataFrame:
    """Functions that pass a parameter on as URL: domain, wrapper, url_arg, body_arg, hops.

    From definitions to uses, closed over wrappers of wrappers: first the functions around a backend call whose first
    argument holds a parameter, then those that call a wrapper so, until none is new. Where several definitions of a
    site share a name, the one with the fewest hops counts, then the smallest numbers. Each round joins the narrow
    table of passing calls with the wrappers of the last round only; its rounds are as many as the longest chain.
    """
    within = calls.filter("kind = 'call' AND function IS NOT NULL AND size(arguments) > 0 AND size(parameters) > 0")
    passed = F.transform("arguments", lambda a: _passes(a, F.col("parameters")))
    passing = within.select(
        "domain", F.col("function").alias("wrapper"), _callee(F.col("name")).alias("callee"), passed.alias("passed")
    ).filter(F.exists("passed", lambda p: p.isNotNull()) & (F.col("wrapper") != F.col("callee")))
    passing = materialize(passing.distinct(), "passing")

    def found(rows: DataFrame, hops: Column) -> DataFrame:
        named = rows.select(
            "domain", "wrapper", F.get("passed", F.col("url_arg")).alias("url"), F.get("passed", F.col("body_arg")).alias("body"), hops.alias("hops")
        ).filter("url IS NOT NULL")
        best = F.min(F.struct("hops", "url", F.coalesce("body", F.lit(2**31 - 1)).alias("body")))
        return named.groupBy("domain", "wrapper").agg(best.alias("b")).select(
            "domain", "wrapper", F.col("b.url").alias("url_arg"),
            F.when(F.col("b.body") < 2**31 - 1, F.col("b.body")).alias("body_arg"), F.col("b.hops").alias("hops"),
        )

    base = passing.filter(F.col("callee").isin(*backend)).withColumn("url_arg", F.lit(0)).withColumn("body_arg", F.lit(1))
    last = materialize(found(base, F.lit(1)), "wrappers")
    known = last
    while not last.isEmpty():
        using = last.withColumnRenamed("wrapper", "callee")
        more = found(passing.join(using, ["domain", "callee"]), F.col("hops") + 1)
        last = materialize(more.join(known, ["domain", "wrapper"], "left_anti"), "wrappers")
        known = known.unionByName(last)
    return known


def wrapper_calls(calls: DataFrame, backend: tuple[str, ...] = BACKEND) -> DataFrame:
    """Calls that reach a backend by a function of any name: domain, file_path, line_no, function, wrapper, route, method, hops.

    A call of a wrapper with a literal URL; and, with ``hops`` NULL, an awaited call of a function that the site
    doesn't define, if its first argument is a literal path. The method is POST where a payload goes along.
    """
    calls = materialize(calls, "calls")
    known = wrappers(calls, backend)
    used = calls.filter("kind = 'call' AND size(arguments) > 0").withColumn("wrapper", _callee(F.col("name")))
    used = used.filter(~F.col("wrapper").isin(*backend))

    def described(rows: DataFrame, url: Column, body: Column, hops: Column) -> DataFrame:
        sent, address = F.get("arguments", body), F.get("arguments", url)
        # An address made from a parameter is passed on by a wrapper, not used.
        own = rows.filter(_passes(address, F.coalesce("parameters", F.array().cast("array<string>"))).isNull())
        return own.select(
            *KEYS, "line_no", "function", "wrapper", args.literal(address).alias("route"),
            F.when(F.coalesce(_sends(sent), F.lit(False)), POST).otherwise(GET).alias("method"), hops.alias("hops"),
        ).filter("route IS NOT NULL")

    by_name = described(used.join(known, ["domain", "wrapper"]), F.col("url_arg"), F.col("body_arg"), F.col("hops"))
    defined = calls.filter("function IS NOT NULL").select("domain", F.col("function").alias("wrapper")).distinct()
    path = F.col("arguments")[0]["raw"].rlike(r"^\s*+[\"'`]/")
    own = F.col("name").rlike(r"^[\w$]++$")
    unknown = used.filter(F.col("awaited") & path & own).join(defined, ["domain", "wrapper"], "left_anti")
    return by_name.unionByName(described(unknown, F.lit(0), F.lit(1), F.lit(None).cast("int")))


# Call libraries -----------------------------------------------------------


@built_once
def _described(name: str, arguments: str) -> Column:
    """style, method, route and payload of one call; NULL for calls of no known library.

    ``$``-calls count as jQuery, ``open`` with a literal method as a request object.
    """
    callee, listed = F.col(name), F.col(arguments)
    verb = F.upper(F.regexp_extract(callee, rf"\.({_VERBS})$", 1))
    first, second = F.get(listed, F.lit(0)), F.get(listed, F.lit(1))
    library = (
        F.when(callee.rlike(rf"^axios(?:\.(?:{_VERBS}|request))?$"), "axios")
        .when(callee.rlike(rf"^ky(?:\.(?:{_VERBS}))?$"), "ky")
        .when(callee.rlike(rf"^superagent\.(?:{_VERBS})$"), "superagent")
        .when(callee.rlike(r"^(?:\$|jQuery)\.(?:ajax|get|post|getJSON)$"), "jquery_ajax")
        .when(callee.rlike(r"^[\w$.]*\.open$") & F.upper(args.literal(first)).isin(*args.METHODS), "xhr")
    )

    def describe(facts: Column) -> Column:
        style, options = facts["style"], facts["options"]
        alone = F.size(options) > 0  # the first argument is the options object
        more = F.when(alone, options).otherwise(facts["more"])
        named = F.upper(args.literal(args.value_of(more, "method", "type")))
        method = F.when(style == "xhr", F.upper(args.literal(first))).otherwise(
            F.coalesce(F.nullif(verb, F.lit("")), F.when(callee.rlike(r"\.getJSON$"), GET), named, F.lit(GET))
        )
        route = (
            F.when(style == "xhr", args.literal(second))
            .when(alone, args.literal(args.value_of(options, "url"))).otherwise(args.literal(first))
        )
        data = args.value_of(more, "data")
        body = (
            F.when((style == "axios") & ~alone & (verb != ""), second)
            .when(style == "ky", args.value_of(more, "json"))
            .when((style == "jquery_ajax") & callee.rlike(r"\.(?:get|post|getJSON)$"), second)
            .when(style.isin("axios", "jquery_ajax"), data)
        )
        return F.struct(style.alias("style"), method.alias("method"), route.alias("route"), body.alias("body"))

    facts = F.struct(library.alias("style"), args.entries(first).alias("options"), args.entries(second).alias("more"))
    return F.when(library.isNotNull(), let(facts, describe))


@built_once
def _body_keys(body: str) -> Column:
    return args.key_names(args.entries(F.col(body)))


def call_styles(calls: DataFrame) -> DataFrame:
    """Calls of axios, ky, superagent, jQuery and request objects: domain, file_path, line_no, function, style, method, route, keys.

    ``keys`` are the sorted names of the payload object. What goes by another call is joined to its own: ``send`` of
    the same chain for superagent, and for a request object the first ``send`` on the same name after ``open`` in
    the same function. Calls without a literal route are left out.
    """
    named = calls.filter("kind = 'call'").withColumn("_d", _described("name", "arguments"))
    is_send = F.col("name").rlike(r"\.send$")
    one = named.filter(F.col("_d.route").isNotNull() | is_send).select(
        *KEYS, "line_no", "function", "function_start", "name", "start", "root", "_d.*",
        F.when(is_send, F.get("arguments", F.lit(0))).alias("sent"),
    )
    receiver = F.regexp_replace("name", r"\??\.[\w$]++$", "")
    chained = (F.col("style") == "superagent") | F.col("name").startswith(".")
    line = F.when(chained, F.concat_ws(":", F.lit("chain"), "root")).otherwise(
        F.concat_ws(":", F.lit("name"), "function_start", receiver)
    )
    # Calls on one name or in one chain follow each other: what comes next is the own ``send``, or there is none.
    following = Window.partitionBy(*KEYS, "_line").orderBy("start")
    paired = one.withColumn("_line", line).withColumn("_next", F.lead("sent").over(following))
    sent = F.when(F.col("style").isin("superagent", "xhr"), F.col("_next"))
    found = paired.filter("style IS NOT NULL").withColumn("body", F.coalesce("body", sent))
    return found.select(*KEYS, "line_no", "function", "style", "method", "route", _body_keys("body").alias("keys"))
