"""Static analysis of script files: backend call sites and what they send and read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitespec.functions.paths import route_below
from sitespec.functions.strings import find_all, let, no_strings, strip

MAX_LEN = 2147483647

# Fixed value: where endpoints live when a script names no base.
DEFAULT_BASE = "../api"

# Payload formats.
FORM_FORMAT = "Parameters (application/x-www-form-urlencoded)"
MULTIPART_FORMAT = "Multipart FormData (multipart/form-data)"
JSON_FORMAT = "Raw JSON (application/json)"

# Names that are not payload keys, and not response keys.
NOT_PAYLOAD = (
    "method", "headers", "body", "status", "mode", "credentials", "cache",
    "redirect", "html", "submit", "title",
)
NOT_RESPONSE = ("json", "ok", "status_code")

# Kinds of a response key; rendered to JSON by the sinks.
KIND_USER = "user"
KIND_TRANSACTIONS = "transactions"
KIND_EMPTY = "empty"
KIND_STRING = "string"
KIND_UNKNOWN = "unknown"

# Window tried first when looking for the end of a scope.
SCOPE_WINDOW = 4096

_Q = r"['\"`]"
_WORD = r"[a-zA-Z0-9_]"
_KEY = r"[a-zA-Z0-9_\-]"
# A whole run of name characters; the look-behind keeps long runs linear.
_WHOLE_WORD = rf"(?<!{_WORD})({_WORD}++)"
_WHOLE_KEY = rf"(?<!{_KEY})({_KEY}++)"


def api_base_url(js: Column) -> Column:
    found = F.regexp_extract(js, rf"const\s+API_BASE_URL\s*=\s*{_Q}([^'\"`]++){_Q}", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(DEFAULT_BASE))


def payload_format(js: Column) -> Column:
    """File-level payload format."""
    return (
        F.when(
            F.contains(js, F.lit("URLSearchParams")) | F.contains(js, F.lit("application/x-www-form-urlencoded")),
            F.lit(FORM_FORMAT),
        )
        .when(F.contains(js, F.lit("FormData")), F.lit(MULTIPART_FORMAT))
        .otherwise(F.lit(JSON_FORMAT))
    )


def js_lines(js: Column) -> Column:
    return F.split(js, "\n")


def call_line(line: Column) -> Column:
    return F.contains(line, F.lit("apiCall")) | F.contains(line, F.lit("fetch"))


def endpoint_literal(line: Column) -> Column:
    """First literal argument of a call on the line, '' if there is none."""
    return F.regexp_extract(line, rf"(?:apiCall|fetch)\(\s*+{_Q}([^'\"`]++){_Q}", 1)


def function_purpose(line: Column) -> Column:
    """Name assigned to on the line, else the function declared there."""
    assigned = F.regexp_extract(line, rf"{_WHOLE_WORD}\s*+=", 1)
    declared = F.regexp_extract(line, rf"function\s+({_WORD}+)", 1)
    return F.coalesce(
        F.nullif(assigned, F.lit("")), F.nullif(declared, F.lit("")), F.lit("unknown_function")
    )


def http_method(line: Column) -> Column:
    """GET when the line holds "get" in any case, even inside a longer word."""
    return F.when(F.contains(F.upper(line), F.lit("GET")), F.lit("GET")).otherwise(F.lit("POST"))


def raw_js_context(line: Column) -> Column:
    return strip(line)


def response_keys(js: Column) -> Column:
    """Sorted distinct names read from ``result.``, ``data.`` or ``response.``."""
    found = find_all(js, rf"(?:result|data|response)\.({_WORD}++)")
    return F.array_sort(F.array_distinct(F.filter(found, lambda k: ~k.isin(*NOT_RESPONSE))))


def reading_text(lines: Column) -> Column:
    """The lines that hold ``result`` or ``data``, as one text."""
    return F.array_join(
        F.filter(lines, lambda s: F.contains(s, F.lit("result")) | F.contains(s, F.lit("data"))), "\n"
    )


def response_kind(key: Column) -> Column:
    low = F.lower(key)
    return (
        F.when(F.contains(low, F.lit("user")), F.lit(KIND_USER))
        .when(F.contains(low, F.lit("transaction")), F.lit(KIND_TRANSACTIONS))
        .when(F.contains(low, F.lit("price")) | F.contains(low, F.lit("plan")), F.lit(KIND_EMPTY))
        .otherwise(F.lit(KIND_UNKNOWN))
    )


def keys_read(keys: Column, reading: Column) -> Column:
    """The keys that occur on a reading line; a fact of the file, the same for all its calls."""
    return let(reading, lambda text: F.filter(keys, lambda key: F.contains(text, key)))


def response_schema(keys: Column, reading: Column, line: Column) -> Column:
    """``array<struct<key, kind>>`` of the keys seen on the call line or on a reading line."""
    return let(keys_read(keys, reading), lambda read: _schema(keys, read, line))


def _schema(keys: Column, read: Column, line: Column) -> Column:
    """The same, from the keys that ``keys_read`` has found."""

    def entry(key: Column) -> Column:
        seen = F.contains(line, key) | F.array_contains(read, key)
        kind = F.when(seen, response_kind(key)).when(key.isin("status", "message"), F.lit(KIND_STRING))
        return F.struct(key.alias("key"), kind.alias("kind"))

    return F.filter(F.transform(keys, entry), lambda e: e.kind.isNotNull())


def _scan(tail: Column) -> Column:
    """Balance the braces of a text that starts with one: ``struct<depth, used, done>``.

    Only the used length is accumulated, never the scope text itself.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("used"), F.lit(False).alias("done"))

    def step(acc: Column, token: Column) -> Column:
        last = F.right(token, F.lit(1))
        depth = acc.depth + F.when(last == "{", 1).when(last == "}", -1).otherwise(0)
        return F.when(acc.done, acc).otherwise(
            F.struct(
                depth.alias("depth"),
                (acc.used + F.length(token)).alias("used"),
                (depth == 0).alias("done"),
            )
        )

    return F.aggregate(find_all(tail, r"[^{}]++[{}]?+|[{}]", 0), start, step)


def _scope_at(js: Column, opens: Column) -> Column:
    """Scope from the brace at a 1-based position: most end inside a first window, only the others take the rest."""

    def far(tail: Column) -> Column:
        return let(_scan(tail), lambda all_of_it: F.when(all_of_it.done, F.substring(tail, F.lit(1), all_of_it.used)))

    def near(window: Column) -> Column:
        return let(
            _scan(window),
            lambda found: F.when(found.done, F.substring(window, F.lit(1), found.used)).when(
                F.length(window) == SCOPE_WINDOW, let(F.substring(js, opens, F.lit(MAX_LEN)), far)
            ),
        )

    return let(F.substring(js, opens, F.lit(SCOPE_WINDOW)), near)


def _scope_line(js: Column, pos: Column, head: Column) -> Column:
    """The line around the position; a last line without line end loses its last character."""
    upto = let(
        F.substring(js, pos, F.lit(MAX_LEN)),
        lambda rest: F.when(F.contains(rest, F.lit("\n")), F.substring_index(rest, "\n", 1)).otherwise(
            F.substring(rest, F.lit(1), F.length(rest) - 1)
        ),
    )
    return F.concat(F.substring_index(head, "\n", -1), upto)


def enclosing_scope(js: Column, pos: Column, masked: Column | None = None) -> Column:
    """Text from the nearest ``{`` before a 1-based position to its balancing ``}``.

    NULL when that brace is never closed; without any brace, the line itself.
    Braces in strings and comments count, unless the masked text is given too: then the braces of that count.
    """
    if masked is not None:
        head = F.substring(masked, F.lit(1), pos - 1)
        opens = F.length(head) - F.length(F.substring_index(head, "{", -1))
        scope = F.substring(js, opens, F.length(_scope_at(masked, opens)))
        line = _scope_line(js, pos, F.substring(js, F.lit(1), pos - 1))
        return F.when(F.contains(head, F.lit("{")), scope).otherwise(line)

    def from_head(head: Column) -> Column:
        opens = F.length(head) - F.length(F.substring_index(head, "{", -1))
        return F.when(
            F.contains(head, F.lit("{")), _scope_at(js, opens)
        ).otherwise(_scope_line(js, pos, head))

    # The nearest brace mostly stands close before the position; the whole head is cut only where it does not.
    first = F.greatest(pos - SCOPE_WINDOW, F.lit(1))

    def from_near(near: Column) -> Column:
        opens = first + F.length(near) - F.length(F.substring_index(near, "{", -1)) - 1
        return F.when(F.contains(near, F.lit("{")), _scope_at(js, opens)).otherwise(
            let(F.substring(js, F.lit(1), pos - 1), from_head)
        )

    return let(F.substring(js, first, pos - first), from_near)


def append_keys(scope: Column) -> Column:
    return find_all(scope, rf"\.(?:append|set)\(\s*+{_Q}({_KEY}++){_Q}")


def body_string_keys(scope: Column) -> Column:
    """Names before ``=`` in the first ``body: '...'``."""
    body = F.regexp_extract(scope, rf"body\s*+:\s*+{_Q}([^'\"`]++){_Q}", 1)
    return find_all(body, rf"{_WHOLE_KEY}=")


def _block_keys(blocks: Column) -> Column:
    keys = F.flatten(F.transform(blocks, lambda b: find_all(b, rf"{_WHOLE_KEY}\s*+:")))
    return F.filter(keys, lambda k: ~F.lower(k).isin(*NOT_PAYLOAD))


def body_json_blocks(scope: Column, stringify_paren: bool = False) -> Column:
    """``body: {...}`` up to the first ``}``; ``JSON.stringify({`` only on request."""
    paren = r"\(?" if stringify_paren else ""
    return find_all(scope, rf"(?s)body\s*+:\s*+(?:JSON\.stringify{paren})?\s*+\{{([^}}]*+)\}}")


def var_blocks(scope: Column) -> Column:
    """Object literals assigned to a variable."""
    return find_all(scope, rf"(?s)(?:const|let|var)\s++{_WORD}++\s*+=\s*+\{{([^}}]*+)\}}")


def payload_keys(scope: Column, stringify_paren: bool = False) -> Column:
    """Sorted distinct payload keys of a scope; NULL or empty scopes have none."""
    blocks = let(
        body_json_blocks(scope, stringify_paren),
        lambda body: F.when(F.size(body) > 0, body).otherwise(var_blocks(scope)),
    )
    keys = F.concat(append_keys(scope), body_string_keys(scope), _block_keys(blocks))
    return F.coalesce(F.array_sort(F.array_distinct(keys)), no_strings())


def call_site_array(
    js: Column,
    root: Column,
    lines: Column,
    keys: Column,
    reading: Column,
    stringify_paren: bool = False,
) -> Column:
    """All call sites of one file, as an array of structs.

    ``root``, ``lines``, ``keys`` and ``reading`` are the file-level facts
    (``route_root``, ``js_lines``, ``response_keys``, ``reading_text``). The steps
    stay inside the row, so the file text is never copied once per line.
    """
    calls = F.array_compact(
        F.transform(
            lines,
            lambda s, i: F.when(
                call_line(s),
                F.struct((i + 1).alias("line_no"), s.alias("line"), endpoint_literal(s).alias("literal")),
            ),
        )
    )
    scoped = F.transform(
        F.filter(calls, lambda c: c.literal != ""),
        lambda c: F.struct(
            c.alias("call"),
            let(F.instr(js, c.literal), lambda pos: enclosing_scope(js, pos)).alias("scope"),
        ),
    )
    # Bound once: the optimizer puts the columns' definitions here, and in a lambda they would run for each call.
    facts = F.struct(root.alias("root"), keys.alias("keys"), keys_read(keys, reading).alias("read"))
    describe = lambda file: F.transform(
        scoped,
        lambda s: F.struct(
            s.call.line_no.alias("line_no"),
            s.call.literal.alias("endpoint_literal"),
            route_below(file.root, s.call.literal).alias("url"),
            http_method(s.call.line).alias("method"),
            function_purpose(s.call.line).alias("function_purpose"),
            payload_keys(s.scope, stringify_paren).alias("guessed_payload_keys"),
            _schema(file.keys, file.read, s.call.line).alias("response_schema"),
            raw_js_context(s.call.line).alias("raw_js_context"),
        ),
    )
    return let(facts, describe)
