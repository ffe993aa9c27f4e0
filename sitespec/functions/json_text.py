"""JSON values as text, for documents whose values have no common type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitespec.functions.javascript import KIND_EMPTY, KIND_STRING, KIND_TRANSACTIONS, KIND_USER
from sitespec.functions.strings import let

# What each kind of response key looks like in a schema.
USER_JSON = '{"id":"TYPE_NUMBER","name":"TYPE_STRING","email":"TYPE_STRING","token":"TYPE_STRING"}'
TRANSACTIONS_JSON = '[{"id":"TYPE_NUMBER","reference":"TYPE_STRING","amount":"TYPE_NUMBER","status":"TYPE_STRING"}]'
EMPTY_JSON = "{}"
STRING_JSON = '"TYPE_STRING"'
UNKNOWN_JSON = '"TYPE_UNKNOWN_DETERMINED_BY_JS"'
# Fixed value: the sample of a response that claims to be JSON and is not.
BROKEN_JSON = '{"error":"Failed to parse returned JSON string"}'


def json_text(c: Column) -> Column:
    """JSON text of a value of any type; ``null`` for NULL."""
    return let(
        F.to_json(F.array(c), {"ignoreNullFields": "false"}),
        lambda s: F.substring(s, F.lit(2), F.length(s) - 2),
    )


def json_object(*members: tuple[str, Column]) -> Column:
    """Object text from (name, JSON text) pairs."""
    out = []
    for n, (name, value) in enumerate(members):
        out += [F.lit(("," if n else "{") + f'"{name}":'), value]
    return F.concat(*out, F.lit("}"))


def schema_json(schema: Column) -> Column:
    """A guessed response schema as an object."""

    def member(e: Column) -> Column:
        value = (
            F.when(e.kind == KIND_USER, F.lit(USER_JSON))
            .when(e.kind == KIND_TRANSACTIONS, F.lit(TRANSACTIONS_JSON))
            .when(e.kind == KIND_EMPTY, F.lit(EMPTY_JSON))
            .when(e.kind == KIND_STRING, F.lit(STRING_JSON))
            .otherwise(F.lit(UNKNOWN_JSON))
        )
        return F.concat(F.lit('"'), e.key, F.lit('":'), value)

    return F.concat(F.lit("{"), F.array_join(F.transform(schema, member), ","), F.lit("}"))


def mock_payload(method: Column, keys: Column) -> Column:
    """Probe payload of a POST endpoint as an object; ``{}`` for other methods."""

    def member(key: Column) -> Column:
        low = F.lower(key)
        has = lambda *parts: F.greatest(*[F.contains(low, F.lit(p)) for p in (*parts, parts[0])])
        value = (
            F.when(has("id", "number", "bvn", "nin"), F.lit('"1234567890"'))
            .when(has("amount", "price", "balance"), F.lit("1000"))
            .otherwise(F.lit('"test_data"'))
        )
        return F.concat(F.lit('"'), key, F.lit('":'), value)

    body = F.concat(F.lit("{"), F.array_join(F.transform(keys, member), ","), F.lit("}"))
    return F.when(F.upper(method) == "POST", body).otherwise(F.lit("{}"))


#: A quoted string, or (outside of one) white space.
_STRING, _BLANKS = r'"(?:[^"\\]++|\\.)*+"', r"[ \t\r\n]++"
#: JSON as it is defined: double quotes only, strings and numbers of any length.
_STRICT = {
    "allowSingleQuotes": "false", "allowUnquotedControlChars": "true", "mode": "PERMISSIVE",
    "maxStringLen": str(2**31 - 1), "maxNumLen": str(2**31 - 1),
}


def compact_json(text: Column) -> Column:
    """The same JSON text without white space between its parts; every value stays as it was written."""
    return F.regexp_replace(text, f"({_STRING})|{_BLANKS}", "$1")


def _is_json(text: Column) -> Column:
    """True for exactly one JSON value, of any length.

    A text that closes both an array and an object around it early would be no value in one of the two.
    """
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", _STRICT)
    member = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "struct<v:string>", _STRICT)["v"]
    return F.coalesce(F.size(listed) == 1, F.lit(False)) & (member.isNotNull() | (text == "null"))


def _first_element(text: Column) -> Column:
    """First element of a compact list as JSON text; NULL for an empty list and for anything else.

    Strings, numbers and literals stay as written; in an object or a list, numbers beyond double precision are
    written anew.
    """
    string = F.regexp_extract(text, rf'^\[({_STRING}|[^\[\]{{}},"]++)', 1)
    other = F.get(F.from_json(text, "array<string>", _STRICT), F.lit(0))
    return F.when(F.startswith(text, F.lit("[")) & (text != "[]"), F.when(string != "", string).otherwise(F.coalesce(other, F.lit("null"))))


def response_sample(content_type: Column, body: Column) -> Column:
    """What is kept of a response, as JSON text.

    JSON: the first element of a list that is not empty, else the document, in its own words (repeated names, the
    digits of numbers) but for the white space between them. Broken JSON: a fixed error object. Other types: the
    first 200 characters. No length makes a difference.
    """
    is_json = F.contains(content_type, F.lit("application/json")) | F.contains(content_type, F.lit("text/json"))
    parsed = let(
        compact_json(body),
        lambda text: F.when(_is_json(text), F.coalesce(_first_element(text), text)).when(body.isNotNull(), F.lit(BROKEN_JSON)),
    )
    plain = json_object(("raw_non_json_sample", json_text(F.substring(body, 1, 200))))
    return F.when(is_json, parsed).otherwise(plain)


def sample_is_scalar(sample: Column) -> Column:
    """A number, a boolean or ``null``: such a sample cannot be checked."""
    return ~F.substring(sample, 1, 1).isin("{", "[", '"')


def sample_verified(sample: Column) -> Column:
    """True unless the sample is, or has as a member, ``connection_error``."""
    v = F.try_parse_json(sample)
    first = F.substring(sample, 1, 1)
    failed = (
        F.when(first == "{", F.array_contains(F.json_object_keys(sample), "connection_error"))
        .when(first == "[", F.exists(F.try_variant_get(v, "$", "array<variant>"), lambda e: F.to_json(e) == '"connection_error"'))
        .otherwise(F.contains(sample, F.lit("connection_error")))
    )
    return ~sample_is_scalar(sample) & ~F.coalesce(failed, F.lit(False))
