"""HTML character references (``&amp;``, ``&#38;``, ``&#x26;``) to text."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitespec.functions.strings import let

MAX_LEN = 2147483647
REPLACEMENT = "\ufffd"

# The commonest names, put first in the table.
COMMON = ("amp;", "quot;", "lt;", "gt;", "nbsp;", "copy;", "middot;")

# The HTML 5 name table of the Python library, split by its own rule: names that
# end in ";" must match whole, the others also match as a prefix. Each is one
# text "<sep>name=value<sep>name=value<sep>": a string literal keeps plans small,
# where a map literal is hashed and compared by every optimizer rule.
_SEP = "\x1f"
_WHOLE = sorted((k for k in html.entities.html5 if k.endswith(";")), key=lambda k: k not in COMMON)
_PREFIX = sorted((k for k in html.entities.html5 if not k.endswith(";")), key=len, reverse=True)
_WHOLE_TEXT = _SEP + "".join(f"{k}={html.entities.html5[k]}{_SEP}" for k in _WHOLE)
_PREFIX_TEXT = _SEP + "".join(f"{k}={html.entities.html5[k]}{_SEP}" for k in _PREFIX)
_PREFIX_PATTERN = "^(" + "|".join(_PREFIX) + ")"

def _windows_1252() -> str:
    """What the codes 0x80 to 0x9F stand for, in order."""
    out = []
    for code in range(0x80, 0xA0):
        try:
            out.append(bytes([code]).decode("cp1252"))
        except UnicodeDecodeError:
            out.append(chr(code))
    return "".join(out)


def code_point(n: Column) -> Column:
    """The character of a code point (``chr`` stops at 255)."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _numeric(ref: Column) -> Column:
    """The character of ``#65;`` or ``#x41;``."""
    digits = F.regexp_extract(ref, "^#[xX]?0*([0-9a-fA-F]*)", 1)
    value = F.when(ref.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits)
    n = F.when(F.length(digits) > 7, 0x110000).when(digits == "", 0).otherwise(value.cast("int"))
    return let(n, _character)


def _character(n: Column) -> Column:
    nothing = (
        n.between(1, 8) | n.between(14, 31) | (n == 11) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n % 65536 >= 0xFFFE)
    )
    return (
        F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit(REPLACEMENT))
        .when(n.between(0x80, 0x9F), F.substring(F.lit(_windows_1252()), (n - 0x7F).cast("int"), F.lit(1)))
        .when(nothing, F.lit(""))
        .otherwise(code_point(n))
    )


def _after(c: Column, prefix: Column) -> Column:
    return F.substring(c, F.length(prefix) + 1, F.lit(MAX_LEN))


def _look_up(table: str, name: Column) -> Column:
    """Value of a name in a table text, NULL if absent."""
    key = F.concat(F.lit(_SEP), name, F.lit("="))

    def value_at(pos: Column) -> Column:
        start = F.substring(F.lit(table), pos + F.length(key), F.lit(8))
        return F.when(pos > 0, F.substring_index(start, _SEP, 1))

    return let(F.instr(F.lit(table), key), value_at)


def _replace_name(p: Column, name: Column, table: str) -> Column:
    """The piece with its leading name decoded, NULL if the table does not hold the name."""
    return F.when(name != "", F.concat(_look_up(table, name), _after(p, name)))


def _decode_piece(p: Column) -> Column:
    """Decode the text that follows one ``&``."""
    number = F.regexp_extract(p, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)
    name = F.regexp_extract(p, r"^[A-Za-z0-9]{1,31};", 0)
    prefix = F.regexp_extract(p, _PREFIX_PATTERN, 1)
    return F.coalesce(
        let(name, lambda n: _replace_name(p, n, _WHOLE_TEXT)),
        let(prefix, lambda n: _replace_name(p, n, _PREFIX_TEXT)),
        let(number, lambda n: F.when(n != "", F.concat(_numeric(n), _after(p, n)))),
        F.concat(F.lit("&"), p),
    )


def _decode(c: Column) -> Column:
    return let(
        F.split(c, "&"),
        lambda pieces: F.concat(
            F.get(pieces, F.lit(0)),
            F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), _decode_piece), ""),
        ),
    )


def html_unescape(c: Column) -> Column:
    """Decode all character references; text without ``&`` is passed through."""
    return let(c, lambda s: F.when(F.contains(s, F.lit("&")), _decode(s)).otherwise(s))
