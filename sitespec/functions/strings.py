"""Small string helpers shared by the other function modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that str.strip() removes.
STRIP_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` evaluated once, however often ``fn`` uses it.

    Inside lambdas Spark removes no common subexpressions, and nesting functions
    that repeat their argument makes plans grow exponentially.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def built_once(fn: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the expression that ``fn`` builds from column names, per Spark context.

    A large expression takes about a thousand calls into the JVM to build; an
    operator used again in the same session need not repeat them.
    """
    built: dict[tuple, Column] = {}

    @wraps(fn)
    def wrapper(*names: str) -> Column:
        context = SparkContext._active_spark_context
        key = (id(context), context.applicationId if context else None, names)
        if key not in built:
            built[key] = fn(*names)
        return built[key]

    return wrapper


def strip(c: Column) -> Column:
    """Trim white space of any kind on both sides (plain ``btrim`` takes blanks only)."""
    return F.btrim(c, F.lit(STRIP_CHARS))


def no_strings() -> Column:
    """An empty ``array<string>``."""
    return F.array().cast("array<string>")


def find_all(c: Column, pattern: str, group: int = 1) -> Column:
    """All non-overlapping matches of ``pattern``, left to right."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def find_all_if(c: Column, needle: str, pattern: str, group: int = 1) -> Column:
    """``find_all`` for patterns that cannot match unless ``needle`` occurs.

    The substring test is far cheaper than a regex pass over a whole page.
    """
    return F.when(F.contains(c, F.lit(needle)), find_all(c, pattern, group)).otherwise(no_strings())


# One well-formed UTF-8 sequence, with a character for each byte.
_SEQUENCE = (
    r"[\x00-\x7F]|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}"
    r"|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}"
)


def decode_text(c: Column) -> Column:
    """Bytes to text, with bytes that are not UTF-8 dropped; a genuine U+FFFD stays.

    Sound bytes are taken as they are. Only others are read one character a byte, where a pattern keeps the
    well-formed sequences. NULL stays NULL.
    """

    def sound(b: Column) -> Column:
        by_byte = F.regexp_replace(F.decode(b, "ISO-8859-1"), f"(?s)((?:{_SEQUENCE})++)|.", "$1")
        return F.when(F.is_valid_utf8(b.cast("string")), b).otherwise(F.encode(by_byte, "ISO-8859-1")).cast("string")

    return let(c.cast("binary"), sound)
