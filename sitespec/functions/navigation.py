"""Navigation targets written as script code, looked for in the text of any page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitespec.functions.strings import find_all_if

_QUOTED = r"['\"`]([^'\"`]++)['\"`]"
_ROOTED = r"['\"`](/[^'\"`]++)['\"`]"

# Fixed values: (substring every match holds, pattern). A "window." in front of
# "location" changes no match, so it is not part of the patterns.
PATTERNS = (
    ("location", r"location(?:\.href)?\s*+=\s*+" + _QUOTED),
    ("location.replace(", r"location\.replace\(\s*+" + _QUOTED + r"\s*+\)"),
    ("location.assign(", r"location\.assign\(\s*+" + _QUOTED + r"\s*+\)"),
    ("href", r"href\s*+:\s*+" + _ROOTED),
    ("url", r"url\s*+:\s*+" + _ROOTED),
)


def js_link_filter(link: Column) -> Column:
    """True for a script string that may be a path on the same site."""
    return (
        (link != "")
        & ~F.startswith(link, F.lit("http"))
        & (F.contains(link, F.lit(".")) | F.contains(link, F.lit("/")) | (F.length(link) > 3))
    )


def js_nav_links(text: Column) -> Column:
    """All raw navigation strings of a text, pattern by pattern."""
    found = F.concat(*[find_all_if(text, needle, pattern) for needle, pattern in PATTERNS])
    return F.filter(found, js_link_filter)
