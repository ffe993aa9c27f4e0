"""HTML by regular expression: tags, link attributes, titles, page kinds.

One left-to-right pass cuts a page into tokens, so a comment inside a script, a
script inside a comment or a tag inside an attribute value is never taken for
markup. All repetitions over alternatives are possessive: the Java regex engine
would otherwise recurse once per repetition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitespec.functions.entities import html_unescape
from sitespec.functions.strings import find_all, let, strip

# Fixed value: the title of a page that has none.
UNTITLED = "Untitled Page"

# Inside of a tag up to, not including, its ">" or "/>".
_BODY = (
    r"(?:[^>=/]++|/(?!>)|=+\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))*+"
)
_RAW = r"{0}(?=[\s/>])" + _BODY + r"(?:/>|>.*?(?:</{0}\s*+>|\z))"
_TITLE = r"title(?=[\s/>])" + _BODY + r">(?:[^<]++|<(?![a-zA-Z/!?]))*+(?:</title\s*+>)?+"

# Comments, declarations and end tags, raw-text elements, titles, other start tags.
# What is never closed runs to the end of the page, so that a page full of
# openings is not scanned once per opening; such a tag has no attributes.
TOKEN = (
    r"(?is)<(?:!--.*?(?:--\s*>|\z)|[!?/][^>]*+(?:>|\z)|"
    + _RAW.format("script") + "|" + _RAW.format("style") + "|" + _TITLE
    + r"|[a-z][^\s/>]*+" + _BODY + r"(?:/?>|\z))"
)
USED_TOKEN = r"(?i)^<(?:a|link|script|img|iframe|source|title)[\s/>]"
START_TAG = r"(?is)^<[a-z][^\s/>]*+" + _BODY + r"/?>"
ATTRIBUTE = r"(?s)(?<=['\"\s/])[^\s/>][^\s/=>]*+(?:\s*+=+\s*+(?:'[^']*+'|\"[^\"]*+\"|(?!['\"])[^>\s]*+))?+"

# The tags whose attribute is a link.
HREF_TAGS = "a|link|script|img|iframe"
SRC_TAGS = "script|img|iframe|source"

# A start tag whose attributes are all written plainly, one of them the link: the value is group 2.
_OTHER = r"(?!{0})[a-z][a-z-]*+(?:=(?:\"[^\"]*+\"|[^\s\"'=<>`/]++))?+"
PLAIN_LINK = (
    r"(?i)^<(?:{1})\s++(?:" + _OTHER + r"\s++)*+{0}=(\"?+)([^\"'\s=<>`][^\"'\s<>`]*+)\1(?:\s++" + _OTHER + r")*+\s*+/?>"
)


def is_html(content_type: Column, path: Column) -> Column:
    """HTML by type; a page without a type counts as HTML whatever its path."""
    return F.contains(content_type, F.lit("text/html")) | (content_type == "")


def is_javascript(content_type: Column, path: Column) -> Column:
    return F.contains(content_type, F.lit("javascript")) | F.endswith(path, F.lit(".js"))


def is_static_asset(content_type: Column, path: Column) -> Column:
    return ~is_html(content_type, path) & ~is_javascript(content_type, path)


def norm_content_type(c: Column) -> Column:
    return F.coalesce(F.lower(c), F.lit(""))


def html_tokens(text: Column) -> Column:
    """The start tags that can carry a link, and titles, in document order."""
    return F.filter(find_all(text, TOKEN, 0), lambda t: t.rlike(USED_TOKEN))


def raw_attribute(tag: Column, name: str) -> Column:
    """Value of an attribute as written; the last one wins, '' if absent or without value."""
    hits = F.filter(
        find_all(F.regexp_extract(tag, START_TAG, 0), ATTRIBUTE, 0),
        lambda a: a.rlike(rf"(?i)^{name}(?:[\s=]|$)"),
    )
    last = let(hits, lambda found: F.get(found, F.size(found) - 1))
    value = F.regexp_extract(F.coalesce(last, F.lit("")), r"(?s)^[^\s=]+\s*=+\s*(.*)$", 1)
    return F.regexp_replace(value, r"(?s)^(['\"])(.*)\1$", "$2")


def _raw_links(tokens: Column, name: str, tags: str) -> Column:
    """The attribute of each token, '' for tokens without it; most tags are plain and take one pattern."""
    plain, carrying = PLAIN_LINK.format(name, tags), rf"(?is)^<(?:{tags})[\s/>].*?{name}"

    def value(t: Column) -> Column:
        return let(
            F.regexp_extract(t, plain, 2),
            lambda v: F.when(v != "", v).when(t.rlike(carrying), raw_attribute(t, name)).otherwise(F.lit("")),
        )

    return F.transform(tokens, value)


def _decoded(raw: Column) -> Column:
    return F.transform(F.filter(raw, lambda v: v != ""), html_unescape)


def href_links(tokens: Column) -> Column:
    """``href`` values of a, link, script, img and iframe tags."""
    return _decoded(_raw_links(tokens, "href", HREF_TAGS))


def src_links(tokens: Column) -> Column:
    """``src`` values of script, img, iframe and source tags."""
    return _decoded(_raw_links(tokens, "src", SRC_TAGS))


def tag_links(tokens: Column) -> Column:
    """All ``href`` and ``src`` links of a tokenised page, decoded once."""
    return _decoded(
        F.array_distinct(F.concat(_raw_links(tokens, "href", HREF_TAGS), _raw_links(tokens, "src", SRC_TAGS)))
    )


def token_title(tokens: Column) -> Column:
    """Title of a tokenised page.

    No title, an empty one or one with markup inside gives a fixed text; a blank
    one gives ''.
    """
    first = F.get(F.filter(tokens, lambda t: t.rlike(r"(?i)^<title[\s/>]")), F.lit(0))
    inner = F.regexp_extract(first, r"(?is)^<title(?=[\s/>])" + _BODY + r">(.*)</title\s*+>$", 1)
    return let(
        F.coalesce(inner, F.lit("")),
        lambda s: F.when(s == "", F.lit(UNTITLED)).otherwise(strip(html_unescape(s))),
    )


def html_title(text: Column) -> Column:
    return token_title(html_tokens(text))
