"""The short ways of plain tags and paths give what the long ones give."""

import re

from pyspark.sql import functions as F

from sitespec.functions import html, urls

TAGS = [
    ('<a href="/c/1">', "/c/1"), ('<a class=x href="/c/2?a=1">', "/c/2?a=1"), ("<link rel=next href=//h/c/4>", "//h/c/4"),
    ('<script async src="/a.js">var a = 1;</script>', None), ('<A CLASS="y z" HREF="/c" data-href="/no"/>', "/c"),
]
ODD = [
    "<a href='/c'>", '<a href="a b">', '<a href = "/c">', '<a href="/a" href="/b">', '<a href="/a"href="/b">', '<a href="">',
    '<a href>', '<a hreflang="x" href="/c">', '<a title="href=x" href="/c">', '<a data-href="/no">', '<a x="1"y href="/c">',
    '<a alt="a>b" href="/c">', '<a href=/c/>', '<a/href="/c">', '<a href=="/c">', '<img src="/x" alt="href">', "<title>href</title>",
]
DOTS = [
    "/a/../b", "/a/../b/../c", "/a/./../b", "/../a", "/a/../../b", "//../b", "/.", "/a/..", "/a/../", "/./", "a/../b", "/.../../b",
    "/.a/../..b/./c", "x/a/../b", "..", ".", "", "/", "/a/b", "/a//../../c",
]


def test_plain_tags_are_read_by_one_pattern(evaluate):
    pattern = html.PLAIN_LINK.format("href", html.HREF_TAGS)
    got = evaluate(lambda t: F.regexp_extract(t, pattern, 2), [(t,) for t, _ in TAGS], ["string"])
    assert got == [v or "" for _, v in TAGS]


def test_links_of_plain_and_odd_tags_are_their_attributes(evaluate):
    tags = [t for t, _ in TAGS] + ODD
    for name, names in (("href", html.HREF_TAGS), ("src", html.SRC_TAGS)):
        links = evaluate(lambda t: html._raw_links(F.array(t), name, names), [(t,) for t in tags], ["string"])
        whole = evaluate(lambda t: html.raw_attribute(t, name), [(t,) for t in tags], ["string"])
        carries = [bool(re.match(rf"(?i)<(?:{names})[\s/>]", t)) for t in tags]
        assert links == [[w if c else ""] for w, c in zip(whole, carries, strict=True)]


def folded(path):
    if not re.search(urls.DOT_SEGMENT, path):
        return path
    parts, kept = path.split("/"), []
    for p in parts:
        kept = kept[:-1] if p == ".." else kept if p == "." else [*kept, p]
    return "/".join([*kept, ""] if parts[-1] in (".", "..") else kept)


def test_dot_segments_go_as_by_the_fold(evaluate):
    got = evaluate(urls.remove_dot_segments, [(p,) for p in DOTS], ["string"])
    assert got == [folded(p) for p in DOTS]


def test_null_urls_stay_null(evaluate):
    for part in (urls.url_netloc, urls.url_path, urls.clean_url):
        assert evaluate(part, [(None,)], ["string"]) == [None]
