import html
import random
import time
from html.parser import HTMLParser

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitespec.functions import html as h
from sitespec.functions import navigation as nav
from sitespec.functions.entities import html_unescape

BATCHED = settings(max_examples=3, deadline=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck))

pieces = st.sampled_from(
    ["&", "&amp;", "&amp", "&AMP", "&notit;", "&copy=1", "&#65;", "&#x41", "&#X1f600;", "&#0;", "&#128;", "&#xD800;",
     "&#1114112;", "&#99999999999;", "&#1;", "&#13;", "&#x7f;", "&#xfffe;", "&nbsp;", "&frac12;", "&foo;", "&#;",
     "&#x;", "&CounterClockwiseContourIntegral;", "&fjlig;", "&acE;", " ", "x", ";", "é", "<", "&middot;", "&lang;",
     "&#0065;", "&ampx;", "&lt&gt", "&Ubrcy;", "&sup", "&sup2", "&sup1x", "&#150;", "&#129;"]
)


@BATCHED
@given(st.lists(st.lists(pieces, max_size=6).map("".join), min_size=300, max_size=400))
def test_unescape_like_stdlib(evaluate, texts):
    got = evaluate(html_unescape, [(t,) for t in texts], ["string"])
    pairs = [(t, g, html.unescape(t)) for t, g in zip(texts, got)]
    assert [p for p in pairs if p[1] != p[2]] == []


class Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.href, self.src = [], []

    def handle_starttag(self, tag, attrs):
        found = {k: v or "" for k, v in attrs}
        if tag in ("a", "link", "script", "img", "iframe") and found.get("href"):
            self.href.append(found["href"])
        if tag in ("script", "img", "iframe", "source") and found.get("src"):
            self.src.append(found["src"])


def _stdlib_links(text):
    parser = Links()
    parser.feed(text)
    parser.close()
    return parser.href, parser.src


markup = st.sampled_from(
    ['<a href="/a">', "<a href='/b'>", "<a href=/c>", "<A HREF = /d >", '<a data-href="/no" href="/e">', "<a href>",
     '<a title="<a href=/no>" href="/f">', "<!-- <a href='/no'> -->", "<script>var x='<a href=/no>';</script>",
     '<script src="/s.js"></script>', '<script src="/t.js"/>', "<style>a{}</style>", '<img src="/i.png" href=/h>',
     "<source src=/v>", "<iframe src='/w'></iframe>", '<link rel=x href="/l.css"/>', "<p>", "</p>", "text", " a < b ",
     '<a href="/one" href="/two">', '<a href="/x?a=1&amp;b=2">', "<area href=/no>", "<abbr href=/no>", "<!doctype html>",
     '<a href="/y"', ">", "<a\nhref='/n\nl'\n>", "<a class=k/href=/z>", "<a/href=/q>", "<a href=/r/>", "</a href=/no>",
     '<script src="/u.js">/* <!-- */</script>', "<!-- <script> -->", "--", "<a href=''>", "<a href=\"it's\">",
     "<a onclick=\"go('/no')\" href=/o>", "<a b='1'href=/p>"]
)


@BATCHED
@given(st.lists(st.lists(markup, max_size=8).map("".join), min_size=300, max_size=400))
def test_links_like_stdlib(evaluate, texts):
    fn = lambda t: F.struct(h.href_links(h.html_tokens(t)).alias("h"), h.src_links(h.html_tokens(t)).alias("s"))
    got = evaluate(fn, [(t,) for t in texts], ["string"])
    # What a comment without end hides depends on the Python version; ours runs to the end of the page.
    closed = [(t, g) for t, g in zip(texts, got) if t.rfind("<!--") <= t.rfind("-->")]
    pairs = [(t, (g["h"], g["s"]), _stdlib_links(t)) for t, g in closed]
    assert [p for p in pairs if p[1] != p[2]] == []


def test_comments_and_scripts(evaluate):
    cases = [("<script>/* <!-- */</script><a href=/k>", ["/k"]), ("<a href=/1><!-- <a href=/2>", ["/1"]),
             ("<!-- <script> --><a href=/3>", ["/3"]), ("<script><a href=/4>", [])]
    assert evaluate(lambda t: h.href_links(h.html_tokens(t)), [(a,) for a, _ in cases], ["string"]) == [b for _, b in cases]


def test_titles(evaluate):
    cases = [
        ("<p>no title</p>", "Untitled Page"), ("<title></title>", "Untitled Page"), ("<title> </title>", ""),
        ("<TITLE lang=en>\n A &amp; B\n</TITLE >", "A & B"), ("<!--<title>x</title>--><title>y</title>", "y"),
        ("<script>'<title>x</title>'</script><title>y</title>", "y"), ("<title>a<b>c</b></title>", "Untitled Page"),
        ("<title>1 < 2</title>", "1 < 2"), ("<title>one</title><title>two</title>", "one"), ("", "Untitled Page"),
    ]
    assert evaluate(h.html_title, [(a,) for a, _ in cases], ["string"]) == [b for _, b in cases]


def test_large_pages_do_not_exhaust_the_stack(evaluate):
    rng = random.Random(1)
    attrs = " ".join(f"a{i}='{rng.random()}'" for i in range(60_000))
    texts = [f"<a {attrs} href='/big'>", "<p>" * 300_000 + "<a href=/end>", "<title>" + "x " * 500_000 + "</title>",
             "<a href=" + "/long" * 200_000 + ">", "<" * 500_000, "&amp;" * 100_000 + "<a href='" + "&lt;" * 1000 + "'>"]
    fn = lambda t: F.struct(h.href_links(h.html_tokens(t)).alias("h"), F.length(h.html_title(t)).alias("t"))
    got = evaluate(fn, [(t,) for t in texts], ["string"])
    assert got[0]["h"] == ["/big"] and got[1]["h"] == ["/end"] and got[2]["t"] == 999_999
    assert len(got[3]["h"][0]) == 1_000_000 and got[5]["h"] == ["<" * 1000]


def test_pages_full_of_openings_stay_linear(evaluate):
    texts = ["<a" * 500_000, "<!--" * 300_000, "</" * 500_000, "<a href=/x " * 100_000, "<script " * 100_000,
             "<script>" * 100_000, "<title>" * 100_000, "location = '" * 50_000, "<a href='/y'>" + "<!" * 400_000]
    fn = lambda t: F.struct(h.href_links(h.html_tokens(t)).alias("h"), h.html_title(t).alias("t"),
                            F.size(nav.js_nav_links(t)).alias("n"))
    start = time.time()
    got = evaluate(fn, [(t,) for t in texts], ["string"])
    assert [g["h"] for g in got] == [[]] * 8 + [["/y"]]
    assert time.time() - start < 60


def test_page_kinds(evaluate):
    fn = lambda c, p: F.array(h.is_html(c, p), h.is_javascript(c, p), h.is_static_asset(c, p))
    cases = [(("", "/x.js"), [True, True, False]), (("text/css", "/s"), [False, False, True]),
             (("text/html", "/x.js"), [True, True, False]), (("application/javascript", "/s"), [False, True, False])]
    assert evaluate(fn, [c for c, _ in cases], ["string"] * 2) == [w for _, w in cases]


def test_nav_links(evaluate):
    cases = [
        ("location = '/dashboard'", ["/dashboard"]), ("window.location.href=\"/settings\"", ["/settings"]),
        ("location.replace( `/r` )", ["/r"]), ("window.location.assign('/s')", ["/s"]), ("{href: '/h'}", ["/h"]),
        ("url : \"/u\"", ["/u"]), ("location='abc'", []), ("location='abcd'", ["abcd"]),
        ("location='http://d/x'", []), ("location='a/b'", ["a/b"]), ("href: 'x/y'", []), ("location = '", []),
        ("location.href = '/multi\nline'", ["/multi\nline"]),
    ]
    assert evaluate(nav.js_nav_links, [(a,) for a, _ in cases], ["string"]) == [b for _, b in cases]
