from urllib.parse import urljoin, urlparse
import os.path
import posixpath

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitespec.functions import paths, urls

BASE = "https://d/a/b"

# One Spark job per example list, so few examples and no shrinking.
BATCHED = settings(max_examples=3, deadline=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck))

JOIN_CASES = [
    ("../../../x", "/x"), ("x//y", "/a/x/y"), ("/x//y", "/x//y"), ("?q=1", "/a/b"), ("", "/a/b"),
    ("..", "/"), ("../", "/"), ("./", "/a/"), ("https://d/a/../b", "/a/../b"), ("x;p", "/a/x"),
    ("//d/z/../q", "/z/../q"), ("https:foo", "/a/foo"), ("/a/b/..", "/a/"), ("/a;p/b;q", "/a;p/b"),
    ("/a//../b", "/a/b"), ("https://d", "/"), ("/x#top", "/x"), ("/sp ace|x", "/sp ace|x"),
]


def test_url_join_goldens(evaluate):
    got = evaluate(lambda l: urls.url_join(F.lit(BASE), l), [(l,) for l, _ in JOIN_CASES], ["string"])
    assert [(l, r["netloc"], r["path"]) for (l, _), r in zip(JOIN_CASES, got)] == [
        (l, "d", p) for l, p in JOIN_CASES
    ]


def test_other_schemes_lose_the_site(evaluate):
    got = evaluate(lambda l: urls.url_join(F.lit(BASE), l), [("mailto:x@d",), ("http://d/x",), ("tel:1",)], ["string"])
    assert [(r["netloc"], r["path"]) for r in got] == [("", "x@d"), ("d", "/x"), ("", "1")]


url_text = st.text(alphabet="ab./;?#:& é|%\t", max_size=14)
links = st.one_of(
    url_text,
    url_text.map(lambda s: "/" + s),
    url_text.map(lambda s: "//d/" + s),
    url_text.map(lambda s: "https://d" + s),
    url_text.map(lambda s: "HTTP://d/" + s),
    url_text.map(lambda s: "ftp:" + s),
)
bases = st.text(alphabet="ab./; ", max_size=8).map(lambda s: "https://d/" + s)


def _stdlib_join(base, link):
    parsed = urlparse(urljoin(base, link))
    return parsed.netloc, parsed.path or "/"


@BATCHED
@given(st.lists(st.tuples(bases, links), min_size=300, max_size=400))
def test_url_join_like_stdlib(evaluate, cases):
    got = evaluate(lambda b, l: urls.url_join(b, l), cases, ["string", "string"])
    pairs = [((b, l), (row["netloc"], row["path"]), _stdlib_join(b, l)) for (b, l), row in zip(cases, got)]
    assert [p for p in pairs if p[1] != p[2]] == []


@BATCHED
@given(st.lists(links, min_size=300, max_size=400))
def test_url_parts_like_stdlib(evaluate, cases):
    fn = lambda u: F.struct(urls.url_netloc(u).alias("n"), urls.url_path(u).alias("p"))
    got = evaluate(fn, [(c,) for c in cases], ["string"])
    for link, row in zip(cases, got):
        assert (row["n"], row["p"]) == (urlparse(link).netloc, urlparse(link).path), link


path_text = st.text(alphabet="ab./", max_size=12)


@BATCHED
@given(st.lists(st.tuples(path_text, path_text), min_size=300, max_size=400))
def test_posix_paths_like_stdlib(evaluate, cases):
    fn = lambda a, b: F.struct(
        paths.posix_dirname(a).alias("d"),
        paths.posix_normpath(a).alias("n"),
        paths.posix_join(a, b).alias("j"),
        urls.url_ext(a).alias("e"),
        urls.url_basename(a).alias("f"),
    )
    got = evaluate(fn, cases, ["string", "string"])
    for (a, b), row in zip(cases, got):
        want = (posixpath.dirname(a), posixpath.normpath(a), posixpath.join(a, b),
                os.path.splitext(a)[1].lower(), posixpath.basename(a))
        assert tuple(row) == want, (a, b)


def test_normpath_goldens(evaluate):
    cases = [("", "."), ("//", "//"), ("///a", "/a"), ("/a/../..", "/"), ("a/../..", ".."), ("//w", "//w")]
    assert evaluate(paths.posix_normpath, [(a,) for a, _ in cases], ["string"]) == [b for _, b in cases]


def test_url_ext_goldens(evaluate):
    cases = [("/.htaccess", ""), ("/a.b/c", ""), ("/x.tar.GZ", ".gz"), ("/..foo.js", ".js"), ("/a.", ".")]
    assert evaluate(urls.url_ext, [(a,) for a, _ in cases], ["string"]) == [b for _, b in cases]


def test_resolve_route_goldens(evaluate):
    cases = [
        ("/js/m.js", "../api", "login.php", "/api/login.php"),
        ("/js/m.js", "../api", "/wallet/fund", "/wallet/fund"),
        ("/js/m.js", "../api", "?x", "/api/"),
        ("/js/m.js", "../api", "https://h/p?q", "/p"),
        ("/js/m.js", "../api", "https://h", ""),
        ("/js/m.js", "https://h/v1", "u", "/api/u"),
        ("/js/m.js", "/v2/", "u#f", "/v2/u#f"),
        ("/m.js", "api", "a/../b", "/api/b"),
    ]
    got = evaluate(paths.resolve_route, [c[:3] for c in cases], ["string"] * 3)
    assert got == [c[3] for c in cases]


def test_domains(evaluate):
    cases = [(" https://example.com/ ", "example.com"), ("http://a.b//", "a.b"), ("HTTP://x", "HTTP://x"),
             ("https://http://a", "a")]
    assert evaluate(urls.clean_domain, [(a,) for a, _ in cases], ["string"]) == [b for _, b in cases]
    got = evaluate(urls.same_domain, [("d", "d"), ("www.d", "d"), ("D", "d"), ("x.d", "d")], ["string"] * 2)
    assert got == [True, True, False, False]


def test_rejects(evaluate):
    cases = [("JavaScript:x", True), ("#a", True), ("/p/${id}", True), ("{{u}}", True), ("/x#a", False)]
    assert evaluate(urls.reject_link, [(a,) for a, _ in cases], ["string"]) == [b for _, b in cases]


def test_full_url(evaluate):
    cases = [("https://d", "/a", "https://d/a"), ("https://d/", "/a", "https://d/a"), ("https://d", "a", "https://d/a"),
             ("https://d/", "a", "https://d/a"), ("https://d", "http://e/x", "http://e/x")]
    assert evaluate(urls.full_url, [c[:2] for c in cases], ["string"] * 2) == [c[2] for c in cases]
