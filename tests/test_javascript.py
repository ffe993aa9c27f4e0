import time

from pyspark.sql import functions as F

from sitespec.functions import javascript as js
from sitespec.functions.paths import route_root


def check(evaluate, fn, cases, types=("string",)):
    args = [c[0] if isinstance(c[0], tuple) else (c[0],) for c in cases]
    assert evaluate(fn, args, list(types)) == [c[1] for c in cases]


def test_base_and_format(evaluate):
    check(evaluate, js.api_base_url, [("const API_BASE_URL = '/v1'", "/v1"), ("let x", "../api"),
                                      ("const  API_BASE_URL='a';const API_BASE_URL='b'", "a")])
    check(evaluate, js.payload_format, [
        ("new FormData(); new URLSearchParams()", js.FORM_FORMAT), ("new FormData()", js.MULTIPART_FORMAT),
        ("x", js.JSON_FORMAT), ("'application/x-www-form-urlencoded'", js.FORM_FORMAT)])


def test_line_functions(evaluate):
    check(evaluate, js.http_method, [("getUser", "GET"), ("widget", "GET"), ("fetch('/a')", "POST")])
    check(evaluate, js.function_purpose, [
        ("const res = await fetch('x')", "res"), ("fetch('/a?id=1')", "id"), ("function go(){ fetch('x') }", "go"),
        ("fetch('x')", "unknown_function"), ("window.load = () => fetch('x')", "load"), ("window.a.b = fetch('x')", "b"),
        ("if (a == b) fetch('x')", "a")])
    check(evaluate, js.endpoint_literal, [("apiCall(  \"/a\")", "/a"), ("prefetch('/p')", "/p"), ("fetch(url)", ""),
                                          ("fetch('/1'); fetch('/2')", "/1"), ("fetch(`/t/${id}`)", "/t/${id}")])
    check(evaluate, js.raw_js_context, [("\t fetch('x');\r", "fetch('x');")])
    check(evaluate, js.call_line, [("prefetch", True), ("apiCall", True), ("Fetch", False)])


def test_enclosing_scope(evaluate):
    far = "{" + "a" * 10_000 + "{b}" + "c" * 5_000 + "}"
    cases = [
        (("f(){ x; fetch() } y", 12), "{ x; fetch() }"),
        (("f(){ x; ", 7), None),
        (("a\nfetch(1)\nb", 3), "fetch(1)"),
        (("a\nfetch(1)", 3), "fetch(1"),
        (("{a} fetch", 5), "{a}"),
        (("{a{b} fetch {c}}", 7), "{b}"),
        (("'{' fetch }", 5), "{' fetch }"),
        (("{" + "x" * 9_000 + "{y}z}", 5), "{" + "x" * 9_000 + "{y}z}"),
        ((far, 3), far),
        (("{" + "x" * 9_000, 5), None),
        (("é{ü fetch} ", 5), "{ü fetch}"),
    ]
    check(evaluate, js.enclosing_scope, cases, ("string", "int"))


def test_payload_keys(evaluate):
    check(evaluate, js.payload_keys, [
        ("fd.append('a',1); p.set(\"b-c\", 2)", ["a", "b-c"]), ("body: 'x=1&y=2', body: 'z=3'", ["x", "y"]),
        ("body: {k: 1, Method: 2}", ["k"]), ("body: JSON.stringify({k:1})", []), ("body: JSON.stringify{k:1}", ["k"]),
        ("const p = {k: 1, method: 2, url: 3}", ["k", "url"]), ("const p = {q: 1}; body: {k: {n: 2}, m: 3}", ["k", "n"]),
        ("let a = {x: 1}; var b = {\n y : 2,\n x: 1}", ["x", "y"]), (None, []), ("", [])])
    check(evaluate, lambda c: js.payload_keys(c, True), [("body: JSON.stringify({k:1})", ["k"])])


def test_response_keys_and_schema(evaluate):
    check(evaluate, js.response_keys, [
        ("result.b; data.a; response.json(); response.data.x; data.a", ["a", "b", "data"]), ("x", [])])
    text = ("result.userInfo;\ndata.transactions\ndata.price; result.myPlan\ndata.foo\nresponse.bar\n"
            "response.status\nresponse.message\nfetch('x')")
    fn = lambda t, l: F.transform(
        js.response_schema(js.response_keys(t), js.reading_text(js.js_lines(t)), l),
        lambda e: F.concat(e.key, F.lit(":"), e.kind))
    want = ["foo:unknown", "message:string", "myPlan:empty", "price:empty", "status:string",
            "transactions:transactions", "userInfo:user"]
    check(evaluate, fn, [((text, "fetch('x')"), want),
                         ((text, "fetch('/bar/status')"), ["bar:unknown", *want[:-3], "status:unknown", *want[-2:]])],
          ("string", "string"))


def sites(t):
    lines = js.js_lines(t)
    root = route_root(F.lit("/js/m.js"), js.api_base_url(t))
    return js.call_site_array(t, root, lines, js.response_keys(t), js.reading_text(lines))


def test_call_sites(evaluate):
    text = ("const API_BASE_URL = '../v1';\nasync function login() {\n\n"
            "  const r = await fetch('login.php');\n  const p = {user: 1, pin: 2};\n  return result.user;\n}\n// fetch nothing\nprefetch('login.php?get=1')")
    got = evaluate(sites, [(text,), ("",), (None,), ("no calls",)], ["string"])
    assert [(r["line_no"], r["url"], r["method"], r["function_purpose"], r["guessed_payload_keys"]) for r in got[0]] == [
        (4, "/v1/login.php", "POST", "r", ["pin", "user"]),
        (9, "/v1/login.php", "GET", "get", []),
    ]
    assert [(e["key"], e["kind"]) for e in got[0][0]["response_schema"]] == [("user", "user")]
    assert [g or [] for g in got[1:]] == [[], [], []]


def test_scope_uses_first_occurrence_of_the_literal(evaluate):
    text = "{ var u = {a: 1}; 'x.php' }\n{ var w = {b: 1}; fetch('x.php') }"
    got = evaluate(sites, [(text,)], ["string"])
    # Both braces before the first occurrence are closed or open in turn: the nearest one is "{a: 1}".
    assert got[0][0]["guessed_payload_keys"] == []


def test_large_scripts_stay_linear(evaluate):
    many = "function f(){\n" + "if (x) { y(); }\n" * 60_000 + "fetch('/a');\n}"
    blob = "var z = {" + "A" * 1_000_000 + "};fetch('/b')"
    blanks = "function g(){ fetch('/c', {body: {k:" + " " * 500_000 + "1}}) }"
    start = time.time()
    got = evaluate(sites, [(many,), (blob,), (blanks,)], ["string"])
    assert [s[0]["url"] for s in got] == ["/a", "/b", "/c"]
    assert got[2][0]["guessed_payload_keys"] == ["k"]
    assert time.time() - start < 60
