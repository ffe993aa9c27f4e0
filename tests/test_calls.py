import random
import re
import time

import pytest

from sitespec.functions.lexing import bracket_events, masked_js
from sitespec.operators import calls as ops
from sitespec.sources import as_pages

COLUMNS = "domain string, path string, page_id long, status_code int, content_type string, text string"


def lexed(js):
    """The same mask, character by character."""
    out, i, mode, stack, depth, code = [], 0, "code", [], 0, ""
    regex_before = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%~^<>]|(?<![\w$.])(?:return|typeof|in))$", re.A)
    while i < len(js):
        c, two = js[i], js[i : i + 2]
        blank = "\n" if c == "\n" else " "
        if mode == "code":
            if c in "\"'`":
                mode = c
                out.append(c)
                i += 1
            elif two == "//":
                end = js.find("\n", i)
                end = len(js) if end < 0 else end
                out.append(" " * (end - i))
                i = end
            elif two == "/*":
                end = js.find("*/", i + 2)
                end = len(js) if end < 0 else end + 2
                out.append(re.sub("[^\n]", " ", js[i:end]))
                i = end
            elif c == "/" and regex_before.search(code.rstrip(" \t\r\n")):
                out.append(c)
                i += 1
                within = False
                while i < len(js) and js[i] != "\n":
                    if js[i] == "\\" and js[i + 1 : i + 2] not in ("", "\n"):
                        out.append("  ")
                        i += 2
                        continue
                    if js[i] == "/" and not within:
                        out.append("/")
                        i += 1
                        break
                    within = {"[": True, "]": False}.get(js[i], within)
                    out.append(" ")
                    i += 1
                code += "/"
                continue
            else:
                if c == "}" and stack and stack[-1] == depth:
                    stack.pop()
                    mode = "`"
                    out.append(" ")
                else:
                    depth += {"{": 1, "}": -1}.get(c, 0)
                    out.append(c)
                code += c
                i += 1
            continue
        if c == "\\" and i + 1 < len(js):
            out.append(" " + ("\n" if js[i + 1] == "\n" else " "))
            i += 2
            # only the first character behind a backslash is its own
        elif c == mode:
            out.append(c)
            code += c
            mode = "code"
            i += 1
        elif mode != "`" and c == "\n":
            out.append(c)
            mode = "code"
            i += 1
        elif mode == "`" and two == "${":
            out.append("  ")
            stack.append(depth)
            code += "{"
            mode = "code"
            i += 2
        else:
            out.append(blank)
            i += 1
    return "".join(out)


def test_mask_is_that_of_a_lexer(evaluate):
    rng = random.Random(8)
    bits = ['"', "'", "`", "${", "}", "{", "/", "*", "//", "/*", "*/", "\\", "\n", "a", " ", "= ", "(", ")", "[", "]", "return ", "é", "$"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 40))) for _ in range(1500)]
    texts += ["", "plain", "/*/ a /*/ b", "a /* x **/ '1'", "x = a / b / c", "r = /[/]\\//.test('}')", "`${`${`a`}`}`", "'a\\\nb' c"]
    got = evaluate(masked_js, [(t,) for t in texts], ["string"])
    for text, masked in zip(texts, got, strict=True):
        # An escaped ``${`` is one token, and its brace is text either way.
        assert masked == lexed(text), text
    assert evaluate(masked_js, [(None,)], ["string"]) == [None]


def events(evaluate, *texts):
    return evaluate(lambda t: bracket_events(masked_js(t)), [(t,) for t in texts], ["string"])


def test_functions_around_calls(evaluate):
    text = """
    export async function outer(id) {
        return await fetch('/api/outer/' + id);
    }
    class Api {
        async inner() {
            if (a) { for (const b of c) { return await fetch('/api/inner'); } }
        }
        get total() { return fetch(`t`); }
    }
    const o = { go: async (a, b) => { fetch(a); }, run: function (x) { fetch(x); }, name(x) { fetch(x); } };
    const f = x => y => fetch(x + y), g = () => fetch("g")
    fetch("top")
    """
    found = [(e["fn"] and e["fn"]["name"], e["fn"] and e["fn"]["depth"]) for e in events(evaluate, text)[0] if e["name"] == "fetch"]
    assert found == [("outer", 1), ("inner", 1), ("total", 1), ("go", 1), ("run", 1), ("name", 1), ("(anonymous)", 1), ("g", 1), (None, None)]


def test_braces_in_strings_and_comments_do_not_count(evaluate):
    text = 'function outer() {\n  // a { comment\n  const s = "a } string"; const t = `template ${ 1 + 1 } }`;\n  return 1;\n}'
    got = events(evaluate, text)[0]
    assert [(e["kind"], e["name"], text[e["start"] : e["end"] + 1][-2:]) for e in got] == [("function", "outer", "\n}")]


def test_odd_scripts(evaluate):
    assert events(evaluate, "", None, ")}((", "f(", "}{", "a)b", "f(\n)") [:6] == [[], [], [], [], [], []]
    call = events(evaluate, "x.y?.z(\n1)")[0][0]
    assert (call["name"], call["line"], call["start"], call["end"]) == ("x.y?.z", 1, 6, 9)


def pages(spark, *texts):
    rows = [(d, f"/js/{i}.js", i, 200, "application/javascript", t) for i, (d, t) in enumerate(texts)]
    return as_pages(spark.createDataFrame(rows, COLUMNS))


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def test_wrappers_over_files(spark):
    base = "function a1(m, url, body) { return fetch(url, body); }\nconst a2 = (u, b) => a1('GET', `${u}?x`, b);"
    more = "function a3(b, u) { if (b) { a2('/v/' + u, { x: b }); } }\nfunction loop1(u) { loop2(u); }\nfunction loop2(u) { loop1(u); }"
    uses = "a1('m', '/one'); a2('/two', data); a3({ q: 1 }, '/three'); a3(null, other); loop1('/no'); api.a2('/dotted', fn());"
    site, other = "s.example", "t.example"
    calls = ops.code_calls(pages(spark, (site, base), (site, more), (site, uses), (other, "a1('/elsewhere', '/four'); await zz('/five', {}); await a1;")))
    assert rows(ops.wrappers(calls), "domain", "wrapper", "url_arg", "body_arg", "hops") == [
        (site, "a1", 1, 2, 1), (site, "a2", 0, 1, 2), (site, "a3", 1, 0, 3),
    ]
    assert rows(ops.wrapper_calls(calls), "domain", "wrapper", "route", "method", "hops") == [
        (site, "a1", "/one", "GET", 1), (site, "a2", "/dotted", "GET", 2), (site, "a2", "/two", "POST", 2),
        (site, "a3", "/three", "POST", 3), (other, "zz", "/five", "POST", None),
    ]


def test_library_calls(spark):
    text = """
    axios.get("/api/ping"); ky.post("/api/status", {json: {a: 1}}); superagent.delete("/api/item/1");
    $.ajax({ url: "/api/legacy", method: "PUT" }); xhr.open("GET", "/api/data");
    axios("/api/o", { method: 'patch', data }); jQuery.post('/api/p', { "k-1": ',', [x]: 2, ...rest, m() {} });
    a.open("POST", "/1"); b.open("POST", "/2"); b.send({ b }); a.send({ a: { c: 1 } }); a.open("PUT", "/3"); c.send({ c });
    ky(url); axios.get(); xhr.open("x", "/no"); "axios.get('/string')"; // axios.get('/comment')
    """
    got = rows(ops.call_styles(ops.code_calls(pages(spark, ("d.example", text)))), "style", "method", "route", "keys")
    assert got == sorted([
        ("axios", "GET", "/api/ping", []), ("ky", "POST", "/api/status", ["a"]), ("superagent", "DELETE", "/api/item/1", []),
        ("jquery_ajax", "PUT", "/api/legacy", []), ("xhr", "GET", "/api/data", []), ("axios", "PATCH", "/api/o", []),
        ("jquery_ajax", "POST", "/api/p", ["k-1"]), ("xhr", "POST", "/1", ["a"]), ("xhr", "POST", "/2", ["b"]), ("xhr", "PUT", "/3", []),
    ], key=repr)


def test_empty_table(spark):
    none = ops.code_calls(pages(spark, ("d.example", "x")).limit(0))
    assert ops.wrapper_calls(none).collect() == ops.call_styles(none).collect() == ops.call_functions(none).collect() == []


@pytest.mark.parametrize("n", [4_000])
def test_long_scripts_stay_linear(evaluate, n):
    text = "function f(a) { if (x) { y('str{', /re/g, `t${a}`); } // c\n }\n"

    def seconds(times):
        start = time.time()
        assert len(events(evaluate, text * times)[0]) == 2 * times
        return time.time() - start

    seconds(1)
    assert seconds(4 * n) < 8 * seconds(n) + 5


def test_scripts_are_gone_over_once_and_left_behind(spark):
    text = "function f(a, b) {\n  g(`,${1}`, [1, 2], h(a));\n}"
    calls = ops.code_calls(pages(spark, ("d.example", text)))
    plan = calls._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan  # a fold copies its state at every token
    exploded = plan[: plan.index("Generate")]
    assert "masked_js" not in exploded and "text#" not in exploded  # no call carries its script
    got = {r.name: (r.parameters, r.arguments and [tuple(a) for a in r.arguments]) for r in calls.collect()}
    assert got == {
        "f": (["a", "b"], None), "h": (["a", "b"], [("a", "a")]),
        "g": (["a", "b"], [("`,${1}`", "`   1 `"), (" [1, 2]", " [1, 2]"), (" h(a)", " h(a)")]),
    }
