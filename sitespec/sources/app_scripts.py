"""Scripts of web applications derived from ``part``, with what is in them stated beside.

Each part gives one piece of a script, whose shape follows from its key. A piece is written here as plain text with
places for the part's numbers (``@pk@``, ``@k@``); what of it is no code (« »), and the calls in it, are marked and
stated by hand, so that the SQL of a check is no second parser (``@_k@``: as many blanks as ``@k@`` has digits). Every row takes part, and one
site holds a third of the files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

PARTS_PER_FILE = 24


@dataclass(frozen=True)
class Piece:
    """``marked`` is the text, with what is no code between « and ». Facts name the line within the piece, from 1."""

    marked: str
    functions: list[tuple] = field(default_factory=list)  # line, callee, function, depth
    wrapped: list[tuple] = field(default_factory=list)  # line, function, wrapper, route, method, hops
    styles: list[tuple] = field(default_factory=list)  # line, function, style, method, route, keys
    scopes: list[tuple] = field(default_factory=list)  # line, literal, scope
    branches: list[tuple] = field(default_factory=list)  # route, branch, path, kind

    @property
    def text(self) -> str:
        return re.sub("[«»]", "", self.marked)

    @property
    def masked(self) -> str:
        places = lambda m: "".join("@_k@" if c == "@k@" else " " for c in re.findall("@k@|.", m[1]))
        return re.sub("«(.*?)»", places, self.marked)


PIECES = (
    Piece(  # braces in strings, comments and templates
        'function outer@pk@(a) {\n  «// a { comment brace»\n  const s = "«a } string brace»";\n'
        "  const t = `«template ${» 1 + 1 «} literal {»`;\n  «/* block { \"quote */» fetch(\"«/api/outer/@k@»\");\n}",
        functions=[(5, "fetch", "outer@pk@", 1)],
        scopes=[(5, "/api/outer/@k@", '{\n  // a { comment brace\n  const s = "a } string brace";\n'
                 "  const t = `template ${ 1 + 1 } literal {`;\n  /* block { \"quote */ fetch(\"/api/outer/@k@\");\n}")],
    ),
    Piece(  # methods, regular expressions, divisions, templates within templates
        "class Api@pk@ {\n  async inner@k@(id) {\n    const re = /«[/{\"']+»/g; const n = id / 2 / 3;\n"
        "    return await fetch(`«/api/inner/@k@${» id ? `«x${» id «}}»` : \"«}»\" «}/»`);\n  }\n}",
        functions=[(4, "fetch", "inner@k@", 1)],
        scopes=[(4, "/api/inner/@k@${ id ? ", "{\n    const re = /[/{\"']+/g; const n = id / 2 / 3;\n"
                 "    return await fetch(`/api/inner/@k@${ id ? `x${ id }}` : \"}\" }/`);\n  }")],
    ),
    Piece(  # wrappers, wrappers of wrappers, and their uses
        'async function send@pk@(path, body) {\n  return fetch("«/base»" + path, { method: "«POST»", body: JSON.stringify(body) });\n}\n'
        'const load@pk@ = (p) => send@pk@(p);\nload@pk@("«/w/list/@k@»");\nasync function fund@pk@() {\n'
        '  const x = await send@pk@("«/w/fund/@k@»", { amount: 500, "«note»": w });\n}',
        functions=[(2, "fetch", "send@pk@", 1)],
        wrapped=[(5, None, "load@pk@", "/w/list/@k@", "GET", 2), (7, "fund@pk@", "send@pk@", "/w/fund/@k@", "POST", 1)],
        scopes=[(2, "/base", '{\n  return fetch("/base" + path, { method: "POST", body: JSON.stringify(body) });\n}')],
    ),
    Piece(  # a function that the site doesn't define; one of another name that it does
        'async function go@pk@() {\n  const xk9q = await auegj("«/wallet/@k@»", { amount: 500 });\n  if (!xk9q.status) { return; }\n'
        '  await plain@pk@("«/not/a/call»");\n  await label("«no path»");\n}\nfunction plain@pk@(a) { return a; }',
        wrapped=[(2, "go@pk@", "auegj", "/wallet/@k@", "POST", None)],
    ),
    Piece(  # axios
        'axios.get("«/api/ping/@k@»"); axios.post("«/api/save»", { a@pk@: 1, b: { c: 2 } });\n'
        'axios({ url: "«/api/opt/@k@»", method: "«put»", data: { d: 1, e } });\naxios.delete(path);',
        styles=[(1, None, "axios", "GET", "/api/ping/@k@", ""), (1, None, "axios", "POST", "/api/save", "a@pk@,b"),
                (2, None, "axios", "PUT", "/api/opt/@k@", "d,e")],
    ),
    Piece(  # ky and superagent
        'const s@pk@ = () => {\n  ky.post("«/api/status»", {json: {a: 1, "«b-c»": [1, 2]}});\n  superagent.delete("«/api/item/@k@»");\n'
        '  superagent.post("«/api/item»").set("«h»", 1).send({ s: f(1, 2), t: 1 });\n};',
        styles=[(2, "s@pk@", "ky", "POST", "/api/status", "a,b-c"), (3, "s@pk@", "superagent", "DELETE", "/api/item/@k@", ""),
                (4, "s@pk@", "superagent", "POST", "/api/item", "s,t")],
    ),
    Piece(  # jQuery and request objects
        '$.ajax({ url: "«/api/legacy/@k@»", method: "«PUT»", data: JSON.stringify({ q: 1, r: "«,»" }) }); $.getJSON("«/api/all»");\n'
        'function x@pk@() {\n  xhr.open("«GET»", "«/api/data/@k@»"); xhr.send();\n'
        '  xhr.open("«POST»", "«/api/more»"); xhr.send(JSON.stringify({ z: 1, y: 2 }));\n  win.open("«/page»");\n}',
        styles=[(1, None, "jquery_ajax", "PUT", "/api/legacy/@k@", "q,r"), (1, None, "jquery_ajax", "GET", "/api/all", ""),
                (3, "x@pk@", "xhr", "GET", "/api/data/@k@", ""), (4, "x@pk@", "xhr", "POST", "/api/more", "y,z")],
    ),
    Piece(  # calls in comments and strings, functions within functions, arrows
        "«/* fetch(\"/no/@k@\") { */» const str = '«axios.get(\"/no\")»'; «// fetch('/no')»\n"
        'function deep@pk@() { list.forEach(function (x) { fetch("«/deep/»" + x); });\n  const f@k@ = y => fetch("«/arrow/@k@»" + y);\n}',
        functions=[(2, "fetch", "(anonymous)", 2), (3, "fetch", "f@k@", 2)],
        scopes=[(2, "/deep/", '{ fetch("/deep/" + x); }'), (3, "/arrow/@k@", '{ fetch("/deep/" + x); }')],
    ),
    Piece(  # branches of a response
        'async function check@pk@() {\n  const res = await fetch("«/x/@k@»");\n  const data = await res.json();\n'
        "  if (!data.ok) { console.log(data.error); return; }\n  console.log(data.payload.items, data.payload.total@pk@);\n"
        "  data.payload.items.map(i => i.id);\n}",
        functions=[(2, "fetch", "check@pk@", 1)],
        scopes=[(2, "/x/@k@", '{\n  const res = await fetch("/x/@k@");\n  const data = await res.json();\n'
                 "  if (!data.ok) { console.log(data.error); return; }\n  console.log(data.payload.items, data.payload.total@pk@);\n"
                 "  data.payload.items.map(i => i.id);\n}")],
        branches=[("/x/@k@", "error", "error", "unknown"), ("/x/@k@", "success", "payload.items", "objects"),
                  ("/x/@k@", "success", "payload.total@pk@", "unknown")],
    ),
)


def sql_text(value: str | int | None) -> str:
    """A text with places of numbers as an SQL expression that Spark and DuckDB read alike."""
    if value is None:
        return "NULL"
    if isinstance(value, int):
        return str(value)
    out, at = [], 0
    plain: list[str] = []

    def flush() -> None:
        if plain:
            out.append("'" + "".join(plain).replace("'", "''") + "'")
            plain.clear()

    places = {"@pk@": "pk", "@k@": "k", "@_k@": "repeat(' ', length(CAST(k AS STRING)))", "\n": "chr(10)"}
    while at < len(value):
        hit = next((p for p in places if value.startswith(p, at)), None)
        if hit:
            flush()
            out.append(places[hit])
        else:
            plain.append(value[at])
        at += len(hit or "x")
    flush()
    return f"concat({', '.join(out or [repr('')])})"


def _shaped(texts: Iterator[str]) -> str:
    return "CASE " + " ".join(f"WHEN shape = {i} THEN {sql_text(t)}" for i, t in enumerate(texts)) + " END"


def pieces_sql() -> str:
    """(f, domain, path, pk, k, shape, lines): one row per part."""
    lines = "CASE " + " ".join(f"WHEN shape = {i} THEN {p.text.count(chr(10)) + 1}" for i, p in enumerate(PIECES)) + " END"
    return f"""
SELECT *, {lines} AS lines,
       concat('app', CASE WHEN f % 3 = 0 THEN 0 ELSE f % 7 END, '.example') AS domain, concat('/app/a', f, '.js') AS path
FROM (SELECT CAST(floor(p_partkey / {PARTS_PER_FILE}) AS BIGINT) AS f, p_partkey AS pk, p_size AS k, p_partkey % {len(PIECES)} AS shape FROM part) x"""


def scripts_sql(dialect: str, masked: bool = False) -> str:
    """(domain, path, page_id, status_code, content_type, text): one script per ``PARTS_PER_FILE`` parts."""
    text = _shaped(p.masked if masked else p.text for p in PIECES)
    joined = (
        "listagg(txt, chr(10)) WITHIN GROUP (ORDER BY pk)" if dialect == "spark" else "string_agg(txt, chr(10) ORDER BY pk)"
    )
    return f"""
SELECT domain, path, f AS page_id, 200 AS status_code, 'application/javascript' AS content_type, {joined} AS text
FROM (SELECT *, {text} AS txt FROM ({pieces_sql()}) p) t GROUP BY domain, path, f"""


def facts_sql(name: str, columns: tuple[str, ...]) -> str:
    """The stated facts of all pieces as DuckDB SQL, with ``line_no`` in the file for ``line``."""
    rows = []
    for shape, piece in enumerate(PIECES):
        for fact in getattr(piece, name):
            values = ", ".join(f"{sql_text(v)} AS {c}" for c, v in zip(columns, fact, strict=True))
            rows.append(f"SELECT domain, path AS file_path, before, {values} FROM placed WHERE shape = {shape}")
    return f"""
WITH placed AS (
  SELECT *, coalesce(sum(lines) OVER (PARTITION BY f ORDER BY pk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM ({pieces_sql()}) p),
facts AS ({" UNION ALL ".join(rows)})"""


def app_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(scripts_sql("spark").replace("FROM part)", f"FROM parquet.`{sf_dir}/part.parquet`)"))
