"""Captured sites, scripts and responses derived from the plain test tables.

The test tables hold HTML pages only. Scripts (from ``part``), linked sites
(from ``region``, ``nation``, ``customer``, ``orders``) and API responses (from
``events``) are written in SQL that Spark and DuckDB both read, so that both
sides of a check see the same input. Every row of a table takes part, so the
inputs grow with it; one site holds a third of everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PARTS_PER_FILE = 12
FANOUT = 8


def _joined(value: str, order: str, dialect: str) -> str:
    """Ordered string aggregation, which the two dialects spell differently."""
    if dialect == "spark":
        return f"listagg({value}, chr(10)) WITHIN GROUP (ORDER BY {order})"
    return f"string_agg({value}, chr(10) ORDER BY {order})"


def js_files_sql(dialect: str) -> str:
    """One script per 12 parts; the shape of each piece depends on the part."""
    nl = "', chr(10), '"
    return f"""
WITH piece AS (
  SELECT CAST(floor(p_partkey / {PARTS_PER_FILE}) AS BIGINT) AS f, p_partkey AS pk, p_size AS k,
         split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2
  FROM part),
line AS (
  SELECT f, pk, CASE pk % 6
    WHEN 0 THEN concat('async function load', pk, '() {{ const res', k, ' = await fetch("item', k,
                       '.php"); return result.', w2, '_', k % 4, '; }}')
    WHEN 1 THEN concat('  apiCall("/abs/', w2, '?id=', pk, '"); // get list')
    WHEN 2 THEN concat('function send', pk, '() {{{nl}  const fd = new ',
                       CASE WHEN f % 3 = 1 THEN 'FormData' ELSE 'Map' END, '();{nl}  fd.append("', w1,
                       '_id", 1); fd.set("', w2, '", 2);{nl}  return fetch("./save', k, '.php", fd);{nl}}}')
    WHEN 3 THEN concat('window.post', pk, ' = function () {{{nl}  prefetch("../v', k % 3,
                       '/./up.php"); x({{ body: "a', k, '=1&b=2" }});{nl}}};')
    WHEN 4 THEN concat('function put', pk, '() {{{nl}  fetch("https://api.example/x/', k,
                       '?z=1"); const p = {{ ', w1, ': 1, method: 2, amount', k, ': 3, user_id: 4 }};{nl}  fetch("/cart/',
                       k % 5, '");{nl}}}')
    ELSE concat('  if (ok) {{ render(data.user', k, ', result.status, response.json(), data.transactions, response.price',
                k % 4, ', response.message); }}', CASE WHEN k % 10 = 0 THEN ' // {{' ELSE '' END)
    END AS txt
  FROM piece),
body AS (SELECT f, {_joined('txt', 'pk', dialect)} AS txt FROM line GROUP BY f)
SELECT concat('shop', CASE WHEN f % 3 = 0 THEN 0 ELSE f % 7 END, '.example') AS domain,
       concat('/js/', CASE WHEN f % 5 = 1 THEN 'sub/' ELSE '' END, 'm', f, '.js') AS path,
       f AS page_id, 200 AS status_code,
       CASE WHEN f % 7 = 0 THEN '' ELSE 'application/javascript' END AS content_type,
       concat(CASE WHEN f % 4 = 1 THEN concat('fetch("top.php"); apiCall(cfg);', chr(10)) ELSE '' END,
              CASE WHEN f % 3 = 0 THEN concat('new URLSearchParams(q);', chr(10)) ELSE '' END,
              CASE WHEN f % 2 = 0 THEN concat('const API_BASE_URL = "',
                CASE f % 6 WHEN 0 THEN '../v1' WHEN 2 THEN '/rest/' ELSE 'https://h.example/v2' END, '";', chr(10))
                ELSE '' END, txt) AS text
FROM body"""


def _child_links() -> str:
    """Links of page j to its children 8j+1 .. 8j+8, each in another notation."""
    child = lambda i: f"({FANOUT} * j + {i}), CASE WHEN ({FANOUT} * j + {i}) % 7 = 0 THEN '/' ELSE '' END"
    up = "CASE WHEN j % 7 = 0 THEN '../' ELSE '' END"
    notations = [
        f"""'<a href="/c/', {child(1)}, '">1</a>'""",
        f"""'<a class=x href="', {up}, {child(2)}, '">2</a>'""",
        f"""'<a href="https://www.r', d, '.example/c/', {child(3)}, '?q=1&amp;z=2#top">3</a>'""",
        f"""'<link rel=next href=//r', d, '.example/c/', {child(4)}, '>'""",
        f"""'<script>window.location.href = "/c/', {child(5)}, '";</script>'""",
        f"""'<iframe src="/c/./', {child(6)}, '"></iframe>'""",
        f"""'<script src="/x/../c/', {child(7)}, '">var a = "<a href=/hidden2>";</script>'""",
        f"""'<a data-href="/hidden3" href="/c/', {child(8)}, ';s=1">8</a>'""",
    ]
    return ", ".join(notations)


def site_pages_sql(dialect: str) -> str:
    """Five linked sites: customers form a tree, orders hang from them, assets from the root."""
    site = "CASE WHEN {0} % 6 < 2 THEN 0 ELSE {0} % 6 - 1 END"
    index = "CAST(CASE WHEN {0} % 6 < 2 THEN floor({0} / 6) * 2 + {0} % 6 ELSE floor({0} / 6) END AS BIGINT)"
    page = "concat('/c/', j, CASE WHEN j % 7 = 0 THEN '/' ELSE '' END)"
    return f"""
WITH cust AS (
  SELECT c_custkey AS c, c_name, c_mktsegment, {site.format('c_custkey')} AS d, {index.format('c_custkey')} AS j
  FROM customer),
cpage AS (
  SELECT c, d, {page} AS path,
    CASE WHEN c % 17 = 9 THEN 500 ELSE 200 END AS status_code,
    CASE WHEN c % 13 = 5 THEN '' WHEN c % 13 = 6 THEN 'text/html; charset=utf-8' ELSE 'text/html' END AS content_type,
    concat('<!DOCTYPE html><html><head>', CASE c % 10 WHEN 3 THEN '' WHEN 4 THEN '<title></title>'
             ELSE concat('<title> ', c_name, ' &amp; ', c_mktsegment, '</title>') END,
           '<link rel=stylesheet href="/style.css"></head><body><!-- <a href="/hidden1"> -->', {_child_links()},
           '<a href="mailto:x@r0.example">m</a><a href="javascript:go()">j</a><a href="#top">t</a>',
           '<a href="https://other.example/x">o</a><img src="/logo.png">',
           '<a href="/o/', 10 * c, '">a</a><a href="/o/', 10 * c + 1, '">b</a></body></html>') AS text
  FROM cust),
ord AS (
  SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, CAST(floor(o_orderkey / 10) AS BIGINT) AS c
  FROM orders),
opage AS (
  SELECT k, s, p, {site.format('c')} AS d, {index.format('c')} AS j FROM ord)
SELECT concat('r', d, '.example') AS domain, path, c * 10 + 3 AS page_id, status_code, content_type, text FROM cpage
UNION ALL
SELECT concat('r', d, '.example'), concat(regexp_replace(path, '/$', ''), CASE WHEN path LIKE '%/' THEN '' ELSE '/' END), c * 10 + 4,
       status_code, content_type, '<title>twin</title>' FROM cpage WHERE c % 11 = 3
UNION ALL
SELECT concat('r', d, '.example'), path, c * 10 + 5, 200, 'text/html', '<title>later copy</title>' FROM cpage
WHERE c % 19 = 4
UNION ALL
SELECT concat('r', d, '.example'), concat('/o/', k), k * 10 + 6, CASE WHEN s = 'O' THEN 404 ELSE 200 END,
       CASE WHEN s = 'F' AND k % 4 = 1 THEN 'application/javascript' WHEN s = 'F' THEN 'application/json' ELSE 'text/html' END,
       CASE WHEN s = 'F' AND k % 4 = 1 THEN concat('function f', k, '() {{', chr(10), '  const r = fetch("../api/o',
                 k % 50, '.php", {{ body: "a=1&b', k % 3, '=2" }});', chr(10), '  use(data.user', k % 3, ');', chr(10), '}}')
            WHEN s = 'F' THEN concat('{{url: "/o/', k + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END, '", id: 1}}')
            ELSE concat('<title>', p, '</title><a href="../c/', j, CASE WHEN j % 7 = 0 THEN '/' ELSE '' END,
                        '">up</a>') END
FROM opage
UNION ALL
SELECT concat('r', n_regionkey, '.example'), concat('/n/', n_nationkey, '/'), n_nationkey * 10 + 2, 200, 'text/html',
       concat('<title>', n_name, '</title><a href="../../">home</a><a href="?page=2">next</a><a href="gone.html">x</a>')
FROM nation
UNION ALL
SELECT concat('r', r_regionkey, '.example'), '/', r_regionkey * 100 + 10, 200, 'text/html',
       concat('<title>', r_name, '</title><a href="/c/0/">c</a><script src="/app.js"></script>',
              '<a href="/n/', r_regionkey, '/">n</a><a href="/data.json">d</a><a href="/about">a</a>') FROM region
UNION ALL
SELECT concat('r', r_regionkey, '.example'), '/style.css', r_regionkey * 100 + 20, 200, 'text/css',
       'a {{ background: x }}' FROM region
UNION ALL
SELECT concat('r', r_regionkey, '.example'), '/logo.png', r_regionkey * 100 + 30, 200, 'image/png', 'PNG' FROM region
UNION ALL
SELECT concat('r', r_regionkey, '.example'), '/app.js', r_regionkey * 100 + 40, 200, 'application/javascript',
       concat('location.assign("/n/', r_regionkey + 5, '/");', chr(10), 'function login() {{ return fetch("login.php"); }}')
FROM region
UNION ALL
SELECT concat('r', r_regionkey, '.example'), '/data.json', r_regionkey * 100 + 50, 200, 'application/json', '[1]'
FROM region
UNION ALL
SELECT concat('r', r_regionkey, '.example'), '/about', r_regionkey * 100 + 60, 301, 'text/html', '' FROM region"""


def responses_sql(dialect: str) -> str:
    """One captured response per event; many answer the same endpoint."""
    return """
SELECT event_id AS response_id,
  concat('shop', CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 7 END, '.example') AS domain,
  CASE event_id % 4 WHEN 0 THEN concat('/v1/item', user_id % 50 + 1, '.php')
    WHEN 1 THEN concat('/api/save', user_id % 50 + 1, '.php')
    WHEN 2 THEN concat('https://shop', CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 7 END, '.example/cart/', user_id % 5)
    ELSE concat('/rest/item', user_id % 50 + 1, '.php') END AS url,
  CASE WHEN event_id % 5 = 0 THEN 'GET' ELSE 'POST' END AS method,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
  CASE WHEN user_id % 9 = 6 THEN 'text/html' WHEN user_id % 9 = 1 THEN 'text/json'
    ELSE 'application/json; charset=utf-8' END AS content_type,
  CASE user_id % 9 WHEN 1 THEN concat('[', props, ',{"z":1}]') WHEN 2 THEN '[]' WHEN 3 THEN '7' WHEN 4 THEN 'null'
    WHEN 5 THEN '{"k": ' WHEN 6 THEN concat('<p>', repeat('"x" ', 80), '</p>') WHEN 7 THEN '{"connection_error":"x"}'
    WHEN 8 THEN '"text"' ELSE props END AS body
FROM events"""


def _run(spark: SparkSession, sf_dir: str, tables: tuple[str, ...], sql: str) -> DataFrame:
    for table in tables:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(sql)


def js_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, ("part",), js_files_sql("spark"))


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, ("region", "nation", "customer", "orders"), site_pages_sql("spark"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, ("events",), responses_sql("spark"))
