"""The registered queries as DuckDB SQL, written apart from the Spark code."""

from __future__ import annotations

from sitespec.sources.app_scripts import facts_sql, scripts_sql
from sitespec.sources.derived import js_files_sql, responses_sql, site_pages_sql

Q = "[''\"`]"  # a quote of any kind, inside a SQL string
NQ = "[^''\"`]"

SITE = f"site AS ({site_pages_sql('duckdb')})"
JS = f"js AS ({js_files_sql('duckdb')})"
RESP = f"resp AS ({responses_sql('duckdb')})"
# The snapshot table with its domain and path.
SNAP = """snap AS (
  SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain,
         coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path,
         200 AS status_code, 'text/html' AS content_type, html AS text
  FROM pages)"""


def is_html(t: str = "") -> str:
    return f"(contains({t}content_type, 'text/html') OR {t}content_type = '')"


def is_js(t: str = "") -> str:
    return f"(contains({t}content_type, 'javascript') OR {t}path LIKE '%.js')"


def is_asset(t: str = "") -> str:
    return f"(NOT {is_html(t)} AND NOT {is_js(t)})"


def masked(text: str) -> str:
    """Text without comments and script bodies."""
    bare = f"regexp_replace({text}, '<!--.*?-->', '', 'gs')"
    return rf"regexp_replace({bare}, '(<script[^>]*>).*?(</script)', '\1\2', 'gs')"


def decoded(c: str) -> str:
    """The entities that occur in the data."""
    pairs = (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
    for name, value in pairs:
        c = f"replace({c}, '{name}', '{value}')"
    return c


def title(text: str) -> str:
    inner = f"regexp_extract({masked(text)}, '<title[^>]*>(.*?)</title', 1, 's')"
    return f"CASE WHEN {inner} = '' THEN 'Untitled Page' ELSE trim({decoded(inner)}, ' ' || chr(9) || chr(10)) END"


NAV_PATTERNS = (
    rf"location(?:\.href)?\s*=\s*{Q}({NQ}+){Q}",
    rf"location\.replace\(\s*{Q}({NQ}+){Q}\s*\)",
    rf"location\.assign\(\s*{Q}({NQ}+){Q}\s*\)",
    rf"href\s*:\s*{Q}(/{NQ}+){Q}",
    rf"url\s*:\s*{Q}(/{NQ}+){Q}",
)


def nav_ctes(source: str) -> str:
    """``nav``: raw navigation strings of a source."""
    found = " UNION ALL ".join(
        f"SELECT domain, path, page_id, unnest(regexp_extract_all(text, '{p}', 1)) AS link FROM {source}"
        for p in NAV_PATTERNS
    )
    return f"""nav_raw AS ({found}),
nav AS (SELECT * FROM nav_raw WHERE link <> '' AND NOT starts_with(link, 'http')
        AND (contains(link, '.') OR contains(link, '/') OR length(link) > 3))"""


def link_ctes(source: str) -> str:
    """``links``: distinct (page_id, domain, src_path, dst_path) of a source."""
    value = r"""(\"[^\"]*\"|''[^'']*''|[^\s>]+)""".replace('\\"', '"')
    dots = "joined"
    for _ in range(4):
        dots = rf"regexp_replace(regexp_replace({dots}, '/\./', '/'), '/[^/]+/\.\./', '/')"
    return f"""{nav_ctes(source)},
tag AS (SELECT domain, path, page_id,
          unnest(regexp_extract_all({masked('text')}, '<(?:a|link|script|img|iframe|source)\\s[^>]*>')) AS t FROM {source}),
attr AS (
  SELECT domain, path, page_id, regexp_extract(t, '\\shref\\s*=\\s*{value}', 1) AS v FROM tag WHERE NOT starts_with(t, '<source')
  UNION ALL
  SELECT domain, path, page_id, regexp_extract(t, '\\ssrc\\s*=\\s*{value}', 1) FROM tag
  WHERE NOT starts_with(t, '<a') AND NOT starts_with(t, '<link')),
raw AS (
  SELECT domain, path, page_id, {decoded("trim(v, '''\"')")} AS l FROM attr WHERE v <> ''
  UNION ALL SELECT domain, path, page_id, link FROM nav),
kept AS (SELECT domain, path, page_id, trim(l) AS l FROM raw
         WHERE NOT starts_with(lower(trim(l)), 'javascript:') AND NOT starts_with(trim(l), '#')),
split AS (SELECT *, regexp_extract(l, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme,
                 regexp_replace(l, '^[A-Za-z][A-Za-z0-9+.-]*:', '') AS rest FROM kept),
part AS (SELECT *, regexp_extract(rest, '^//([^/?#]*)', 1) AS netloc,
                regexp_extract(rest, '^(?://[^/?#]*)?([^?#]*)', 1) AS p FROM split),
base AS (SELECT *, (netloc <> '' OR scheme NOT IN ('', 'https')) AS absolute,
           CASE WHEN p = '' THEN path WHEN starts_with(p, '/') THEN p
                ELSE regexp_replace(path, '[^/]*$', '') || p END AS joined FROM part),
resolved AS (
  SELECT page_id, domain, path AS src_path,
    CASE WHEN absolute THEN netloc ELSE domain END AS target,
    coalesce(nullif(regexp_replace(CASE WHEN absolute THEN p ELSE {dots} END, ';[^/]*$', ''), ''), '/') AS dst_path
  FROM base),
links AS (SELECT DISTINCT page_id, domain, src_path, dst_path FROM resolved
          WHERE target = domain OR target = 'www.' || domain)"""


def call_ctes(source: str) -> str:
    """``calls``: one row per call line, with scope and everything derived from it."""
    words = "list_sort(list_distinct(list_filter({0}, lambda k: {1})))"
    stop = "('method', 'headers', 'body', 'status', 'mode', 'credentials', 'cache', 'redirect', 'html', 'submit', 'title')"
    blocks = r"regexp_extract_all(scope, 'body\s*:\s*(?:JSON\.stringify)?\s*\{\s*(.*?)\s*\}', 1, 's')"
    literals = r"regexp_extract_all(scope, '(?:const|let|var)\s+[a-zA-Z0-9_]+\s*=\s*\{\s*(.*?)\s*\}', 1, 's')"
    kind = """CASE WHEN contains(lower(k), 'user') THEN 'user' WHEN contains(lower(k), 'transaction') THEN 'transactions'
              WHEN contains(lower(k), 'price') OR contains(lower(k), 'plan') THEN 'empty' ELSE 'unknown' END"""
    return rf"""file AS (
  SELECT domain, path AS file_path, page_id AS crawl_rank, text,
    regexp_replace(path, '/[^/]*$', '') AS folder,
    coalesce(nullif(regexp_extract(text, 'const\s+API_BASE_URL\s*=\s*{Q}({NQ}+){Q}', 1), ''), '../api') AS base,
    CASE WHEN contains(text, 'URLSearchParams') OR contains(text, 'application/x-www-form-urlencoded')
           THEN 'Parameters (application/x-www-form-urlencoded)'
         WHEN contains(text, 'FormData') THEN 'Multipart FormData (multipart/form-data)'
         ELSE 'Raw JSON (application/json)' END AS format,
    {words.format(r"regexp_extract_all(text, '(?:result|data|response)\.([a-zA-Z0-9_]+)', 1)",
                  "k NOT IN ('json', 'ok', 'status_code')")} AS keys
  FROM {source} WHERE {is_js()}),
rooted AS (SELECT *, CASE WHEN starts_with(base, 'http') THEN '/api'
                          WHEN starts_with(base, '/') THEN rtrim(base, '/')
                          WHEN starts_with(base, '../') THEN regexp_replace(folder, '/[^/]*$', '') || base[3:]
                          END AS root FROM file),
line AS (SELECT * EXCLUDE (lines), unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no
         FROM (SELECT *, string_split(text, chr(10)) AS lines FROM rooted)),
lit AS (SELECT *, regexp_extract(line, '(?:apiCall|fetch)\(\s*{Q}({NQ}+){Q}', 1) AS literal FROM line
        WHERE contains(line, 'apiCall') OR contains(line, 'fetch')),
placed AS (SELECT *, strpos(text, literal) AS pos, text[1:strpos(text, literal) - 1] AS head FROM lit WHERE literal <> ''),
opened AS (SELECT *, CASE WHEN contains(head, '{{') THEN length(head) - strpos(reverse(head), '{{') + 1 END AS open_at
           FROM placed),
brace AS (SELECT domain, file_path, p, sum(CASE c WHEN '{{' THEN 1 ELSE -1 END)
              OVER (PARTITION BY domain, file_path ORDER BY p) AS level
          FROM (SELECT domain, file_path, unnest(string_split(text, '')) AS c,
                       generate_subscripts(string_split(text, ''), 1) AS p FROM file) WHERE c IN ('{{', '}}')),
closed AS (SELECT o.domain, o.file_path, o.open_at, min(e.p) AS close_at
           FROM (SELECT DISTINCT domain, file_path, open_at FROM opened) o
           JOIN brace s ON s.domain = o.domain AND s.file_path = o.file_path AND s.p = o.open_at
           JOIN brace e ON e.domain = o.domain AND e.file_path = o.file_path AND e.p > o.open_at AND e.level = s.level - 1
           GROUP BY ALL),
scoped AS (
  SELECT o.*, CASE WHEN o.open_at IS NOT NULL THEN substring(o.text, o.open_at, c.close_at - o.open_at + 1)
    ELSE (string_split(head, chr(10)))[-1] ||
         CASE WHEN contains(substring(o.text, pos), chr(10)) THEN split_part(substring(o.text, pos), chr(10), 1)
              ELSE substring(o.text, pos, length(o.text) - pos) END END AS scope
  FROM opened o LEFT JOIN closed c
    ON c.domain = o.domain AND c.file_path = o.file_path AND c.open_at = o.open_at),
routed AS (
  SELECT *, CASE WHEN literal LIKE 'http%' THEN regexp_extract(literal, '^https?://[^/?#]*([^?#]*)', 1)
    WHEN starts_with(literal, '/') THEN split_part(literal, '?', 1)
    WHEN starts_with(literal, '../') THEN regexp_replace(regexp_replace(root, '/[^/]*$', '') || literal[3:], '/\./', '/')
    WHEN starts_with(literal, './') THEN root || literal[2:]
    ELSE root || '/' || literal END AS url,
    CASE WHEN len({blocks}) > 0 THEN {blocks} ELSE {literals} END AS blocks
  FROM scoped),
calls AS (
  SELECT domain, file_path, crawl_rank, line_no, literal AS endpoint_literal, url,
    CASE WHEN contains(upper(line), 'GET') THEN 'GET' ELSE 'POST' END AS method,
    CASE WHEN regexp_matches(line, '[a-zA-Z0-9_]+\s*=') THEN regexp_extract(line, '([a-zA-Z0-9_]+)\s*=', 1)
         WHEN regexp_matches(line, 'function\s+[a-zA-Z0-9_]') THEN regexp_extract(line, 'function\s+([a-zA-Z0-9_]+)', 1)
         ELSE 'unknown_function' END AS function_purpose,
    format AS expected_payload_format, keys AS response_keys,
    CASE WHEN scope IS NULL THEN CAST([] AS VARCHAR[]) ELSE list_sort(list_distinct(list_concat(
      regexp_extract_all(scope, '\.(?:append|set)\(\s*{Q}([a-zA-Z0-9_-]+){Q}', 1),
      regexp_extract_all(regexp_extract(scope, 'body\s*:\s*{Q}({NQ}+){Q}', 1), '([a-zA-Z0-9_-]+)=', 1),
      list_filter(flatten(list_transform(blocks, lambda b: regexp_extract_all(b, '([a-zA-Z0-9_-]+)\s*:', 1))),
                  lambda k: lower(k) NOT IN {stop})))) END AS payload_keys,
    list_filter(list_transform(keys, lambda k: k || ':' || CASE
        WHEN contains(line, k) OR len(list_filter(string_split(text, chr(10)),
             lambda s: (contains(s, 'result') OR contains(s, 'data')) AND contains(s, k))) > 0 THEN {kind}
        WHEN k IN ('status', 'message') THEN 'string' ELSE '-' END),
      lambda e: NOT e LIKE '%:-') AS schema,
    trim(line, ' ' || chr(9) || chr(13)) AS raw_js_context
  FROM routed)"""


ENDPOINTS = """first_last AS (
  SELECT *, row_number() OVER (PARTITION BY domain, url ORDER BY crawl_rank DESC, line_no DESC) AS back,
    first_value(crawl_rank) OVER w AS first_rank, first_value(line_no) OVER w AS first_line
  FROM calls WINDOW w AS (PARTITION BY domain, url ORDER BY crawl_rank, line_no)),
found AS (SELECT * FROM first_last WHERE back = 1)"""

SAMPLES = """full_resp AS (
  SELECT *, CASE WHEN starts_with(url, 'http') THEN url ELSE 'https://' || domain || url END AS full_url FROM resp),
last_resp AS (
  SELECT * FROM full_resp QUALIFY row_number() OVER (PARTITION BY domain, full_url, method ORDER BY response_id DESC) = 1),
sampled AS (
  SELECT domain, full_url, method, status_code, content_type,
    CASE WHEN contains(content_type, 'application/json') OR contains(content_type, 'text/json') THEN
        CASE WHEN NOT json_valid(body) THEN '{"error":"Failed to parse returned JSON string"}'
             WHEN json_type(body) = 'ARRAY' AND json_array_length(body) > 0
               THEN CAST(json(json_extract(body, '$[0]')) AS VARCHAR)
             ELSE CAST(json(body) AS VARCHAR) END
      ELSE '{"raw_non_json_sample":' || CAST(to_json(substring(body, 1, 200)) AS VARCHAR) || '}' END AS sample
  FROM last_resp),
samples AS (
  SELECT *, CASE WHEN sample[1:1] NOT IN ('{', '[', '"') THEN false
                 WHEN sample[1:1] = '{' THEN NOT list_contains(json_keys(sample), 'connection_error')
                 ELSE NOT contains(sample, 'connection_error') END AS verified
  FROM sampled)"""

VERIFIED = """verified AS (
  SELECT f.*, coalesce(s.verified, false) AS live_verified,
    coalesce(s.verified, false) AND coalesce(s.status_code = 200, false) AS live_ok,
    s.sample AS live_response_sample, s.content_type AS live_content_type,
    40 + CASE WHEN len(payload_keys) > 0 THEN 15 ELSE 0 END + CASE WHEN len(response_keys) > 0 THEN 15 ELSE 0 END
       + CASE WHEN coalesce(s.verified, false) THEN 20 ELSE 0 END AS score
  FROM found f LEFT JOIN samples s ON s.domain = f.domain AND s.method = f.method
    AND s.full_url = CASE WHEN starts_with(f.url, 'http') THEN f.url ELSE 'https://' || f.domain || f.url END)"""


def reasons(live: str) -> str:
    return f"""array_to_string(list_filter([
    'Discovered via static JS analysis (apiCall/fetch call site)',
    CASE WHEN len(payload_keys) > 0 THEN 'Payload keys matched from FormData/JSON body' END,
    CASE WHEN len(response_keys) > 0 THEN 'Success/error branches detected in JS' END,
    CASE WHEN {live} THEN 'Live-verified against server' END], lambda r: r IS NOT NULL), '; ')"""


def ext(path: str) -> str:
    return rf"lower(regexp_extract({path}, '[^/.][^/]*(\.[^./]*)$', 1))"


def local(path: str = "path") -> str:
    """File name of a page of the sites."""
    return f"""CASE WHEN trim({path}, '/') = '' THEN 'index.html'
      WHEN contains(content_type, 'text/html') AND NOT contains((string_split(trim({path}, '/'), '/'))[-1], '.')
        THEN trim({path}, '/') || '/index.html'
      WHEN contains(content_type, 'javascript') AND NOT {path} LIKE '%.js' THEN ltrim({path}, '/') || '.js'
      WHEN contains(content_type, 'css') AND NOT {path} LIKE '%.css' THEN ltrim({path}, '/') || '.css'
      ELSE trim({path}, '/') END"""


def page_routes(source: str, rank: str) -> str:
    return f"""SELECT domain, {rank} AS rank,
  CASE WHEN {is_html()} THEN CASE WHEN path LIKE '%/' THEN path ELSE path || '/' END ELSE path END AS path,
  CASE WHEN {is_html()} THEN 'index.html' ELSE coalesce(nullif((string_split(path, '/'))[-1], ''), path) END AS file,
  CASE WHEN {is_html()} THEN 'html' WHEN {ext('path')} = '' THEN 'unknown' ELSE ltrim({ext('path')}, '.') END AS type,
  CASE WHEN {is_html()} THEN '.html' ELSE {ext('path')} END AS format,
  CASE WHEN {is_html()} THEN title END AS title FROM {source}"""


# The good pages of the sites and all scripts, one row per key, and their routes with those of the endpoints.
SITE_ROUTES = f"""everything AS (
  SELECT domain, path, page_id, content_type, text FROM site WHERE status_code = 200
  UNION ALL SELECT domain, path, page_id, content_type, text FROM js),
uniq AS (SELECT *, {title('text')} AS title FROM everything
         QUALIFY row_number() OVER (PARTITION BY domain, path ORDER BY page_id) = 1),
unordered AS (
  SELECT 0 AS section, 0 AS line_no, * FROM ({page_routes('uniq', 'page_id')})
  UNION ALL
  SELECT 1, first_line, domain, first_rank, url,
    coalesce(nullif((string_split(url, '/'))[-1], ''), 'index.php'), 'json',
    coalesce(nullif({ext('url')}, ''), '.php'), NULL FROM found),
routes AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY section, rank, line_no, path) AS ordinal,
                  count(*) OVER (PARTITION BY domain) AS size FROM unordered)"""


def crawl_ctes(depth: int = 24) -> str:
    """``walked``: (domain, path, depth) of every path tried; ``crawl``: the good ones, ranked."""
    return f"""up AS (SELECT * FROM site QUALIFY row_number() OVER (PARTITION BY domain, path ORDER BY page_id) = 1),
good AS (SELECT * FROM up WHERE status_code = 200),
{link_ctes('good')},
edge AS (SELECT DISTINCT domain, src_path, dst_path FROM links),
walk(domain, path, depth) AS (
  SELECT DISTINCT domain, '/', 0 FROM site
  UNION
  SELECT e.domain, e.dst_path, w.depth + 1 FROM walk w
  JOIN edge e ON e.domain = w.domain AND e.src_path = w.path WHERE w.depth < {depth}),
walked AS (SELECT domain, path, min(depth) AS depth FROM walk GROUP BY ALL),
crawl AS (SELECT w.domain, w.path, w.depth,
            row_number() OVER (PARTITION BY w.domain ORDER BY w.depth, w.path) AS crawl_rank
          FROM walked w JOIN good g ON g.domain = w.domain AND g.path = w.path)"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n"


def json_(c: str) -> str:
    return f"CAST(to_json({c}) AS VARCHAR)"


SCHEMA_JSON = """'{' || array_to_string(list_transform(schema, lambda e: '"' || split_part(e, ':', 1) || '":' ||
  CASE split_part(e, ':', 2)
    WHEN 'user' THEN '{"id":"TYPE_NUMBER","name":"TYPE_STRING","email":"TYPE_STRING","token":"TYPE_STRING"}'
    WHEN 'transactions' THEN '[{"id":"TYPE_NUMBER","reference":"TYPE_STRING","amount":"TYPE_NUMBER","status":"TYPE_STRING"}]'
    WHEN 'empty' THEN '{}' WHEN 'string' THEN '"TYPE_STRING"' ELSE '"TYPE_UNKNOWN_DETERMINED_BY_JS"' END), ',') || '}'"""

SPEC_JSON = f"""'{{"function_purpose":' || {json_('function_purpose')} || ',"method":' || {json_('method')}
  || ',"expected_payload_format":' || {json_('expected_payload_format')}
  || ',"guessed_payload_keys":' || {json_('payload_keys')} || ',"js_response_reading_keys":' || {json_('response_keys')}
  || ',"extracted_response_schema_from_js":' || {SCHEMA_JSON} || ',"raw_js_context":' || {json_('raw_js_context')}
  || ',"live_verified":' || live_verified || ',"live_response_sample":' || coalesce(live_response_sample, 'null')
  || ',"confidence":{{"score":' || score || ',"reasons":' || {json_(f"string_split({reasons('live_verified')}, '; ')")} || '}}}}'"""

ROUTE_JSON = f"""'{{"path":' || {json_('path')} || ',"file":' || {json_('file')} || ',"type":' || {json_('type')}
  || ',"format":' || {json_('format')}"""
ROUTE_SHORT = f"{ROUTE_JSON} || CASE WHEN title IS NULL THEN '' ELSE ',\"title\":' || {json_('title')} END || '}}'"
ROUTE_LONG = f"{ROUTE_JSON} || ',\"title\":' || coalesce({json_('title')}, 'null') || '}}'"

NUMBERED = """numbered AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY first_rank, first_line, url) AS n,
  count(*) OVER (PARTITION BY domain) AS size FROM verified)"""

TREE = """tree_item AS (
  SELECT domain, 1 AS section, path, section AS s, rank, line_no, title FROM routes WHERE type <> 'json'
  UNION ALL
  SELECT DISTINCT domain, 4, path, 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR) FROM routes WHERE type = 'json'),
tree_numbered AS (SELECT *, row_number() OVER (PARTITION BY domain, section ORDER BY path, s, rank, line_no) AS n,
                    count(*) OVER (PARTITION BY domain, section) AS size FROM tree_item),
site_domain AS (SELECT DISTINCT domain FROM routes),
tree AS (
  SELECT domain, section, n AS line_no, CASE WHEN n = size THEN '└── ' ELSE '├── ' END || path ||
    CASE WHEN coalesce(title, '') <> '' THEN '  📌 (' || title || ')' ELSE '' END AS line FROM tree_numbered
  UNION ALL SELECT domain, 0, 1, '📂 ' || domain || ' (Enterprise Frontend Map Layout)' FROM site_domain
  UNION ALL SELECT domain, 2, 1, '' FROM site_domain
  UNION ALL SELECT domain, 3, 1, '⚙️ Simulated Backend API Endpoint Tree' FROM site_domain
  UNION ALL SELECT domain, 4, 1, '└── [No API Endpoints Captured]' FROM site_domain
    WHERE domain NOT IN (SELECT domain FROM routes WHERE type = 'json'))"""

WARNED = """warned AS (SELECT domain, url AS path, 'api' AS stage,
  'response cannot be checked: ' || live_response_sample AS message FROM verified
  WHERE live_response_sample[1:1] NOT IN ('{', '[', '"'))"""

COUNTS = f"""counts AS (
  SELECT domain, sum(p) AS pages_crawled, sum(h) AS html_titles, sum(p + e) AS routes, sum(e) AS endpoints,
         sum(v) AS endpoints_verified, sum(a) AS assets_saved, sum(w) AS warnings
  FROM (SELECT domain, 1 AS p, CAST({is_html()} AS INT) AS h, 0 AS e, 0 AS v, CAST({is_asset()} AS INT) AS a, 0 AS w FROM uniq
        UNION ALL SELECT domain, 0, 0, 1, CAST(live_verified AS INT), 0, 0 FROM verified
        UNION ALL SELECT domain, 0, 0, 0, 0, 0, 1 FROM warned) GROUP BY domain)"""

COUNT_COLUMNS = ", ".join(
    f"CAST({c} AS BIGINT) AS {c}" for c in
    ("pages_crawled", "html_titles", "routes", "endpoints", "endpoints_verified", "assets_saved", "warnings")
)

CALLS = with_(JS, call_ctes("js"))
FOUND = with_(JS, call_ctes("js"), ENDPOINTS)
LIVE = with_(JS, call_ctes("js"), ENDPOINTS, RESP, SAMPLES, VERIFIED)
ROUTED = with_(SITE, JS, call_ctes("js"), ENDPOINTS, SITE_ROUTES)
REPORT = with_(SITE, JS, call_ctes("js"), ENDPOINTS, RESP, SAMPLES, VERIFIED, NUMBERED, SITE_ROUTES, WARNED, COUNTS)
CRAWL = with_(SITE, crawl_ctes(), recursive=True)

ACTIONS = ("api", "assets", "crawler", "explorer", "html", "javascript", "routes")


def _entries(source: str, section: int, text: str, n: str = "n") -> str:
    return f"""SELECT domain, CAST({section} AS INT) AS section, CAST({n} AS BIGINT) AS line_no,
  {text} || CASE WHEN {n} < size THEN ',' ELSE '' END AS line FROM {source}"""


def _fixed(source: str, section: int, text: str) -> str:
    return f"SELECT DISTINCT domain, CAST({section} AS INT) AS section, CAST(1 AS BIGINT) AS line_no, {text} AS line FROM {source}"


def _lines(*parts: str) -> str:
    return "\nUNION ALL\n".join(parts)


SPEC_ENTRY = f"{json_('url')} || ':' || {SPEC_JSON}"
NOTED = "stage || ': ' || path || ': ' || message"
WARN_NUMBERED = """warn_numbered AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY stage, path, message) AS n,
  count(*) OVER (PARTITION BY domain) AS size FROM warned)"""
TREE_ORDERED = """tree_ordered AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY section, line_no) AS n,
  count(*) OVER (PARTITION BY domain) AS size FROM tree)"""


def _markdown() -> str:
    head = [
        "'# Inspection Report -- ' || domain", "''", "'- Pages crawled: ' || pages_crawled",
        "'- Routes discovered: ' || routes", "'- API endpoints reconstructed: ' || endpoints",
        "'- Static assets: ' || assets_saved", f"'- Actions run: {', '.join(ACTIONS)}'", "''", "'## API Spec'", "''",
    ]
    body = [
        "'### `' || method || ' ' || url || '`'", "'- Purpose: ' || function_purpose",
        "'- Payload format: ' || expected_payload_format", "'- Confidence: ' || score", "''",
    ]
    parts = [
        f"SELECT domain, 0 AS section, CAST({i + 1} AS BIGINT) AS line_no, {t} AS line FROM counts" for i, t in enumerate(head)
    ] + [
        f"SELECT domain, 1, CAST((n - 1) * 5 + {i + 1} AS BIGINT), {t} FROM numbered" for i, t in enumerate(body)
    ] + [
        "SELECT DISTINCT domain, 2, CAST(1 AS BIGINT), '## Warnings' FROM warned",
        f"SELECT domain, 3, CAST(n AS BIGINT), '- ' || {NOTED} FROM warn_numbered",
    ]
    return _lines(*parts)


def _report_json() -> str:
    actions = "[" + ",".join(f'"{a}"' for a in ACTIONS) + "]"
    d = json_("domain")
    return _lines(
        _fixed("counts", 0, f"""'{{"domain":' || {d} || ',"actions_run":{actions},"pages_crawled":' || pages_crawled || ',"api_spec":{{'"""),
        _entries("numbered", 1, SPEC_ENTRY),
        _fixed("counts", 2, "'},\"routes\":['"),
        _entries("routes", 3, ROUTE_LONG, "ordinal"),
        _fixed("counts", 4, f"""'],"explorer":{{"domain":' || {d} || ',"website_routes":['"""),
        _entries("routes", 5, ROUTE_SHORT, "ordinal"),
        _fixed("counts", 6, "']},\"explorer_visual\":['"),
        _entries("tree_ordered", 7, json_("line")),
        _fixed("counts", 8, """'],"assets_saved":' || assets_saved || ',"warnings":['"""),
        _entries("warn_numbered", 9, json_(NOTED)),
        _fixed("counts", 10, "']}'"),
    )


# Endpoints of the crawled scripts, for the two queries that inspect whole sites.
def _inspected(budget: int) -> str:
    reached = f"""reached AS (
  SELECT g.domain, g.path, c.crawl_rank AS page_id, g.content_type, g.text FROM crawl c
  JOIN good g ON g.domain = c.domain AND g.path = c.path WHERE c.crawl_rank <= {budget})"""
    return with_(SITE, crawl_ctes(), reached, call_ctes("reached"), ENDPOINTS, recursive=True)


def stated(name: str, *columns: str) -> str:
    """What the pieces of the application scripts state, with the line within the file."""
    rest = ", ".join(columns)
    return f"{facts_sql(name, ('line', *columns))} SELECT domain, file_path, (before + line)::INTEGER AS line_no, {rest} FROM facts"


ORACLES: dict[str, str] = {
    "masked_scripts": f"SELECT domain, path AS file_path, text AS masked FROM ({scripts_sql('duckdb', masked=True)})",
    "masked_scopes": stated("scopes", "endpoint_literal", "scope"),
    "call_functions": stated("functions", "callee", "function", "depth"),
    "wrapper_calls": stated("wrapped", "function", "wrapper", "route", "method", "hops"),
    "call_styles": stated("styles", "function", "style", "method", "route", "keys"),
    "page_titles": with_(SNAP) + f"SELECT page_id, {title('text')} AS title FROM snap",
    "site_titles": with_(SITE) + f"SELECT page_id, CASE WHEN {is_html()} THEN {title('text')} END AS title FROM site",
    "link_edges": with_(SNAP, link_ctes("snap")) + "SELECT page_id, domain, src_path, dst_path FROM links",
    "site_links": with_(SITE, link_ctes("site")) + "SELECT page_id, domain, src_path, dst_path FROM links",
    "discovered_links": with_(SNAP, link_ctes("snap"))
    + """SELECT s.page_id, coalesce(string_agg(l.dst_path, ',' ORDER BY l.dst_path), '') AS paths
FROM snap s LEFT JOIN links l ON l.page_id = s.page_id GROUP BY s.page_id""",
    "links_per_domain": with_(SNAP, link_ctes("snap"))
    + """SELECT domain, count(*) AS pages, CAST(sum(n) AS BIGINT) AS links, count(*) FILTER (n = 0) AS pages_without_links
FROM (SELECT s.domain, s.page_id, count(l.dst_path) AS n FROM snap s LEFT JOIN links l ON l.page_id = s.page_id GROUP BY ALL)
GROUP BY domain""",
    "js_nav_links": with_(
        SITE, JS, "both_ AS (SELECT domain, path, page_id, text FROM site UNION ALL SELECT domain, path, page_id, text FROM js)",
        nav_ctes("both_"),
    ) + "SELECT domain, page_id, link FROM nav",
    "page_kinds": with_(SITE)
    + f"SELECT page_id, {is_html()} AS is_html, {is_js()} AS is_javascript, {is_asset()} AS is_static_asset FROM site",
    "asset_counts": with_(SITE) + f"SELECT domain, count(*) FILTER ({is_asset()}) AS assets_saved FROM site GROUP BY domain",
    "status_counts": with_(SITE)
    + "SELECT domain, CASE WHEN status_code = 200 THEN 'ok' ELSE 'skipped' END AS kind, count(*) AS n FROM site GROUP BY ALL",
    "url_parts": with_(SNAP)
    + rf"""SELECT page_id, domain AS netloc, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS url_path,
{ext('path')} AS ext, (string_split(path, '/'))[-1] AS basename,
CASE WHEN regexp_matches(path, '^/[^/]*$') THEN '/' ELSE regexp_replace(path, '/+[^/]*$', '') END AS dirname,
rtrim(regexp_replace(url, '^https?://', ''), '/') AS cleaned FROM snap""",
    "page_routes": with_(SITE, f"titled AS (SELECT *, {title('text')} AS title FROM site)")
    + f"SELECT rank AS page_id, domain, path, file, type, format, title FROM ({page_routes('titled', 'page_id')})",
    "local_paths": with_(SITE) + f"SELECT page_id, {local()} AS local_path FROM site",
    "clone_manifest": with_(SITE)
    + f"""SELECT domain, local_path, path, crawl_rank FROM (SELECT domain, path, page_id AS crawl_rank, {local()} AS local_path FROM site)
QUALIFY row_number() OVER (PARTITION BY domain, local_path ORDER BY crawl_rank DESC) = 1""",
    "clone_sizes": with_(SITE)
    + f"""SELECT domain, count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS characters FROM (
SELECT * FROM (SELECT *, {local()} AS lp FROM site QUALIFY row_number() OVER (PARTITION BY domain, path ORDER BY page_id) = 1)
QUALIFY row_number() OVER (PARTITION BY domain, lp ORDER BY page_id DESC) = 1) GROUP BY domain""",
    "clone_on_disk": with_(SITE)
    + f""", kept AS (
SELECT * FROM (SELECT *, {local()} AS lp FROM site QUALIFY row_number() OVER (PARTITION BY domain, path ORDER BY page_id) = 1)
QUALIFY row_number() OVER (PARTITION BY domain, lp ORDER BY page_id DESC) = 1),
folders AS (SELECT DISTINCT domain, regexp_extract(lp, '^(.*)/[^/]*$', 1) || '/' AS folder FROM kept WHERE contains(lp, '/')),
above AS (SELECT DISTINCT k.domain, k.lp FROM kept k JOIN folders o ON o.domain = k.domain AND starts_with(o.folder, k.lp || '/'))
SELECT kept.domain, kept.lp || CASE WHEN above.lp IS NULL THEN '' ELSE '/this.page' END AS file,
  octet_length(encode(text)) AS bytes, md5(text) AS md5
FROM kept LEFT JOIN above ON above.domain = kept.domain AND above.lp = kept.lp""",
    "decoded_bytes": """SELECT page_id, CAST(length(t) AS INT) AS characters, md5(t) AS md5 FROM (
SELECT page_id, substr(coalesce(html, ''), 1, page_id % 40) || chr(65533) || substr(coalesce(html, ''), page_id % 40 + 1) AS t
FROM pages)""",
    "script_facts": CALLS
    + "SELECT crawl_rank AS page_id, base, format, root, array_to_string(keys, ',') AS response_keys FROM rooted",
    "call_sites": CALLS
    + """SELECT domain, file_path, CAST(line_no AS INT) AS line_no, endpoint_literal, method, function_purpose,
expected_payload_format, raw_js_context FROM calls""",
    "resolved_routes": CALLS + "SELECT domain, file_path, CAST(line_no AS INT) AS line_no, endpoint_literal, url FROM calls",
    "payload_keys": CALLS
    + "SELECT domain, file_path, CAST(line_no AS INT) AS line_no, array_to_string(payload_keys, ',') AS payload_keys FROM calls",
    "response_schema": CALLS
    + "SELECT domain, file_path, CAST(line_no AS INT) AS line_no, array_to_string(schema, ',') AS schema FROM calls",
    "api_candidates": FOUND
    + """SELECT domain, url, method, function_purpose, raw_js_context, first_rank AS crawl_rank,
CAST(first_line AS INT) AS line_no, array_to_string(payload_keys, ',') AS payload_keys FROM found""",
    "endpoint_confidence": FOUND
    + f"""SELECT domain, url, method, CAST(40 + CASE WHEN len(payload_keys) > 0 THEN 15 ELSE 0 END
+ CASE WHEN len(response_keys) > 0 THEN 15 ELSE 0 END AS INT) AS score, {reasons('false')} AS reasons FROM found""",
    "mock_payloads": FOUND
    + """SELECT domain, url, 'https://' || domain || url AS full_url, method,
CASE WHEN method = 'POST' THEN '{' || array_to_string(list_transform(payload_keys, lambda k: '"' || k || '":' ||
  CASE WHEN regexp_matches(lower(k), 'id|number|bvn|nin') THEN '"1234567890"'
       WHEN regexp_matches(lower(k), 'amount|price|balance') THEN '1000' ELSE '"test_data"' END), ',') || '}'
ELSE '{}' END AS payload FROM found""",
    "response_samples": with_(RESP, SAMPLES)
    + "SELECT domain, full_url, method, CAST(status_code AS INT) AS status_code, sample, verified FROM samples",
    "verify_endpoints": LIVE
    + """SELECT domain, url, method, live_verified, live_ok, live_response_sample, live_content_type,
CAST(score AS INT) AS score FROM verified""",
    "verify_warnings": with_(JS, call_ctes("js"), ENDPOINTS, RESP, SAMPLES, VERIFIED, WARNED)
    + "SELECT domain, path, stage, message FROM warned",
    "crawl_full": CRAWL + "SELECT domain, path, CAST(depth AS INT) AS depth, crawl_rank FROM crawl",
    "crawl_budget": CRAWL
    + "SELECT domain, path, CAST(depth AS INT) AS depth, crawl_rank FROM crawl WHERE crawl_rank <= 100",
    "crawl_depth": CRAWL + "SELECT domain, path, CAST(depth AS INT) AS depth, crawl_rank FROM crawl WHERE depth <= 3",
    "crawl_skipped": CRAWL
    + """SELECT w.domain, w.path, CAST(w.depth AS INT) AS depth, CAST(u.status_code AS INT) AS status_code FROM walked w
LEFT JOIN up u ON u.domain = w.domain AND u.path = w.path WHERE coalesce(u.status_code, 0) <> 200""",
    "crawl_skipped_budget": CRAWL
    + """SELECT w.domain, w.path, CAST(w.depth AS INT) AS depth, CAST(u.status_code AS INT) AS status_code FROM walked w
LEFT JOIN up u ON u.domain = w.domain AND u.path = w.path
LEFT JOIN (SELECT domain, depth AS last_depth, path AS last_path FROM crawl WHERE crawl_rank = 20) f ON f.domain = w.domain
WHERE coalesce(u.status_code, 0) <> 200
  AND (f.domain IS NULL OR w.depth < f.last_depth OR (w.depth = f.last_depth AND w.path < f.last_path))""",
    "all_routes": ROUTED + "SELECT domain, path, file, type, format, title, ordinal FROM routes",
    "explorer_tree": with_(SITE, JS, call_ctes("js"), ENDPOINTS, SITE_ROUTES, TREE)
    + "SELECT domain, CAST(section AS INT) AS section, CAST(line_no AS BIGINT) AS line_no, line FROM tree",
    "explorer_json": ROUTED
    + _lines(
        _fixed("routes", 0, f"""'{{"domain":' || {json_('domain')} || ',"website_routes":['"""),
        _entries("routes", 1, ROUTE_SHORT, "ordinal"),
        _fixed("routes", 2, "']}'"),
    ),
    "api_spec_json": with_(JS, call_ctes("js"), ENDPOINTS, RESP, SAMPLES, VERIFIED, NUMBERED)
    + _lines(_fixed("numbered", 0, "'{'"), _entries("numbered", 1, SPEC_ENTRY), _fixed("numbered", 2, "'}'")),
    "site_summary": REPORT + f"SELECT domain, {COUNT_COLUMNS} FROM counts",
    "report_markdown": REPORT.rstrip() + ",\n" + WARN_NUMBERED + "\n" + _markdown(),
    "report_json": REPORT.rstrip() + ",\n" + ",\n".join((WARN_NUMBERED, TREE, TREE_ORDERED)) + "\n" + _report_json(),
    "inspect_summary": _inspected(500)
    + f"""SELECT domain, CAST(sum(p) AS BIGINT) AS pages_crawled, CAST(sum(h) AS BIGINT) AS html_titles,
CAST(sum(p + e) AS BIGINT) AS routes, CAST(sum(e) AS BIGINT) AS endpoints, CAST(0 AS BIGINT) AS endpoints_verified,
CAST(sum(a) AS BIGINT) AS assets_saved, CAST(0 AS BIGINT) AS warnings
FROM (SELECT domain, 1 AS p, CAST({is_html()} AS INT) AS h, 0 AS e, CAST({is_asset()} AS INT) AS a FROM reached
      UNION ALL SELECT domain, 0, 0, 1, 0 FROM found) GROUP BY domain""",
    "inspect_endpoints": _inspected(100)
    + f"""SELECT domain, url, method, function_purpose, array_to_string(payload_keys, ',') AS payload_keys,
{SCHEMA_JSON} AS schema, CAST(40 + CASE WHEN len(payload_keys) > 0 THEN 15 ELSE 0 END
+ CASE WHEN len(response_keys) > 0 THEN 15 ELSE 0 END AS INT) AS score FROM found""",
}
