"""DuckDB statements of the stand-in tables and of URL rules, used by the SQL check only."""

from __future__ import annotations

NOW = "TIMESTAMP '2001-08-01 12:00:00'"

_RFC = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def stamp(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"


def parts(url: str) -> str:
    return f"regexp_extract({url}, '{_RFC}', ['s','n','p','q'])"


def canonical(prefix: str, source: str, url: str) -> str:
    """CTEs that add column ``nu`` (canonical form of ``url``) to ``source``; result ``<prefix>``."""
    dec = "url_decode(replace({}, '+', ' '))"
    enc = "replace(url_encode({}), '%20', '+')"
    key = dec.format("split_part(x, '=', 1)")
    val = dec.format("CASE WHEN strpos(x, '=') > 0 THEN substr(x, strpos(x, '=') + 1) ELSE '' END")
    return f"""
{prefix}_0 AS (SELECT *, trim({url}) AS _u, {parts(f'trim({url})')} AS _m FROM {source}),
{prefix}_1 AS (SELECT * REPLACE (CASE WHEN _m.n = '' AND _m.p <> '' THEN {parts("'http://' || _u")} ELSE _m END AS _m) FROM {prefix}_0),
{prefix}_2 AS (SELECT *, CASE WHEN _m.s = '' THEN 'http' ELSE lower(_m.s) END AS _s, lower(_m.n) AS _n,
  regexp_replace(_m.p, ';[^/]*$', '') AS _p,
  list_sort(list_transform(list_filter(string_split(_m.q, '&'), lambda x: x <> ''), lambda x: struct_pack(k := {key}, v := {val}))) AS _q
  FROM {prefix}_1),
{prefix} AS (SELECT * EXCLUDE (_u, _m, _s, _n, _p, _q), _s || '://' ||
  CASE WHEN _s = 'http' THEN regexp_replace(_n, ':0*80$', '') WHEN _s = 'https' THEN regexp_replace(_n, ':0*443$', '') ELSE _n END ||
  CASE WHEN _p = '/' THEN _p ELSE rtrim(_p, '/') END ||
  CASE WHEN len(_q) = 0 THEN '' ELSE '?' || array_to_string(list_transform(_q, lambda x: {enc.format('x.k')} || '=' || {enc.format('x.v')}), '&') END AS nu
  FROM {prefix}_2)"""


def host(nu: str) -> str:
    return rf"regexp_extract({nu}, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)"


CANONICAL_PAGES = canonical("cp_all", "pages", "url") + """,
cpages AS (SELECT * FROM cp_all QUALIFY row_number() OVER (PARTITION BY nu ORDER BY page_id) = 1)"""

URLS = CANONICAL_PAGES + f""",
urls AS (SELECT page_id AS id, o_custkey AS job_id, url AS canonical_url, nu AS normalized_url, {host('nu')} AS domain,
  CASE o_orderstatus WHEN 'F' THEN 'parsed' WHEN 'O' THEN 'fetched' WHEN 'P' THEN 'failed' ELSE 'pending' END AS status,
  sha256(html) AS content_hash, page_id % 4 AS depth, o_orderdate AS last_crawled_at, o_orderdate AS created_at
  FROM cpages LEFT JOIN orders ON o_orderkey = page_id)"""

JOBS = """
jobs AS (SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'pending' ELSE 'running' END AS status,
  c_nationkey::BIGINT AS urls_queued, TIMESTAMP '2024-01-01' + to_minutes((c_custkey * 7919) % 100003) AS created_at FROM customer)"""

JOB_URLS = """
job_urls AS (SELECT o_custkey AS job_id, 'https://shop.example.com/' || o_orderkey AS normalized_url,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'claimed' WHEN o_orderstatus = 'F' THEN 'parsed' WHEN o_orderstatus = 'P' THEN 'failed'
       WHEN o_orderpriority = '5-LOW' THEN 'skipped' ELSE 'queued' END AS status, o_orderdate AS updated_at FROM orders)"""

SCHEDULES = """
schedules AS (SELECT s_suppkey AS id, s_name AS name, '*/' || (s_nationkey + 1) || ' * * * *' AS cron_expression,
  s_acctbal > 0 AS enabled, TIMESTAMP '2024-01-01' + to_minutes((s_suppkey * 7919) % 10007) AS created_at FROM supplier)"""

EVENTS = """
ev AS (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)"""

# Visible markup of a page, its text, and the shared pieces of the extraction checks.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def entities(text: str) -> str:
    out = text
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{char}')"
    return out


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_WS}+|{_WS}+$', '', 'g')"


def collapse(text: str, n: int) -> str:
    return f"nullif(substring({strip(f'''regexp_replace({text}, '{_WS}+', ' ', 'g')''')}, 1, {n}), '')"


def markup(source: str = "pages") -> str:
    return rf"""
mk AS (SELECT *, regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', chr(1), 'g') AS m FROM {source})"""


TITLE = (
    "CASE WHEN regexp_matches(m, '(?i)<title[\\s>]') THEN "
    + strip(entities(r"regexp_extract(m, '(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>', 1)")) + " END"
)
LANGUAGE = r"""nullif(regexp_extract(m, '(?is)<html\b[^>]*\slang="([^"]*)"', 1), '')"""
_NODES = rf"regexp_replace(regexp_replace(m, '(?is)<noscript\b[^>]*>.*?</noscript\s*>', chr(1), 'g'), '<[A-Za-z/!?][^>]*>', chr(1), 'g')"
TEXT = (
    "array_to_string(list_filter(list_transform(string_split("
    + entities(_NODES) + ", chr(1)), lambda x: " + strip("x") + "), lambda x: x <> ''), ' ')"
)
SNIPPET = f"nullif(substring({TEXT}, 1, 500), '')"
HREFS = rf"""list_filter(list_transform(regexp_extract_all(m, '(?is)<a\s[^>]*href="([^"]*)"', 1), lambda x: {strip(entities('x'))}),
  lambda x: x <> '' AND NOT (starts_with(x, '#') OR starts_with(x, 'javascript:') OR starts_with(x, 'mailto:') OR starts_with(x, 'tel:')))"""

# All links of the corpus are root-relative: the target is the site of the page plus the path.
LINKS = markup() + rf""",
raw_links AS (SELECT page_id, url, generate_subscripts(h, 1) AS i, unnest(h) AS href FROM (SELECT page_id, url, {HREFS} AS h FROM mk)),
joined_links AS (SELECT *, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS target FROM raw_links),
""" + canonical("nl", "joined_links", "target") + """,
links AS (SELECT page_id, url, nu AS dst, row_number() OVER (PARTITION BY page_id ORDER BY min(i)) - 1 AS pos
  FROM nl WHERE regexp_matches(nu, '^https?://') GROUP BY page_id, url, nu)"""


def trigrams(text: str) -> str:
    return (
        "list_distinct(flatten(list_transform(list_filter(list_distinct(regexp_split_to_array(lower("
        + text + r"), '[^\p{L}\p{N}]+')), lambda w: w <> ''), "
        "lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
    )


def similarity(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) + len({b}) - {shared} > 0 THEN {shared}::DOUBLE / (len({a}) + len({b}) - {shared}) ELSE 0 END)"
