"""DuckDB SQL for the engine's own queries, written apart from the Column expressions."""

from __future__ import annotations

import re

from . import fixtures as fx

ORACLES: dict[str, str] = {}

HOSTNAME = r"nullif(lower(regexp_extract({u}, '^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1, 'i')), '')"
ROOT = "regexp_replace(" + HOSTNAME + r", '^www\.', '')"


def host(u: str) -> str:
    return HOSTNAME.format(u=u)


def root(u: str) -> str:
    return ROOT.format(u=u)


def decoded(s: str) -> str:
    """url_decode fails on malformed escapes, so those stay."""
    return f"coalesce(CASE WHEN regexp_matches({s}, '%(?:[^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') THEN {s} END, url_decode({s}))"


def safe(s: str) -> str:
    return rf"regexp_replace(regexp_replace({s}, '[\x{{10000}}-\x{{10FFFF}}]', '__', 'g'), '[^A-Za-z0-9._-]', '_', 'g')"


def hash8(s: str) -> str:
    return f"substr(sha256({s}), 1, 8)"


def marked(name: str, mark: str) -> str:
    return rf"regexp_replace({name}, '^(.+?)(\.[^.]*)?$', '\1' || {mark} || '\2')"


def segment(s: str) -> str:
    plain = decoded(s)
    form = safe(plain)
    return f"CASE WHEN length({form}) > 100 THEN substr({form}, 1, 91) || '_' || {hash8(s)} WHEN {form} = {plain} THEN {form} ELSE {marked(form, chr(39) + '_h' + chr(39) + ' || ' + hash8(plain))} END"


def host_segment(s: str) -> str:
    form = safe(decoded(s))
    return f"CASE WHEN length({form}) > 100 THEN substr({form}, 1, 91) || '_' || {hash8(s)} ELSE {form} END"


def extension(name: str) -> str:
    return rf"lower(substr(regexp_extract({name}, '^.+(\.[^.]*)$', 1), 2))"


def mapped(source: str, name: str = "mapped") -> str:
    """CTEs that give `name`(url, kind, path) for a relation of (url, kind)."""
    return rf"""
{name}_a AS (SELECT DISTINCT url, kind, regexp_extract(url, '^https?://([^/?#]*)', 1) AS h, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS p,
  regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS q FROM {source}),
{name}_b AS (SELECT *, list_transform(list_filter(string_split(p, '/'), lambda s: s <> ''), lambda s: {segment('s')}) AS names, p = '' OR ends_with(p, '/') AS folder FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN folder THEN 'index.html' WHEN kind = 'asset' OR {extension('names[-1]')} IN ('html', 'htm') THEN names[-1] ELSE names[-1] || '.html' END AS file FROM {name}_b),
{name} AS (SELECT url, kind, array_to_string(list_concat(CASE WHEN kind = 'asset' THEN ['_assets'] ELSE [] END, [{host_segment('h')}],
  CASE WHEN folder THEN names ELSE names[:-2] END,
  [CASE WHEN length(q) > 1 THEN {marked('file', chr(39) + '_q' + chr(39) + ' || ' + hash8('substr(q, 2)'))} ELSE file END]), '/') AS path FROM {name}_c)"""


def encoded(path: str) -> str:
    return f"array_to_string(list_transform(string_split({path}, '/'), lambda s: replace(url_encode(s), '%2C', ',')), '/')"


#: Links of pages: all of them are root-relative a[href].
LINKS = rf"""
own AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS src_url, html FROM pages),
raw_refs AS (SELECT src_url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<!--.*?-->', '', 'g'), '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["'']([^"''>]*)["'']', 1)) AS raw_ref FROM own),
resolved AS (SELECT src_url, raw_ref, regexp_extract(src_url, '^(https?://[^/?#]*)', 1) || {encoded("regexp_replace(raw_ref, '#.*$', '')")} AS abs_url FROM raw_refs),
kinds AS (SELECT *, {extension("regexp_extract(abs_url, '([^/]*)$', 1)")} AS ext FROM resolved),
links AS (SELECT src_url, abs_url, min(raw_ref) AS raw_ref, CASE WHEN ext IN ('', 'html', 'htm', 'xhtml', 'php', 'asp', 'aspx', 'jsp', 'cfm', 'shtml') THEN 'page' ELSE 'asset' END AS kind
  FROM kinds WHERE {root('src_url')} = {root('abs_url')} GROUP BY src_url, abs_url, ext)"""

PAGE_URL = rf"regexp_replace(url, '#.*$', '')"

ORACLES["flagship"] = f"""
WITH {LINKS}, targets AS (SELECT DISTINCT abs_url AS url, kind FROM links), {mapped('targets')},
rows_ AS (SELECT l.*, m.path, EXISTS (SELECT 1 FROM own o WHERE o.src_url = l.abs_url) AS there, {host('l.src_url')} AS host
  FROM links l JOIN mapped m ON m.url = l.abs_url AND m.kind = l.kind)
SELECT host, kind, CASE WHEN there THEN 'localized' ELSE 'absolutized' END AS action, count(*) AS links, count(DISTINCT abs_url) AS targets, min(path) AS first_path
FROM rows_ GROUP BY ALL"""

ORACLES["url_normalize"] = f"SELECT page_id, {PAGE_URL} AS normalized, {host('url')} AS host FROM pages"

_H = root("url")
ORACLES["scope_filter"] = f"""
SELECT url, root, coalesce({_H} = root OR ends_with({_H}, '.' || root), false) AS with_sub, coalesce({_H} = root, false) AS without_sub
FROM (SELECT * FROM {fx.values(fx.SCOPE, 'url, root')} UNION ALL SELECT url, root FROM pages, {fx.values([(r,) for r in ("example.com", "example.net", "example.org", "www.example.com", "com")], 'root')})"""
ORACLES["scope_filter_pages"] = f"SELECT page_id, url FROM pages, (SELECT min({_H}) AS r FROM pages WHERE page_id = 0) WHERE {_H} = r OR ends_with({_H}, '.' || r)"

ORACLES["exclude_gate"] = f"""
SELECT name, page_id FROM pages, {fx.values(fx.EXCLUDES, 'name, pattern')} AS e
WHERE pattern IS NOT NULL AND pattern <> '' AND contains(lower(url), lower(pattern))"""

ORACLES["depth_gate"] = """
WITH e AS (SELECT event_id, CAST(event_id % 7 + 1 AS INTEGER) AS depth, CASE WHEN user_id % 5 < 4 THEN CAST(user_id % 5 AS INTEGER) END AS most FROM events)
SELECT event_id, depth, most, coalesce(most, 0) = 0 OR depth <= most AS inside FROM e"""

ORACLES["url_to_path_page"] = f"""
WITH {LINKS}, src AS (SELECT abs_url AS url, 'page' AS kind FROM links WHERE kind = 'page' UNION SELECT src_url, 'page' FROM own), {mapped('src')}
SELECT url, path FROM mapped"""
ORACLES["url_to_path_asset"] = f"WITH src AS (SELECT {PAGE_URL} AS url, 'asset' AS kind FROM pages), {mapped('src')} SELECT url, path FROM mapped"

ORACLES["segment_sanitize"] = f"WITH {LINKS}, s AS (SELECT * FROM {fx.values(fx.SEGMENTS, 'seg')} UNION SELECT unnest(list_filter(string_split(regexp_extract(abs_url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) FROM links) SELECT seg, {host_segment('seg')} AS host_form, {segment('seg')} AS path_form, {extension('seg')} AS ext FROM s"

ORACLES["path_collisions"] = f"""
WITH {LINKS}, base AS (SELECT src_url AS url FROM own UNION SELECT abs_url FROM links),
src AS (SELECT url, 'page' AS kind FROM base UNION SELECT CASE WHEN starts_with(url, 'https:') THEN 'http:' || substr(url, 7) ELSE 'https:' || substr(url, 6) END, 'page' FROM base), {mapped('src')}
SELECT path, count(DISTINCT url) AS urls, min(url) AS first_url, max(url) AS last_url FROM mapped GROUP BY path HAVING count(DISTINCT url) > 1"""

_REL = """
CASE WHEN true THEN repeat('../', len(a) - 1 - k) || array_to_string(b[k + 1:], '/') END"""
ORACLES["relative_ref"] = f"""
WITH {LINKS}, src AS (SELECT src_url AS url, 'page' AS kind FROM own UNION SELECT abs_url, kind FROM links), {mapped('src')},
pairs AS (SELECT DISTINCT s.path AS source, t.path AS target FROM links l JOIN mapped s ON s.url = l.src_url AND s.kind = 'page' JOIN mapped t ON t.url = l.abs_url AND t.kind = l.kind
  UNION ALL SELECT * FROM {fx.values(fx.PATH_PAIRS, 'source, target')}),
cut AS (SELECT *, string_split(source, '/') AS a, string_split(target, '/') AS b FROM pairs),
same AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b))), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b)) - 1) AS k FROM cut)
SELECT source, target, {_REL} AS ref FROM same"""

ORACLES["extract_links"] = ORACLES["extract_links_exact"] = f"WITH {LINKS} SELECT src_url, abs_url, kind FROM links"



def resolved(ref: str, base: str) -> str:
    """A reference of the fixtures against a base: no query-only ones, one .. at most."""
    plain = f"regexp_replace(trim({ref}), '#.*$', '')"
    origin, folder = f"regexp_extract({base}, '^(https?://[^/?#]*)', 1)", f"regexp_extract({base}, '^(https?://[^/?#]*(?:/[^/?#]*)*/)', 1)"
    whole = f"CASE WHEN regexp_matches({plain}, '^(?i)https?:') THEN lower(regexp_extract({plain}, '^([A-Za-z]+://[^/?#]*)', 1)) || regexp_replace({plain}, '^[A-Za-z]+://[^/?#]*', '') WHEN starts_with({plain}, '//') THEN regexp_extract({base}, '^([a-z]+:)', 1) || {plain} WHEN starts_with({plain}, '/') THEN {origin} || {plain} WHEN regexp_matches({plain}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL ELSE {folder} || {plain} END"
    return rf"regexp_replace(regexp_replace({whole}, '/[^/.]+/\.\./', '/'), '(://[^/]*)(/\.\.)+/', '\1/')"


#: What the helper above leaves out: nothing but a query or a fragment, backslashes, dots, ports, an origin alone, characters to encode.
_FULL = f"""
CASE WHEN plain = '' THEN regexp_replace(base, '#.*$', '') WHEN starts_with(plain, '?') THEN regexp_extract(base, '^([^?#]*)', 1) || plain
  ELSE regexp_replace(regexp_replace(regexp_replace({resolved('plain', 'base')}, '^http://([^/]*):80/', 'http://\\1/'), '/[.]/', '/'), '^(https?://[^/?#]*)$', '\\1/') END"""
ORACLES["url_resolve_cases"] = f"""
WITH c AS (SELECT ref, base, replace(regexp_replace(ref, '#.*$', ''), chr(92), '/') AS plain FROM {fx.spread_sql(fx.NORMALIZE, 'ref, base')})
SELECT ref, base, CASE WHEN contains(plain, '[') THEN NULL ELSE regexp_replace(replace(replace({_FULL}, ' ', '%20'), 'ü', '%C3%BC'), '[.]/$', '') END AS resolved FROM c"""


def attribute(name: str) -> str:
    value = lambda k: f"regexp_extract(t, '(?i)\\s{name}\\s*=\\s*(?:''([^'']*)''|\"([^\"]*)\"|([^\\s>]+))', {k})"
    return f"({value(1)} || {value(2)} || {value(3)})"


_URLS = r"list_filter(list_transform(regexp_extract_all({css}, '(?i)url\(\s*[''\"]?([^''\")]+?)\s*[''\"]?\s*\)', 1), lambda r: trim(r)), lambda r: NOT starts_with(r, 'data:'))"
_MARKUP = rf"""
pages_ AS (SELECT url, regexp_replace(html, '(?is)<textarea>.*?</textarea>', '') AS h FROM {fx.spread_sql(fx.MARKUP, 'url, html')}),
tags AS (SELECT url, unnest(regexp_extract_all(h, '<[a-z]+[^>]*>')) AS t FROM pages_),
parts AS (SELECT url, t, regexp_extract(t, '^<([a-z]+)', 1) AS tag FROM tags),
bases AS (SELECT p.url, coalesce((SELECT min({resolved(attribute('href'), 'q.url')}) FROM parts q WHERE q.url = p.url AND tag = 'base'), p.url) AS base_url FROM pages_ p),
found AS (
  SELECT url, 'a' AS source, {attribute('href')} AS ref FROM parts WHERE tag = 'a' UNION ALL SELECT url, 'iframe', {attribute('src')} FROM parts WHERE tag = 'iframe'
  UNION ALL SELECT url, 'other', {attribute('src')} FROM parts WHERE tag IN ('img', 'script', 'source', 'video', 'audio', 'track', 'embed')
  UNION ALL SELECT url, 'other', {attribute('poster')} FROM parts WHERE tag = 'video' UNION ALL SELECT url, 'other', {attribute('data')} FROM parts WHERE tag = 'object'
  UNION ALL SELECT url, 'other', {attribute('href')} FROM parts WHERE tag = 'link' AND (lower(trim({attribute('rel')})) = 'shortcut icon' OR len(list_filter(string_split(lower({attribute('rel')}), ' '), lambda r: r IN ('stylesheet', 'icon', 'preload', 'prefetch', 'manifest', 'mask-icon', 'apple-touch-icon'))) > 0)
  UNION ALL SELECT url, 'other', regexp_extract(trim(unnest(string_split({attribute('srcset')}, ','))), '^(\S+)', 1) FROM parts WHERE tag IN ('img', 'source')
  UNION ALL SELECT url, 'other', unnest({_URLS.format(css=attribute('style'))}) FROM parts
  UNION ALL SELECT url, 'other', unnest({_URLS.format(css="array_to_string(regexp_extract_all(h, '(?is)<style>(.*?)</style>', 1), ' ')")}) FROM pages_),
absolute AS (SELECT f.url AS src_url, source, {resolved('ref', 'base_url')} AS abs_url FROM found f JOIN bases b ON b.url = f.url WHERE ref <> '')"""
ORACLES["extract_assets"] = f"""
WITH {_MARKUP}, judged AS (SELECT *, {root('src_url')} = {root('abs_url')} AS inside, {extension("regexp_extract(abs_url, '^https?://[^/?#]*[^?#]*?([^/?#]*)(?:[?]|$)', 1)")} AS ext FROM absolute WHERE abs_url IS NOT NULL),
kinds AS (SELECT src_url, abs_url, CASE source WHEN 'a' THEN CASE WHEN inside THEN CASE WHEN ext IN ('', 'html', 'htm', 'xhtml', 'php', 'asp', 'aspx', 'jsp', 'cfm', 'shtml') THEN 'page' ELSE 'asset' END END
  WHEN 'iframe' THEN CASE WHEN inside THEN 'page' END ELSE 'asset' END AS kind FROM judged)
SELECT DISTINCT src_url, abs_url, kind FROM kinds WHERE kind IS NOT NULL"""
ORACLES["effective_base"] = f"WITH {_MARKUP} SELECT url, base_url FROM bases"
ORACLES["inert_refs"] = f"""
WITH {LINKS}, refs AS (SELECT o.page_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<!--.*?-->', '', 'g'), '(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*["'']([^"''>]*)["'']', 1)) AS ref FROM own o
  UNION ALL SELECT page_id, ref FROM {fx.spread_sql(fx.INERT, 'ref')})
SELECT page_id, ref, regexp_matches(trim(lower(ref)), '^($|#|(data|mailto|tel|javascript|blob|about):)') AS inert FROM refs"""
ORACLES["display_forms"] = """
WITH e AS (SELECT event_id, event_id * event_id * 37 AS n, event_id * event_id * 37 // 1000 AS s FROM events)
SELECT event_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n * 10 / 1024.0 + 0.5) / 10) WHEN n < 1073741824 THEN printf('%.1f MB', floor(n * 10 / 1048576.0 + 0.5) / 10) ELSE printf('%.1f GB', floor(n * 10 / 1073741824.0 + 0.5) / 10) END AS size,
  CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm ' || (s % 60) || 's' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS duration FROM e"""

_SHEET_REFS = rf"""
sheets AS (SELECT * FROM {fx.spread_sql(fx.SHEETS, 'url, css')}),
called AS (SELECT url, css, unnest({_URLS.format(css='css')}) AS ref FROM sheets UNION SELECT url, css, unnest(regexp_extract_all(css, '(?i)@import\s+(?:url\(\s*)?[''"]([^''"]+)[''"]', 1)) FROM sheets),
refs AS (SELECT url, css, ref, {resolved('ref', 'url')} AS abs_url FROM called)"""
ORACLES["css_refs"] = f"WITH {_SHEET_REFS} SELECT DISTINCT url AS src_url, abs_url FROM refs"
ORACLES["safe_names"] = r"""
WITH n AS (SELECT page_id, url, url || '  a:b*' || chr(9) || '?' || repeat(' long|name', (page_id % 15)::INT) AS name FROM pages),
t AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(name, '[<>:"/\\|?*]', '_', 'g'), '\s+', ' ', 'g')) AS f, trim(regexp_replace(regexp_replace(name, '[<>:"/\\|?*]', '-', 'g'), '\s+', ' ', 'g')) AS d,
  coalesce(nullif(url_decode(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/')[-1]), ''), 'document') AS last FROM n)
SELECT page_id, trim(substr(f, 1, 120)) || '.html' AS file, d AS folder, printf('%04d', page_id + 1) || '_' || regexp_replace(last, '[<>:"/\\|?*]', '_', 'g') || CASE WHEN lower(last) LIKE '%.pdf' THEN '' ELSE '.pdf' END AS numbered,
  printf('%04d', page_id + 1) || '_' || CASE WHEN page_id % 2 = 0 THEN 'Re_port_.PDF' ELSE regexp_replace(last, '[<>:"/\\|?*]', '_', 'g') || CASE WHEN lower(last) LIKE '%.pdf' THEN '' ELSE '.pdf' END END AS suggested FROM t"""

_CANDIDATES = r"""
parts AS (SELECT page_id, value, list_filter(list_transform(string_split(value, ','), lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g')), lambda c: c <> '') AS cs FROM {v})"""
ORACLES["srcset_parse"] = f"""
WITH {_CANDIDATES.format(v=fx.spread_sql(fx.SRCSETS, 'value'))}, flat AS (SELECT page_id, value, unnest(range(0, len(cs))) AS pos, unnest(cs) AS c FROM parts)
SELECT page_id, value, CAST(pos AS BIGINT) AS pos, regexp_extract(c, '^(\\S+)', 1) AS url, regexp_replace(regexp_extract(c, '^\\S+(.*)$', 1), '^\\s+', '') AS descriptor FROM flat"""
ORACLES["srcset_rewrite"] = f"""
WITH {_CANDIDATES.format(v=fx.spread_sql(fx.SRCSETS, 'value'))}
SELECT page_id, value, array_to_string(list_transform(cs, lambda c: CASE regexp_extract(c, '^(\\S+)', 1) WHEN 'a.png' THEN 'local/a.png' WHEN 'only.png' THEN '../only.png' ELSE regexp_extract(c, '^(\\S+)', 1) END
  || CASE WHEN regexp_matches(c, '\\s') THEN ' ' || regexp_replace(regexp_extract(c, '^\\S+(.*)$', 1), '^\\s+', '') ELSE '' END), ', ') AS rewritten FROM parts"""

ORACLES["js_shell"] = r"""
WITH body AS (SELECT page_id, html, regexp_replace(html, '(?is)^.*?<body[^>]*>', '') AS b FROM pages),
cleared AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'),
  '(?is)<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', '', 'g') AS t FROM body),
texts AS (SELECT page_id, html, trim(regexp_replace(replace(replace(replace(replace(t, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS v FROM cleared)
SELECT page_id, length(v) AS visible, length(v) < 150 AND contains(lower(html), '<script') AS shell FROM texts"""

ORACLES["js_shell_cases"] = f"""
SELECT page_id, (length(trim(regexp_replace(CASE WHEN inner_ LIKE '%<%' THEN regexp_replace(inner_, '<[^>]*>', '', 'g') ELSE inner_ END || repeat('word ', words), '\\s+', ' ', 'g'))) < 150 AND script = 1)
  OR (regexp_matches(attribute, 'data-reactroot|id=[''"]?(root|app|__next|__nuxt)[''"]?$') AND trim(regexp_replace(inner_, '<!--.*?-->', '', 'g')) = '') AS shell
FROM (SELECT page_id, attribute, inner_, script, CAST(words + page_id % 35 AS INTEGER) AS words FROM {fx.spread_sql(fx.SHELLS, 'attribute, inner_, script, words')})"""

_SOURCE = """CASE WHEN contains(h, '<title>just a moment') THEN 'cloudflare' WHEN contains(h, 'awswafcookiedomainlist') THEN 'aws-waf' WHEN contains(h, 'window.gokuprops') THEN 'aws-waf'
  WHEN contains(h, 'cf-mitigated') THEN 'cloudflare-header' WHEN contains(h, 'challenges.cloudflare.com') THEN 'cloudflare' WHEN contains(h, 'attention required! | cloudflare') THEN 'cloudflare'
  WHEN contains(h, 'checking your browser before accessing') THEN 'cloudflare-legacy' WHEN contains(h, '<title>access denied</title>') THEN 'akamai' END"""
ORACLES["challenge_detect"] = f"""
WITH b AS (SELECT x.page_id, header, front || html AS body, content_type, lower(substr(front, 1, 4096)) AS h FROM {fx.spread_sql(fx.BODIES, 'header, front, content_type')} x JOIN pages p ON p.page_id = x.page_id)
SELECT page_id, CASE header WHEN 'cf-mitigated' THEN 'cloudflare-header' WHEN 'x-amzn-waf-action' THEN 'aws-waf-header'
  ELSE CASE WHEN regexp_matches(content_type, 'text/html|application/xhtml') THEN {_SOURCE} END END AS challenge,
  CASE WHEN starts_with(body, '%PDF-') THEN NULL ELSE coalesce({_SOURCE}, 'content-mismatch') END AS as_pdf FROM b"""
#: What ends within the first 4096 bytes: the characters up to the end of the marker are counted in bytes.
_WITHIN = re.sub(r"contains\(h, ('[^']*')\)", r"(instr(h, \1) > 0 AND strlen(substr(t, 1, CAST(instr(h, \1) AS BIGINT) - 1)) + length(\1) <= 4096)", _SOURCE)
ORACLES["challenge_pages"] = f"""
WITH b AS (SELECT text || CASE doc_id % 3 WHEN 0 THEN ' CF-Mitigated' WHEN 1 THEN ' <Title>Access denied</title>' ELSE '' END AS t FROM documents), l AS (SELECT t, lower(t) AS h FROM b)
SELECT {_WITHIN} AS source, count(*) AS documents FROM l GROUP BY 1"""

_ROBOTS = rf"""
lines AS (SELECT host, unnest(range(0, len(string_split(text, chr(10))))) AS ord, unnest(string_split(text, chr(10))) AS raw FROM {fx.spread_sql(fx.ROBOTS, 'host, text')}),
clean AS (SELECT host, ord, trim(string_split(trim(raw), '#')[1]) AS line FROM lines),
pairs AS (SELECT host, ord, lower(trim(string_split(line, ':')[1])) AS key, trim(regexp_extract(line, '^[^:]*:(.*)$', 1)) AS value FROM clean WHERE line <> ''),
flagged AS (SELECT *, CASE WHEN key = 'user-agent' AND coalesce(lag(key) OVER (PARTITION BY host ORDER BY ord), '') <> 'user-agent' THEN 1 ELSE 0 END AS opens FROM pairs),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY host ORDER BY ord) AS grp FROM flagged),
agents AS (SELECT host, grp, bool_or(value <> '' AND value <> '*' AND contains('mozilla/5.0 (compatible; driftloom/1.0)', lower(value))) AS named, bool_or(value = '*') AS every
  FROM grouped WHERE key = 'user-agent' GROUP BY host, grp),
chosen AS (SELECT host, grp FROM (SELECT *, bool_or(named) OVER (PARTITION BY host) AS has_named FROM agents) WHERE CASE WHEN has_named THEN named ELSE every END),
mine AS (SELECT g.* FROM grouped g JOIN chosen c USING (host, grp)),
rules AS (SELECT host, ord, key = 'allow' AS allow, value AS pattern, '^' || CASE WHEN ends_with(value, '$') THEN regexp_replace(body, '\\\$$', '$') ELSE body END AS regex
  FROM (SELECT *, replace(regexp_replace(value, '([.+?^${{}}()|\[\]\\])', '\\\1', 'g'), '*', '.*') AS body FROM mine WHERE key IN ('allow', 'disallow') AND value <> '')),
delays AS (SELECT host, max(d) AS crawl_delay FROM (SELECT host, TRY_CAST(regexp_extract(value, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)', 0) AS DOUBLE) AS d FROM mine WHERE key = 'crawl-delay') WHERE d > 0 GROUP BY host)"""
ORACLES["robots_parse"] = f"WITH {_ROBOTS} SELECT r.host, r.ord, allow, pattern, regex, crawl_delay FROM rules r LEFT JOIN delays d ON d.host = r.host"
ORACLES["robots_match"] = f"""
WITH {_ROBOTS}, urls AS (SELECT r.host, p.pathname FROM {fx.spread_sql(fx.ROBOTS, 'host, text')} r JOIN {fx.spread_sql([(p,) for p in fx.ROBOT_PATHS], 'pathname', True)} p ON p.page_id = r.page_id),
hits AS (SELECT u.host, u.pathname, arg_max(r.allow, length(r.pattern) * 2 + r.allow::INT) AS best FROM urls u JOIN rules r ON r.host = u.host AND regexp_matches(u.pathname, r.regex) GROUP BY ALL)
SELECT u.host, u.pathname, coalesce(h.best, true) AS allowed FROM urls u LEFT JOIN hits h ON h.host = u.host AND h.pathname = u.pathname"""
ORACLES["effective_delay"] = f"""
WITH {_ROBOTS} SELECT h.host, greatest(2500.0::DOUBLE, coalesce(d.crawl_delay * 1000, 2500.0::DOUBLE)) AS delay_ms
FROM {fx.spread_sql(fx.ROBOTS, 'host, text')} h LEFT JOIN delays d ON d.host = h.host"""

_BLOCKED = r"CASE WHEN regexp_matches(url, '/customer/.*3$') THEN false WHEN regexp_matches(url, '/part/.*1') THEN true WHEN contains(url, '/part/') THEN false ELSE true END"
_SITE = """
site AS (
  SELECT 'https://shop.example.com/' AS url, 200 AS http_status, NULL AS challenge, NULL AS error, 1000 AS size, 'text/html' AS content_type
  UNION ALL SELECT 'https://shop.example.com/region/' || r_regionkey, 200, NULL, NULL, 1000, 'text/html' FROM region
  UNION ALL SELECT 'https://shop.example.com/nation/' || n_nationkey, 200, NULL, NULL, 1000, 'text/html' FROM nation
  UNION ALL SELECT 'https://shop.example.com/supplier/' || s_suppkey, 200, CASE WHEN s_acctbal < 0 THEN 'cloudflare' END, NULL, 1000, 'text/html' FROM supplier
  UNION ALL SELECT 'https://shop.example.com/customer/' || c_custkey, CASE WHEN c_acctbal < -500 THEN 404 ELSE 200 END, NULL, NULL, 1000 + c_custkey % 100, 'text/html' FROM customer
  UNION ALL SELECT 'https://shop.example.com/order/' || o_orderkey, 200, NULL, CASE WHEN o_orderkey % 50 = 7 THEN 'timeout' END, 2000 + o_orderkey % 1000, 'text/html' FROM orders
  UNION ALL SELECT 'https://shop.example.com/part/' || p_partkey, 200, NULL, NULL, 100 * p_size, CASE WHEN p_size > 40 THEN 'application/pdf' ELSE 'text/html' END FROM part),
edges AS (
  SELECT 'https://shop.example.com/' AS src, r_regionkey::BIGINT AS ord, 'https://shop.example.com/region/' || r_regionkey AS dst FROM region
  UNION ALL SELECT 'https://shop.example.com/region/' || n_regionkey, n_nationkey, 'https://shop.example.com/nation/' || n_nationkey FROM nation
  UNION ALL SELECT 'https://shop.example.com/nation/' || s_nationkey, s_suppkey, 'https://shop.example.com/supplier/' || s_suppkey FROM supplier
  UNION ALL SELECT 'https://shop.example.com/nation/' || c_nationkey, c_custkey + 10000000, 'https://shop.example.com/customer/' || c_custkey FROM customer
  UNION ALL SELECT 'https://shop.example.com/customer/' || o_custkey, o_orderkey, 'https://shop.example.com/order/' || o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'https://shop.example.com/order/' || l_orderkey, l_partkey, 'https://shop.example.com/part/' || l_partkey FROM lineitem)"""
_JUDGED = """CASE WHEN error IS NOT NULL THEN 'failed' WHEN size > 2900 THEN 'too-large' WHEN challenge IS NOT NULL THEN 'challenge' WHEN http_status >= 400 THEN 'failed' ELSE 'ok' END"""
ORACLES["robots_match_catalog"] = f"WITH {_SITE}, j AS (SELECT url, {_BLOCKED} AS allowed FROM site) SELECT string_split(url, '/')[4] AS section, allowed, count(*) AS urls FROM j GROUP BY ALL"
ORACLES["bfs_depth"] = f"""
WITH RECURSIVE {_SITE}, reach(url, depth) AS (SELECT 'https://shop.example.com/', 1 UNION SELECT e.dst, r.depth + 1 FROM reach r JOIN edges e ON e.src = r.url)
SELECT url, min(depth) AS depth FROM reach GROUP BY url"""


def _levels(most: int, blocked: str, excluded: str) -> str:
    """A crawl as a recursion: state of each URL at its depth; only harvested ones go on."""
    return f"""
WITH RECURSIVE {_SITE}, states AS (SELECT url, {_JUDGED} AS judged, content_type LIKE 'text/html%' AS is_html, {excluded} AS x, {blocked} AS allowed, challenge, error, http_status FROM site),
reach(url, depth) AS (
  SELECT 'https://shop.example.com/', 1
  UNION SELECT e.dst, r.depth + 1 FROM reach r JOIN states s ON s.url = r.url JOIN edges e ON e.src = r.url
  WHERE r.depth < {most} AND NOT s.x AND s.allowed AND s.judged = 'ok' AND s.is_html)"""


ORACLES["crawl_manifest"] = (
    _levels(6, _BLOCKED, "contains(lower(url), '/nation/7') OR contains(lower(url), '/order/5')")
    + """
SELECT r.url, min(r.depth) AS depth, any_value(CASE WHEN x THEN 'excluded' WHEN NOT allowed THEN 'robots' ELSE judged END) AS status,
  any_value(CASE WHEN NOT x AND allowed AND judged = 'ok' AND NOT is_html THEN 'asset' ELSE 'page' END) AS kind,
  any_value(CASE WHEN x OR NOT allowed THEN NULL WHEN error IS NOT NULL THEN error WHEN judged = 'challenge' THEN challenge WHEN judged = 'failed' THEN 'HTTP ' || http_status END) AS error
FROM reach r JOIN states s ON s.url = r.url GROUP BY r.url"""
)
ORACLES["resume_frontier"] = (
    _levels(5, "true", "false")
    + """
SELECT r.url, min(r.depth) AS depth, any_value(CASE WHEN regexp_matches(r.url, '/region/|/nation/[0-9]*[02468]$') THEN 'done' ELSE judged END) AS status
FROM reach r JOIN states s ON s.url = r.url GROUP BY r.url"""
)


def _ordered(levels: int, limit: int) -> str:
    """Breadth-first numbers level by level: the first place (parent's number, order of the link) of each new URL."""
    out = [f"{_SITE}, ok AS (SELECT url FROM site WHERE {_JUDGED} = 'ok' AND content_type LIKE 'text/html%'), n1 AS (SELECT 'https://shop.example.com/' AS url, 1 AS depth, 1::BIGINT AS seq)"]
    for k in range(2, levels + 1):
        before = " UNION ALL ".join(f"SELECT url FROM n{j}" for j in range(1, k))
        out.append(
            f"f{k} AS (SELECT e.dst AS url, min(struct_pack(p := p.seq, o := e.ord)) AS first_at FROM n{k - 1} p JOIN ok ON ok.url = p.url JOIN edges e ON e.src = p.url WHERE e.dst NOT IN ({before}) GROUP BY e.dst)"
            f", n{k} AS (SELECT url, {k} AS depth, (SELECT max(seq) FROM n{k - 1}) + row_number() OVER (ORDER BY first_at, url) AS seq FROM f{k})"
        )
    every = " UNION ALL ".join(f"SELECT * FROM n{j}" for j in range(1, levels + 1))
    return f"WITH {', '.join(out)} SELECT n.url, n.depth, n.seq, {_JUDGED} AS status FROM ({every}) n JOIN site s ON s.url = n.url WHERE n.seq <= {limit}"


ORACLES["bfs_limited"] = _ordered(5, 300)

_LOG = """
log AS (SELECT event_id AS seq, 'https://host' || user_id || '.test' AS host, 'https://host' || user_id || '.test/p' || (event_id % 100) AS url,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'robots' ELSE 'ok' END AS status, CASE WHEN event_type = 'click' THEN 'asset' ELSE 'page' END AS kind,
  CAST(floor(abs(value) * 100) AS BIGINT) AS size_bytes FROM events),
latest AS (SELECT url, max(seq) AS seq, arg_max(status, seq) AS status, arg_max(kind, seq) AS kind, arg_max(size_bytes, seq) AS size_bytes FROM log GROUP BY url)"""
ORACLES["delay_schedule"] = f"""
WITH {_LOG} SELECT seq, host, coalesce(sum(CASE WHEN status = 'robots' THEN 0.0::DOUBLE ELSE 500.0::DOUBLE END) OVER (PARTITION BY host ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS earliest_ms FROM log"""
ORACLES["delay_bounds"] = """
WITH d AS (SELECT event_id, (event_id * 7919 % 1000) / 1000.0::DOUBLE AS u, user_id % 2000 AS least FROM events)
SELECT event_id, least + CAST(floor(u * (floor(least * 1.75::DOUBLE) - least)) AS BIGINT) AS jittered, least + 100 * CAST(floor(u * (greatest(900 - least, 0) // 100 + 1)) AS BIGINT) AS stepped FROM d"""

ORACLES["error_taxonomy"] = f"""
SELECT page_id, CASE WHEN name IN ('AbortError', 'TimeoutError') THEN 'timeout' WHEN code IN ('ENOTFOUND', 'EAI_AGAIN') THEN 'dns' WHEN regexp_matches(code, 'CERT|TLS|SSL') THEN 'tls'
  WHEN code IN ('ECONNRESET', 'ECONNREFUSED', 'EPIPE') THEN 'connection' ELSE 'network' END AS kind, CASE WHEN code IS NULL THEN message ELSE code || ': ' || message END AS message
FROM {fx.spread_sql(fx.ERRORS, 'name, code, message')}"""

ORACLES["fetch_classify"] = """
WITH r AS (SELECT event_id, event_id % 13 = 0 AS bad, 100 + event_id * 7 % 900 AS size, event_id % 11 = 0 AS ch, event_type = 'error' AS e404, event_type <> 'click' AS is_html, event_id % 5 = 0 AS shell, event_id % 2 = 0 AS ren FROM events),
s AS (SELECT *, CASE WHEN bad THEN 1 WHEN size > 950 THEN 2 WHEN ch AND ren THEN 3 WHEN ch THEN 4 WHEN e404 THEN 5 WHEN NOT is_html THEN 6 WHEN ren AND shell THEN 7 ELSE 8 END AS rule FROM r)
SELECT event_id, CASE rule WHEN 1 THEN 'failed' WHEN 2 THEN 'too-large' WHEN 4 THEN 'challenge' WHEN 5 THEN 'failed' ELSE 'ok' END AS status, CASE rule WHEN 6 THEN 'asset' ELSE 'page' END AS kind,
  CASE WHEN rule IN (3, 7) THEN 'playwright' WHEN rule IN (6, 8) THEN 'static' ELSE 'none' END AS fetcher, CASE rule WHEN 1 THEN 'timeout' WHEN 4 THEN 'cloudflare' WHEN 5 THEN 'HTTP 404' END AS error, rule IN (3, 7, 8) AS harvest FROM s"""
ORACLES["asset_classify"] = """
WITH r AS (SELECT *, 100 + event_id * 7 % 900 AS size FROM events),
s AS (SELECT event_id, event_id % 8 AS depth, event_type, CASE WHEN event_id % 13 = 0 THEN 'failed' WHEN size > 950 THEN 'too-large' WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN event_id % 13 = 0 THEN 'dns' WHEN size > 950 THEN NULL WHEN event_type = 'error' THEN 'HTTP 500' END AS error FROM r)
SELECT event_id, status, error, status = 'ok' AND event_type IN ('click', 'view') AND depth < 5 AS follow FROM s"""

ORACLES["css_chain"] = f"""
WITH RECURSIVE edges AS (SELECT * FROM {fx.spread_sql(fx.CSS_EDGES, 'src, dst', True)}),
reach(url, depth) AS (SELECT url, 0 FROM {fx.spread_sql([(fx.CSS_EDGES[0][0],)], 'url')} UNION SELECT e.dst, r.depth + 1 FROM reach r JOIN edges e ON e.src = r.url WHERE r.depth < 5 AND ends_with(r.url, '.css'))
SELECT url, min(depth) AS depth FROM reach GROUP BY url"""
ORACLES["redirect_resolve"] = f"""
WITH RECURSIVE hops AS (SELECT * FROM {fx.spread_sql(fx.HOPS, 'url, status, location', True)}),
walk(url, now, requests) AS (
  SELECT url, url, 1 FROM {fx.spread_sql([(u,) for u in fx.HOP_STARTS], 'url', True)}
  UNION ALL SELECT w.url, h.location, w.requests + 1 FROM walk w JOIN hops h ON h.url = w.now WHERE h.status IN (301, 302, 303, 307, 308) AND h.location IS NOT NULL AND w.requests < 10),
last AS (SELECT url, arg_max(now, requests) AS final_url, max(requests) AS requests FROM walk GROUP BY url)
SELECT l.url, l.final_url, h.status AS http_status, l.requests, CASE WHEN h.url IS NULL THEN 'network' WHEN h.status NOT IN (301, 302, 303, 307, 308) THEN NULL WHEN h.location IS NULL THEN 'bad-redirect' ELSE 'redirect-limit' END AS error
FROM last l LEFT JOIN hops h ON h.url = l.final_url"""

ORACLES["manifest_latest"] = f"WITH {_LOG} SELECT url, seq, status, kind, size_bytes FROM latest"
ORACLES["manifest_merge"] = f"""
WITH {_LOG}, halves AS (SELECT url, seq % 2 AS h, max(seq) AS seq, arg_max(status, seq) AS status FROM log GROUP BY ALL)
SELECT url, arg_min(seq, h) AS seq, arg_min(status, h) AS status FROM halves GROUP BY url"""
ORACLES["progress_running"] = f"""
WITH {_LOG}, d AS (SELECT *, lag(status) OVER w AS s0, lag(kind) OVER w AS k0, lag(size_bytes) OVER w AS b0 FROM log WINDOW w AS (PARTITION BY host, url ORDER BY seq)),
f AS (SELECT host, seq, url, (status = 'ok' AND kind = 'page')::INT - coalesce((s0 = 'ok' AND k0 = 'page')::INT, 0) AS p, (status = 'ok' AND kind = 'asset')::INT - coalesce((s0 = 'ok' AND k0 = 'asset')::INT, 0) AS a,
  (status IN ('failed', 'too-large', 'challenge'))::INT - coalesce((s0 IN ('failed', 'too-large', 'challenge'))::INT, 0) AS x,
  CASE WHEN status = 'ok' THEN size_bytes ELSE 0 END - CASE WHEN coalesce(s0, '') = 'ok' THEN b0 ELSE 0 END AS b FROM d)
SELECT host, seq, CAST(sum(p) OVER r AS BIGINT) AS pages_done, CAST(sum(a) OVER r AS BIGINT) AS assets_done, CAST(sum(x) OVER r AS BIGINT) AS failures, CAST(sum(b) OVER r AS BIGINT) AS bytes, CAST(1 + sum(seq % 3 - 1) OVER r AS BIGINT) AS queue_size, 'crawl' AS phase, url AS current_url
FROM f WINDOW r AS (PARTITION BY host ORDER BY seq)"""
ORACLES["progress_whole"] = ORACLES["progress_running"].replace("PARTITION BY host ORDER", "ORDER").replace("SELECT host, seq, CAST", "SELECT seq, CAST").replace("CAST(1 + sum(seq % 3 - 1) OVER r AS BIGINT) AS queue_size, 'crawl' AS phase, ", "")
ORACLES["mirror_report"] = f"""
WITH {_LOG} SELECT count(*) FILTER (status = 'ok' AND kind = 'page') AS pages, count(*) FILTER (status = 'ok' AND kind = 'asset') AS assets, CAST(coalesce(sum(size_bytes) FILTER (status = 'ok'), 0) AS BIGINT) AS bytes,
  count(*) FILTER (status = 'robots') AS robots_skipped, count(*) FILTER (status = 'excluded') AS excluded, count(*) FILTER (status NOT IN ('ok', 'robots', 'excluded')) AS failures FROM latest"""
ORACLES["failures_ui"] = f"""
WITH {_LOG} SELECT url, status AS category, CASE WHEN seq % 3 = 0 THEN 'HTTP 500' ELSE 'Fetch failed' END AS reason FROM latest WHERE status NOT IN ('ok', 'robots', 'excluded')"""
ORACLES["content_digest"] = "SELECT page_id, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS size_bytes FROM pages"

_MIRROR = f"""{LINKS}, mirror_src AS (SELECT src_url AS url, 'page' AS kind FROM own UNION SELECT abs_url, 'page' FROM links WHERE kind = 'page' AND length(abs_url) % 2 = 0), {mapped('mirror_src', 'mirror')}"""
ORACLES["rewrite_plan"] = f"""
WITH {_MIRROR}, refs AS (SELECT l.*, s.path AS a_path, m.path AS target FROM links l JOIN mirror s ON s.url = l.src_url LEFT JOIN mirror m ON m.url = l.abs_url),
cut AS (SELECT *, string_split(a_path, '/') AS a, string_split(target, '/') AS b FROM refs),
same AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b))), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b)) - 1) AS k FROM cut)
SELECT src_url AS url, raw_ref, CASE WHEN target IS NULL THEN 'absolutized' ELSE 'localized' END AS action, CASE WHEN target IS NULL THEN abs_url ELSE {_REL} END AS value FROM same"""
_PLANNED = f"""
{_MIRROR}, refs AS (SELECT l.*, s.path AS a_path, m.path AS target FROM links l JOIN mirror s ON s.url = l.src_url LEFT JOIN mirror m ON m.url = l.abs_url),
cut AS (SELECT *, string_split(a_path, '/') AS a, string_split(target, '/') AS b FROM refs),
same AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b))), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b)) - 1) AS k FROM cut),
valued AS (SELECT src_url AS url, a_path AS path, raw_ref, target, CASE WHEN target IS NULL THEN abs_url ELSE {_REL} END AS value FROM same)"""
#: Every page's edits one after another; a mark keeps what was replaced from being replaced again.
ORACLES["rewrite_html"] = rf"""
WITH {_PLANNED}, edits AS (SELECT url, list(raw_ref || chr(1) || value) AS es FROM valued GROUP BY url),
texts AS (SELECT o.src_url AS url, o.html, replace(list_reduce(list_prepend(o.html, coalesce(e.es, [])), lambda acc, e: replace(acc, 'href="' || string_split(e, chr(1))[1] || '"', 'href=' || chr(2) || '"' || string_split(e, chr(1))[2] || '"')), chr(2), '') AS content
  FROM own o LEFT JOIN edits e ON e.url = o.src_url)
SELECT t.url, m.path, sha256(content) AS sha256, content <> html AS changed FROM texts t JOIN mirror m ON m.url = t.url"""
ORACLES["broken_links"] = f"WITH {_PLANNED} SELECT path, value AS raw_ref FROM valued WHERE length(target) % 3 = 0"
ORACLES["rewrite_cases"] = f"""
WITH refs AS (SELECT f.url, raw_ref, trim(raw_ref) AS r FROM {fx.spread_sql(fx.KEPT_REFS, 'raw_ref', True)} x JOIN {fx.spread_sql(fx.KEPT_FILES[:1], 'url, path')} f ON f.page_id = x.page_id), files AS (SELECT url, path FROM {fx.spread_sql(fx.KEPT_FILES, 'url, path', True)}),
known AS (SELECT *, regexp_matches(r, '^(#|mailto:)') AS inert, NOT regexp_matches(r, '^([A-Za-z][A-Za-z0-9+.-]*:|/)') AS relative, {resolved('r', "'https://h.test/d/p'")} AS abs_url, regexp_extract(r, '(#.+)$', 1) AS fragment,
  regexp_replace(regexp_replace('h.test/d/' || regexp_extract(r, '^([^?#]*)', 1), '^h.test/d/[.][.]/[.][.]/', ''), '^h.test/d/[.][.]/', 'h.test/') AS own FROM refs),
found AS (SELECT k.*, f.path AS target, g.path AS there FROM known k LEFT JOIN files f ON f.url = k.abs_url AND NOT inert LEFT JOIN files g ON g.path = k.own AND relative AND NOT inert)
SELECT url, raw_ref, CASE WHEN inert THEN 'skipped' WHEN target IS NOT NULL THEN 'localized' WHEN there IS NOT NULL OR (NOT relative AND NOT regexp_matches(r, '^/([^/]|$)')) THEN 'kept' ELSE 'absolutized' END AS action,
  CASE WHEN inert THEN NULL WHEN target IS NOT NULL THEN CASE WHEN starts_with(target, 'h.test/d/') THEN substr(target, 10) WHEN starts_with(target, 'h.test/') THEN '../' || substr(target, 8) ELSE '../../' || target END || fragment
  WHEN there IS NOT NULL OR (NOT relative AND NOT regexp_matches(r, '^/([^/]|$)')) THEN NULL ELSE abs_url || fragment END AS value FROM found"""

_SHEET_FILES = f"sheet_urls AS (SELECT url, 'asset' AS kind FROM sheets UNION SELECT abs_url, 'asset' FROM refs), {mapped('sheet_urls', 'sheet_paths')}"
ORACLES["rewrite_css"] = f"""
WITH {_SHEET_REFS}, {_SHEET_FILES}, wanted AS (SELECT r.*, s.path AS a_path, CASE WHEN regexp_matches(r.abs_url, '[.]site[.]test/(css/base[.]css|img/a[.]png)$') THEN t.path END AS target FROM refs r JOIN sheet_paths s ON s.url = r.url JOIN sheet_paths t ON t.url = r.abs_url),
cut AS (SELECT *, string_split(a_path, '/') AS a, string_split(target, '/') AS b FROM wanted),
same AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b))), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b)) - 1) AS k FROM cut),
edits AS (SELECT url, list(ref || chr(1) || CASE WHEN target IS NOT NULL THEN {_REL} WHEN regexp_matches(ref, '^(https?:|//)') THEN ref ELSE abs_url END) AS es FROM same GROUP BY url),
texts AS (SELECT s.url, s.css, list_reduce(list_prepend(s.css, coalesce(e.es, [])), lambda acc, e: regexp_replace(acc, '(?i)(url[(]\\s*[''"]?|@import\\s+[''"])' || regexp_escape(string_split(e, chr(1))[1]) || '([''"]?\\s*[)]|[''"])',
  '\\1' || string_split(e, chr(1))[2] || '\\2')) AS content FROM sheets s LEFT JOIN edits e ON e.url = s.url)
SELECT url, regexp_replace(content, '(?i)url[(]\\s*([''"]?)([^''")]+?)([''"]?)\\s*[)]', 'url(\\1\\2\\3)', 'g') AS content, regexp_replace(content, '(?i)url[(]\\s*([''"]?)([^''")]+?)([''"]?)\\s*[)]', 'url(\\1\\2\\3)', 'g') <> css AS changed FROM texts"""
_INDEX = '<!doctype html>\n<meta charset="utf-8">\n<meta http-equiv="refresh" content="0; url={0}">\n<a href="{0}">Open the mirrored site</a>\n'
ORACLES["entry_index"] = f"""
WITH {_MIRROR}, seed AS (SELECT max(url) AS url FROM mirror), hrefs AS (SELECT path AS href FROM mirror WHERE url = (SELECT url FROM seed) UNION ALL SELECT url || '?q=%22x%22' FROM seed)
SELECT 'index.html' AS path, replace('{_INDEX.format('@')}', '@', href) AS content FROM hrefs"""

ORACLES["stream_crawl_manifest"] = ORACLES["crawl_manifest"]
ORACLES["manifest_log"] = ORACLES["manifest_merge"]
ORACLES["exclude_many"] = """
WITH w AS (SELECT string_split_regex(lower(text), '[^a-z]+') AS w FROM benchmark),
p AS (SELECT unnest(list_filter(list_transform(range(1, greatest(len(w), 2)), lambda i: w[i] || coalesce(' ' || w[i + 1], '')), lambda x: length(x) >= 8)) AS pattern FROM w
  UNION SELECT unnest(list_filter(w, lambda x: length(x) >= 4)) FROM w),
texts AS (SELECT 'document ' || doc_id AS name, lower(text) AS t FROM documents UNION ALL SELECT 'page ' || page_id, lower(url) FROM pages)
SELECT name, count(*) AS patterns, min(pattern) AS first_pattern FROM texts JOIN p ON contains(t, pattern) GROUP BY name"""
