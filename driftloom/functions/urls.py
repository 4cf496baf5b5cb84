"""URL and path functions as Column expressions: normalizing, scope, gates and the mapping of URLs to local paths."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of pages, schemes that are never rewritten, parts of a URL.
PAGE_EXTENSIONS = ("html", "htm", "xhtml", "php", "asp", "aspx", "jsp", "cfm", "shtml")
INERT = r"(?i)^(#|data:|mailto:|tel:|javascript:|blob:|about:)"
URL = r"^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
SPACE = r"(?U)\s+"
#: Fixed value: characters that file names can't have everywhere.
FORBIDDEN = r'[<>:"/\\|?*]'


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once: as a lambda's variable it isn't repeated in the plan wherever f uses it."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 host with port, 3 path, 4 query with its mark, 5 fragment with its mark."""
    return F.regexp_extract(url, URL, n)


def trimmed(x: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def hostname(url: Column) -> Column:
    """Lower-case host without user and port; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(""))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(hostname(url), r"^www\.", "")


def scope_root(seed: Column) -> Column:
    return bare_host(seed)


def in_scope(url: Column, root: Column, subdomains: Column | bool) -> Column:
    """The host is the root (a leading www. aside) or, if allowed, below it; false for what isn't a URL."""
    sub = subdomains if isinstance(subdomains, Column) else F.lit(subdomains)
    host = bare_host(url)
    return F.coalesce((host == root) | (sub & host.endswith(F.concat(F.lit("."), root))), F.lit(False))


def excluded(url: Column, patterns: Column | Sequence[str]) -> Column:
    """Any non-empty pattern occurs in the URL, whatever the case."""
    if not isinstance(patterns, Column):
        patterns = F.array(*map(F.lit, patterns)) if patterns else F.array().cast("array<string>")
    return F.coalesce(F.exists(patterns, lambda p: (F.length(p) > 0) & F.contains(F.lower(url), F.lower(p))), F.lit(False))


def within_depth(depth: Column, most: Column | int | None) -> Column:
    """Seed pages have depth 1; no limit: null or 0."""
    limit = F.coalesce(most if isinstance(most, Column) else F.lit(most).cast("int"), F.lit(0))
    return (limit == 0) | (depth <= limit)


def _encoded(x: Column, unsafe: str) -> Column:
    escape = lambda c: F.when(c.rlike(unsafe), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)
    return F.when(x.rlike(unsafe), F.array_join(F.transform(F.split(x, ""), escape), "")).otherwise(x)


def _without_dots(path: Column) -> Column:
    """Dot segments resolved; the last one leaves its slash."""

    def resolved(parts: Column) -> Column:
        step = lambda s, p: F.when(p == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).when(p == ".", s).otherwise(F.concat(s, F.array(p)))
        stack = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step)
        return let(stack, lambda s: F.concat(F.lit("/"), F.array_join(s, "/"), F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(s) > 0), "/").otherwise("")))

    return F.when(path.rlike(r"(?i)(^|/)(\.|%2e){1,2}(/|$)"), let(F.split(F.regexp_replace(path, r"(?i)%2e", "."), "/"), resolved)).otherwise(path)


def _canonical(u: Column) -> Column:
    """An absolute URL without fragment: host and port, dot segments, escapes; null if it isn't one."""
    host = let(F.lower(part(u, 2)), lambda h: F.when(part(u, 1) == "http", F.regexp_replace(h, ":(80)?$", "")).otherwise(F.regexp_replace(h, ":(443)?$", "")))
    path = let(part(u, 3), lambda p: F.when(p == "", F.lit("/")).otherwise(let(_without_dots(p), lambda x: _encoded(x, r"[^\x21-\x7e]|[\"<>`{}]"))))
    query = let(part(u, 4), lambda q: _encoded(q, r"[^\x21-\x7e]|[\"<>']"))
    fine = r"^([^\s\x00-\x20#/<>?@\[\\\]^|%\x7f-\x{10FFFF}]+@)?(\[[0-9a-f:.]+\]|[^\s\x00-\x20#/:<>?@\[\\\]^|%\x7f-\x{10FFFF}]+)(:[0-9]{1,5})?$"
    return let(host, lambda h: F.when(h.rlike(fine), F.concat(part(u, 1), F.lit("://"), h, path, query)))


def normalize(ref: Column, base: Column | None = None) -> Column:
    """The absolute http(s) URL of ref without fragment, canonical; null for other schemes and what can't be parsed.

    Hosts beyond ASCII give null here; functions.weburl resolves those exactly."""
    bare = F.regexp_replace(F.regexp_replace(ref, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    slashed = lambda r: F.when(F.contains(r, F.lit("\\")), F.concat(F.replace(F.regexp_extract(r, r"^([^?#]*)", 1), F.lit("\\"), F.lit("/")), F.regexp_extract(r, r"^[^?#]*(.*)$", 1))).otherwise(r)

    def absolute(r: Column) -> Column:
        scheme = F.lower(F.regexp_extract(r, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
        own = F.concat(scheme, F.lit("://"), F.regexp_replace(r, r"^[A-Za-z]+:/*", ""))
        if base is None:
            return F.when(scheme.isin("http", "https"), own)
        origin = F.concat(part(base, 1), F.lit("://"), part(base, 2))
        path = F.when(part(base, 3) == "", F.lit("/")).otherwise(part(base, 3))
        return (
            F.when(scheme.isin("http", "https"), own)
            .when(scheme != "", None)
            .when(~base.rlike(r"^https?://[^/?#]"), None)
            .when(r.startswith("//"), F.concat(part(base, 1), F.lit(":"), r))
            .when(r.startswith("/"), F.concat(origin, r))
            .when(r.startswith("?"), F.concat(origin, path, r))
            .when((r == "") | r.startswith("#"), F.concat(origin, path, part(base, 4)))
            .otherwise(F.concat(origin, F.regexp_extract(path, r"^(.*/)", 1), r))
        )

    return let(let(let(bare, slashed), lambda r: F.regexp_extract(absolute(r), r"^([^#]*)", 1)), _canonical)


def decoded(seg: Column) -> Column:
    """Percent-decoded; what isn't a valid escape stays as it is."""
    plain = F.try_url_decode(F.replace(seg, F.lit("+"), F.lit("%2B")))
    return let(plain, lambda p: F.when(p.isNull() | (F.contains(p, F.lit("\ufffd")) & ~F.contains(seg, F.lit("\ufffd"))), seg).otherwise(p))


def _safe(x: Column) -> Column:
    """Anything but letters, digits, dot, underscore and dash becomes _ (characters beyond the basic plane: two)."""
    return F.regexp_replace(F.regexp_replace(x, r"[\x{10000}-\x{10FFFF}]", "__"), r"[^A-Za-z0-9._-]", "_")


def hash8(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 8)


def extname(name: Column) -> Column:
    """POSIX extension with its dot."""
    return F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)


def extension(name: Column) -> Column:
    return F.lower(F.substring(extname(name), 2, 1000))


def is_page_extension(ext: Column) -> Column:
    return F.lower(ext).isin("", *PAGE_EXTENSIONS)


def before_extension(name: Column, mark: Column) -> Column:
    """The mark put before the extension."""
    return F.concat(F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), mark, extname(name))


def _cut_name(safe: Column, seg: Column) -> Column:
    return F.concat(F.substring(safe, 1, 91), F.lit("_"), hash8(seg))


def sanitize_host(seg: Column) -> Column:
    return let(_safe(decoded(seg)), lambda safe: F.when(F.length(safe) > 100, _cut_name(safe, seg)).otherwise(safe))


def sanitize_segment(seg: Column) -> Column:
    """Like a host's, but a changed name carries a hash, so that different names stay different."""

    def named(plain: Column) -> Column:
        return let(
            _safe(plain),
            lambda safe: F.when(F.length(safe) > 100, _cut_name(safe, seg)).when(safe == plain, safe).otherwise(before_extension(safe, F.concat(F.lit("_h"), hash8(plain)))),
        )

    return let(decoded(seg), named)


def local_path(url: Column, kind: Column) -> Column:
    """The path of a URL's copy: [_assets/]host/segments/file, the same for the same URL everywhere; null for what isn't a URL."""
    path, query = part(url, 3), part(url, 4)
    folder = (path == "") | path.endswith("/")
    names = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: sanitize_segment(s))
    ruled = lambda f: F.when((kind == "asset") | extension(f).isin("html", "htm"), f).otherwise(F.concat(f, F.lit(".html")))
    queried = lambda f: F.when(F.length(query) > 1, before_extension(f, F.concat(F.lit("_q"), hash8(F.substring(query, 2, 1 << 20))))).otherwise(f)

    def whole(n: Column) -> Column:
        file = F.when(folder, F.lit("index.html")).otherwise(let(F.coalesce(F.try_element_at(n, F.lit(-1)), F.lit("index.html")), ruled))
        above = F.when(folder, n).otherwise(F.slice(n, 1, F.greatest(F.size(n) - 1, F.lit(0))))
        top = F.when(kind == "asset", F.array(F.lit("_assets"))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(top, F.array(sanitize_host(part(url, 2))), above, F.array(let(file, queried))), "/")

    return F.when(part(url, 2) != "", let(names, whole))


def relative_ref(source: Column, target: Column) -> Column:
    """POSIX path from the folder of one local path to another."""

    def between(a: Column, b: Column) -> Column:
        shared = F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)) - 1, F.lit(1))),
            F.lit(0),
            lambda k, i: F.when((k == i - 1) & (i < F.least(F.size(a), F.size(b))) & (F.get(a, i - 1) == F.get(b, i - 1)), i).otherwise(k),
        )
        return let(shared, lambda k: F.concat(F.repeat(F.lit("../"), F.size(a) - 1 - k), F.array_join(F.slice(b, k + 1, F.size(b)), "/")))

    return let(F.split(source, "/"), lambda a: let(F.split(target, "/"), lambda b: between(a, b)))


def joined_path(source: Column, ref: Column) -> Column:
    """The local path that a relative ref means in the file at source; null if it leaves the root."""
    parts = let(F.split(source, "/"), lambda a: F.concat(F.slice(a, 1, F.size(a) - 1), F.split(ref, "/")))
    stack = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda s, p: F.when(s.isNull(), s).when(p.isin("", "."), s).when((p == "..") & (F.size(s) == 0), None).when(p == "..", F.slice(s, 1, F.size(s) - 1)).otherwise(F.concat(s, F.array(p))),
    )
    return F.array_join(stack, "/")


def is_inert(ref: Column) -> Column:
    """Blank, a fragment, or of a scheme that is never rewritten."""
    r = trimmed(F.coalesce(ref, F.lit("")))
    return (r == "") | r.rlike(INERT)


def _tidy(name: Column, mark: str) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(name, FORBIDDEN, mark), SPACE, " "))


def safe_filename(name: Column, ext: Column | str = "", most: int = 120) -> Column:
    """A name for any file system: forbidden characters out, white space collapsed, at most `most` characters before the extension."""
    ext = ext if isinstance(ext, Column) else F.lit(ext)
    return F.concat(let(_tidy(name, "_"), lambda x: F.when(F.length(x) > most, trimmed(F.substring(x, 1, most))).otherwise(x)), ext)


def safe_dirname(name: Column) -> Column:
    return _tidy(name, "-")


def numbered_filename(url: Column, index: Column, suggested: Column | None = None) -> Column:
    """0001_name.pdf for index 0: the suggested name, else the last segment of the URL's path, decoded, else document."""
    given = F.nullif(suggested, F.lit("")) if suggested is not None else F.lit(None).cast("string")
    last = F.nullif(F.regexp_extract(url, r"^https?://[^/?#]*(?:/[^/?#]*)*/([^/?#]*)", 1), F.lit(""))
    malformed = last.rlike("%(?![0-9A-Fa-f]{2})")
    own = F.when(~malformed, F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))))
    name = F.regexp_replace(F.coalesce(given, own, F.lit("document")), FORBIDDEN, "_")
    number = (index + 1).cast("string")
    whole = F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))
    return F.concat(F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number), F.lit("_"), whole)


def format_duration(ms: Column) -> Column:
    """1h 2m 3s; smaller parts only below the largest that isn't zero."""
    s = F.floor(ms / 1000)
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def human_bytes(n: Column) -> Column:
    """Base 1024, one decimal above bytes."""
    x = n.cast("double")
    return (
        F.when(x < 1024, F.format_string("%d B", n.cast("long")))
        .when(x < 1 << 20, F.format_string("%.1f KB", x / 1024))
        .when(x < 1 << 30, F.format_string("%.1f MB", x / (1 << 20)))
        .otherwise(F.format_string("%.1f GB", x / (1 << 30)))
    )
