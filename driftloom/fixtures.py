"""Shapes of input that the driver's tables don't have, spread over whole tables: a row takes a shape, or all of a group, with its own name in place of each ~. The same for Spark and SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENTS = [("plain.html",), ("two words.png",), ("a%20b.css",), ("a/b",), ("é",), ("caf%C3%A9.html",), ("%zz",), ("a" * 120,), ("b" * 99 + ".html",), ("😀.png",), ("no.",), ("the,",), (".htaccess",), ("a+b",), ("x_y-z.1",)]
SCOPE = [
    ("https://example.com/x", "example.com"), ("http://www.example.com/", "example.com"), ("https://sub.example.com/", "example.com"), ("https://notexample.com/", "example.com"),
    ("https://com/", "example.com"), ("https://EXAMPLE.com:8443/", "example.com"), ("not a url", "example.com"), ("https://other.org/", "example.com"), ("https://a_example.com/", "example.com"),
]
EXCLUDES = [("none", None), ("word", "the"), ("upper", "FEED"), ("empty", ""), ("query", "page=2")]
SRCSETS = [("a.png 1x, b~.png 2x",), ("img/s~.jpg 320w,  img/l.jpg   1024w",), ("only.png",), (" , x~.png 1x,, ",), ("",), ("a.png\t1x ,b.png, ~/only.png 3x",)]
SHEETS = [
    ("https://~.site.test/css/main.css", "@import 'base.css';\n.a{background:url(../img/a.png)} .b{background:url( \"b~.png\" )}"),
    ("https://~.site.test/css/base.css", ".c{background:url('https://cdn.test/c.png')} .d{background:url(data:image/png;base64,AA)} .e{background:url(../img/a.png)}"),
    ("https://~.site.test/empty.css", ""),
    ("https://~.site.test/x/y.css", "@import url(\"z.css\"); .f{background:URL(/root.png)}"),
]
BODIES = [
    ("", "<html><title>Just a moment...</title>", "text/html"), ("", "x awsWafCookieDomainList y", "text/html"), ("", "window.gokuProps = 1", "text/html"), ("", "CF-Mitigated", "text/html"),
    ("", "src=//challenges.cloudflare.com/x", "text/html"), ("", "Attention Required! | Cloudflare", "text/html"), ("", "Checking your browser before accessing", "text/html"),
    ("", "<TITLE>Access Denied</TITLE>", "text/html"), ("", "a" * 4090 + "cf-mitigated", "text/html"), ("", "a" * 4080 + "cf-mitigated", "text/html"), ("", "cf-mitigated", "text/plain"),
    ("cf-mitigated", "fine", "text/plain"), ("x-amzn-waf-action", "fine", "text/html"), ("", "%PDF-1.4 ...", "application/pdf"), ("", "<html>hello</html>", "application/xhtml+xml"),
]
ROBOTS = [
    ("~.a.test", "# all\nUser-agent: *\nDisallow: /private\nDisallow: /*~\nAllow: /private/open\nDisallow:\nCrawl-delay: 2\nCrawl-delay: 5\n"),
    ("~.b.test", "User-agent: otherbot\nUser-agent: Drift\nDisallow: /*.pdf$\nDisallow: /a+b\nCrawl-delay: 0\n\nUser-agent: *\nDisallow: /\n"),
    ("~.c.test", "Disallow: /before\nUser-agent: x\nSitemap: http://c.test/s.xml\nUser-agent: *\nDisallow: /tie\nAllow: /tie\nCrawl-delay: -1\nCrawl-delay: 1.5s\n"),
    ("~.d.test", ""),
    ("~.e.test", "User-agent: drift # us\nDisallow: /one\n\nUser-agent: driftloom\nDisallow: /two$end\nCrawl-delay: 3"),
]
ROBOT_PATHS = ["/", "/private", "/private/open/x", "/doc.pdf", "/doc.pdf/x", "/a+b", "/aab", "/tie", "/before", "/one", "/two$end", "/two", "/of/~", "/private/open/~"]
ERRORS = [("AbortError", None, "aborted ~"), ("TimeoutError", "X", "late"), ("TypeError", "ENOTFOUND", "~"), ("TypeError", "EAI_AGAIN", "m"), ("TypeError", "CERT_HAS_EXPIRED", "m"), ("TypeError", "ERR_TLS_X", "m"), ("TypeError", "ECONNRESET", "m"), ("TypeError", "EPIPE", "m"), ("TypeError", None, "fetch failed"), ("Error", "EOTHER", "m")]
CSS_EDGES = [(f"https://~.s.test/{i}.css", f"https://~.s.test/{i + 1}.css") for i in range(8)] + [("https://~.s.test/3.css", "https://~.s.test/1.css"), ("https://~.s.test/0.css", "https://~.s.test/x.png")]
HOPS = (
    [(f"http://~.h.test/a{i}", 302, f"http://~.h.test/a{i + 1}") for i in range(8)] + [("http://~.h.test/a8", 200, None)]
    + [(f"http://~.h.test/b{i}", 301, f"http://~.h.test/b{i + 1}") for i in range(9)] + [("http://~.h.test/b9", 200, None)]
    + [(f"http://~.h.test/c{i}", 307, f"http://~.h.test/c{i + 1}") for i in range(10)] + [("http://~.h.test/c10", 200, None)]
    + [("http://~.h.test/bad", 303, None), ("http://~.h.test/loop", 308, "http://~.h.test/loop"), ("http://~.h.test/gone", 302, "http://~.h.test/nowhere"), ("http://~.h.test/err", 404, None)]
)
HOP_STARTS = ["http://~.h.test/a0", "http://~.h.test/b0", "http://~.h.test/c0", "http://~.h.test/bad", "http://~.h.test/loop", "http://~.h.test/gone", "http://~.h.test/err", "http://~.h.test/none"]
PATH_PAIRS = [("h/index.html", "_assets/h/a.png"), ("h/a/b/c.html", "h/a/d.html"), ("h/a.html", "h/b.html"), ("h/a.html", "h/a.html"), ("h/x/y/z.html", "h/index.html"), ("a.html", "b/c.html"), ("h/a/b.html", "h/a/b/c.html")]
NORMALIZE = [
    ("/a/b", "https://~.ex.com/x/y"), ("c~?d=1#e", "https://~.ex.com/x/y"), ("../up", "https://~.ex.com/x/y/z"), ("./", "https://~.ex.com/x/y"), ("#frag", "https://~.ex.com/x?q=1"), ("?n=2", "https://~.ex.com/x?q=1"),
    ("//cdn.test/p", "http://~.ex.com/"), ("HTTP://Ex.COM:80/A~/../B", "https://~.ex.com/"), ("mailto:a@b.c", "https://~.ex.com/"), ("javascript:void(0)", "https://~.ex.com/"), ("data:,x", "https://~.ex.com/"),
    ("http://[bad", "https://~.ex.com/"), ("a b~", "https://~.ex.com/d/"), ("für", "https://~.ex.com/"), ("", "https://~.ex.com/p"), ("https://~.ex.com", "https://~.ex.com/p"), ("/../../x", "https://~.ex.com/a/b"), ("\\win\\path", "https://~.ex.com/a"),
]


MARKUP = [
    ("http://~.m.test/d/p.html", "<base href='/base/'><a href='in~.php?x=1#f'>1</a><a href=http://other.test/out>2</a><a href=\"file.zip\">3</a><iframe src='frame.bin'></iframe><iframe src='//other.test/f'></iframe>"),
    ("http://~.m.test/q", "<img src=a~.png srcset='b.png 1x, c.png 2x'><script src=//cdn.test/s.js></script><video src=v.mp4 poster=v.jpg><source src=w.mp4><track src=t.vtt></video><audio src=x.mp3></audio>"),
    ("http://~.m.test/r/", "<embed src=e.swf><object data=o~.pdf></object><link rel='shortcut icon' href=i.ico><link rel=canonical href=/c><link rel='PRELOAD foo' href=p.woff><div style='background:url(bg.png)'></div>"),
    ("http://www.~.m.test/s", "<style>@import 'n.css'; .a{background:url( 'u~.png' )} .b{background:url(data:x)}</style><textarea><img src=hidden.png></textarea><a href='mailto:a@b'>m</a><a href='a.png'>x</a><a href='a.png'>y</a>"),
]
#: Attributes of a mount, what is in it, whether a script follows, words beside it: parts of a page, put together alike by Spark and by SQL.
SHELLS = [
    ("id=root", "", 1, 0), ("id=\"app\"", "  ", 0, 60), ("id='__next'", "<p>x</p>", 0, 60), ("id=__nuxt", "text", 1, 60), ("data-reactroot", "", 0, 60), ("id=other", "", 1, 60), ("id=other", "", 1, 2), ("id=other", "", 0, 2),
    ("id=root", "<!-- c -->", 0, 60), ("id=app", "<br>", 0, 60), ("id=rooted", "", 0, 60), ("id=root", "full</div><div id=app>", 0, 60), ("id=other", "", 1, 12),
]
#: Saved files and their URLs; references of the file h.test/d/p.html.
KEPT_FILES = [("https://h.test/d/p~", "h.test/d/p~.html"), ("https://h.test/x~?q=1", "h.test/x~_qabc.html"), ("https://cdn.test/a~.png", "_assets/cdn.test/a~.png"), ("https://h.test/other~", "h.test/other~.html")]
KEPT_REFS = [("/x~?q=1",), ("../x~_qabc.html",), ("../x~_qabc.html#part",), ("../../_assets/cdn.test/a~.png?v=2",), ("//cdn.test/a~.png",), ("/x~?q=1#",), ("/x~?q=1#end",), ("/gone~",), ("gone.html",), ("https://h.test/gone",), ("#top",), ("mailto:a@b.c",), (" ../other~.html ",), ("../../../out",), ("HTTPS://H.TEST/other~",)]
INERT = [("",), ("  ",), ("#~",), (" #x",), ("data:,~",), ("MAILTO:~@b",), ("tel:1",), ("javascript:~(0)",), ("blob:x",), ("about:blank",), ("/~",), ("~#y",), ("https://~.e.c",), ("database~",)]


#: A page's own name: the first label of its host and its number.
LABEL = "^https?://([a-z0-9-]+)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, name) of all pages."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return rows.select("page_id", F.concat(F.regexp_extract("url", LABEL, 1), F.col("page_id").cast("string")).alias("name"))


def spread(spark: SparkSession, sf_dir: str, shapes: list[tuple], schema: str, every: bool = False) -> DataFrame:
    """All pages (page_id first), each with one of the shapes, by turns, or with every one."""
    kind = T._parse_datatype_string(schema)
    named = lambda f, x: F.replace(F.lit(x), F.lit("~"), F.col("name")) if isinstance(x, str) else F.lit(x)
    structs = F.array(*(F.struct(*(named(f, x).cast(f.dataType).alias(f.name) for f, x in zip(kind, s, strict=True))) for s in shapes))
    shape: Column = F.explode(structs) if every else F.element_at(structs, (F.col("page_id") % len(shapes) + 1).cast("int"))
    return names(spark, sf_dir).select("page_id", shape.alias("s")).select("page_id", "s.*")


def spread_sql(shapes: list[tuple], columns: str, every: bool = False) -> str:
    """The same as SQL."""
    texts = {k for s in shapes for k, x in enumerate(s) if isinstance(x, str)}
    chosen = ", ".join(f"replace(v.{c}, '~', p.name) AS {c}" if k in texts else f"v.{c}" for k, c in enumerate(columns.split(", ")))
    own = f"(SELECT page_id, regexp_extract(url, '{LABEL}', 1) || page_id AS name FROM pages) AS p"
    return f"(SELECT p.page_id, {chosen} FROM {own}, {values([(k, *s) for k, s in enumerate(shapes)], f'shape_, {columns}')} AS v" + ("" if every else f" WHERE p.page_id % {len(shapes)} = v.shape_") + ")"


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], columns: str) -> str:
    """The same rows as SQL."""

    def lit(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "true" if x else "false"
        return str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({columns}))"
