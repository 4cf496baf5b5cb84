"""URL, path, CSS and HTML functions: literal cases, and Python against Column forms."""

import pytest
from pyspark.sql import functions as F

from driftloom.functions import css, html, urls, weburl

PATHS = [
    ("https://ex.com/", "page", "ex.com/index.html"), ("https://ex.com", "page", "ex.com/index.html"), ("https://ex.com/blog/", "page", "ex.com/blog/index.html"), ("https://ex.com/about", "page", "ex.com/about.html"),
    ("https://ex.com/a.html", "page", "ex.com/a.html"), ("https://ex.com/a.htm", "page", "ex.com/a.htm"), ("https://ex.com/a.php", "page", "ex.com/a.php.html"), ("https://ex.com/a/b/c", "page", "ex.com/a/b/c.html"),
    ("https://ex.com/img/x.png", "asset", "_assets/ex.com/img/x.png"), ("https://ex.com/font", "asset", "_assets/ex.com/font"), ("http://ex.com:8080/x", "page", "ex.com_8080/x.html"), ("https://ex.com//a//b", "page", "ex.com/a/b.html"), ("not a url", "page", None),
]


def column(spark, values, f, n=1):
    rows = [(i, *(v if n > 1 else (v,))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"c{k} string" for k in range(n)))
    return [r["x"] for r in df.select("i", f(*(F.col(f"c{k}") for k in range(n))).alias("x")).orderBy("i").collect()]


def test_local_paths(spark):
    assert column(spark, [p[:2] for p in PATHS], urls.local_path, 2) == [p[2] for p in PATHS]


def test_queries_and_accents_keep_paths_apart(spark):
    a = column(spark, [(u, "page") for u in ("https://e.c/s?q=1", "https://e.c/s?q=2", "https://e.c/s", "https://e.c/é", "https://e.c/è", "https://e.c/a%20b", "https://e.c/a_b")], urls.local_path, 2)
    assert len(set(a)) == 7 and all(x.isascii() for x in a)


def test_long_and_odd_segments(spark):
    long_, odd, plain = column(spark, ["a" * 120, "%zz", "x.1"], urls.sanitize_segment)
    assert len(long_) == 100 and odd.startswith("_zz_h") and plain == "x.1"


RESOLVE = [
    ("/a", "https://e.c/x/y"), ("b", "https://e.c/x/y"), ("../b", "https://e.c/x/y/z"), ("?q", "https://e.c/x"), ("#f", "https://e.c/x?y"), ("//h.d/p", "https://e.c/x"), ("http://H.D:80", "https://e.c/"), ("mailto:a@b", "https://e.c/"),
    ("data:x", "https://e.c/"), ("", "https://e.c/x"), ("a/./b/../c", "https://e.c/"), ("ü?ü", "https://e.c/"), ("x y", "https://e.c/"), ("http://[bad", "https://e.c/"), ("..", "https://e.c/a/b/c"), ("https://e.c/%2e%2e/x", "https://e.c/"), (" /t ", "https://e.c/"),
]


def test_both_resolvers_agree(spark):
    assert column(spark, RESOLVE, urls.normalize, 2) == [weburl.normalize(*r) for r in RESOLVE]


def test_foreign_hosts_need_the_exact_resolver(spark):
    assert weburl.normalize("https://müller.de/x") == "https://xn--mller-kva.de/x"
    assert column(spark, ["https://müller.de/x"], urls.normalize) == [None]


@pytest.mark.parametrize("source,target,ref", [("h/i.html", "_assets/h/a.png", "../_assets/h/a.png"), ("h/a.html", "h/a.html", "a.html"), ("h/x/y/z.html", "h/i.html", "../../i.html"), ("a.html", "b/c.html", "b/c.html")])
def test_relative(spark, source, target, ref):
    assert column(spark, [(source, target)], urls.relative_ref, 2) == [ref]
    assert column(spark, [(source, ref)], urls.joined_path, 2) == [target]


def test_joined_path_stays_inside(spark):
    assert column(spark, [("h/a.html", "../../x")], urls.joined_path, 2) == [None]


def test_sizes_durations_names(spark):
    row = spark.range(1).select(
        urls.human_bytes(F.lit(512)).alias("a"), urls.human_bytes(F.lit(1536)).alias("b"), urls.format_duration(F.lit(3_723_000)).alias("c"), urls.format_duration(F.lit(900)).alias("d"),
        urls.safe_filename(F.lit('a/b:"c"')).alias("e"), urls.numbered_filename(F.lit("https://e.c/a/b%20c.PDF?x"), F.lit(6)).alias("f"), urls.is_inert(F.lit(" #x")).alias("g"), urls.is_inert(F.lit("/x")).alias("h"),
    ).first()
    assert tuple(row) == ("512 B", "1.5 KB", "1h 2m 3s", "0s", "a_b__c_", "0007_b c.PDF", True, False)
    row = spark.range(1).select(
        urls.safe_filename(F.lit("n" * 130), ".html").alias("a"), urls.safe_dirname(F.lit(" a/b\t c ")).alias("b"), urls.numbered_filename(F.lit("https://e.c/%zz"), F.lit(0)).alias("c"),
        urls.numbered_filename(F.lit("https://e.c/"), F.lit(12344), F.lit("x?y")).alias("d"), urls.numbered_filename(F.lit("https://e.c"), F.lit(1)).alias("e"),
    ).first()
    assert tuple(row) == ("n" * 120 + ".html", "a-b c", "0001_document.pdf", "12345_x_y.pdf", "0002_document.pdf")


def test_css_rewrite_keeps_quotes_and_declined_refs():
    known = {"a.png": ("x.png", True), "b.css": ("y.css", True)}
    text = "@import 'b.css'; .a{background:url( \"a.png\" )} .b{background:URL(c.png)} .c{background:url(a.png)}"
    assert css.rewrite_css(text, known.get) == "@import 'y.css'; .a{background:url(\"x.png\")} .b{background:URL(c.png)} .c{background:url(x.png)}"


def test_srcset_rewrite():
    assert css.rewrite_srcset("a 1x,  b   2x, ,c", {"a": ("A", True)}.get) == "A 1x, b 2x, c"


def test_html_references_follow_rules():
    text = """<base href="/b/"><a href=p>1</a><iframe src="f"></iframe><img src="i" srcset="s 1x, t 2x"><script src=j></script><video src=v poster=w></video>
    <object data=o></object><link rel="Icon Foo" href=l><link rel=canonical href=no><div style="background:url(d)"></div><style>@import "n"; .x{background:url(y)}</style>
    <textarea><a href="hidden"></textarea>"""
    base, refs = html.references(text)
    assert base == "/b/"
    assert [r for _, r in refs] == ["p", "f", "i", "s", "t", "j", "v", "w", "o", "l", "d", "y"]


def test_html_rewrite_edits_in_place():
    text = '<BASE href="/x"><p>&amp;</p><img src="a" integrity="q" crossorigin alt="k"><img srcset="a 1x, z 2x" integrity=q><a href="z" integrity="stay">z</a><style>.a{background:url(a)}</style>'
    got = html.rewrite_html(text, {"a": ("A&B", True), "z": ("Z", False)}.get)
    assert got == '<p>&amp;</p><img src="A&amp;B" alt="k"><img srcset="A&amp;B 1x, Z 2x"><a href="Z" integrity="stay">z</a><style>.a{background:url(A&B)}</style>'


@pytest.mark.parametrize(
    "body,shell",
    [("<div id=root></div>", True), ("<div id=root>x</div>", False), ("x" * 149 + "<script>1</script>", True), ("x" * 150 + "<script>1</script>", False), ("x<script></script>", False), ("x<script src=a></script>", True), ("<noscript>" + "y" * 200 + "</noscript><script>1</script>", True), ("<div data-reactroot><p></p></div>", False)],
)
def test_shells(spark, body, shell):
    from driftloom.operators import responses

    page = f"<html><body>{body}</body></html>"
    assert html.needs_rendering(page) is shell
    assert column(spark, [page], responses.is_shell) == [shell]
