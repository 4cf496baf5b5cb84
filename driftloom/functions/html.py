"""HTML in Python for Arrow functions: one token scan finds base and references, edits attributes in place, and judges shells."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

from .css import IMPORT_STRING, URL_CALL, Resolver, rewrite_css, rewrite_srcset

#: Fixed values: (tag, attribute) pairs that hold one URL, tags with srcset, link relations of assets, mounts of scripted pages.
URL_ATTRIBUTES = (
    ("a", "href"), ("link", "href"), ("script", "src"), ("img", "src"), ("iframe", "src"), ("source", "src"), ("video", "src"),
    ("video", "poster"), ("audio", "src"), ("track", "src"), ("object", "data"), ("embed", "src"),
)
SRCSET_TAGS = ("img", "source")
ASSET_RELS = ("stylesheet", "icon", "shortcut icon", "apple-touch-icon", "apple-touch-icon-precomposed", "manifest", "preload", "prefetch", "mask-icon")
MOUNT_IDS = ("root", "app", "__next", "__nuxt")
RULES = ("a", "iframe", "img", "srcset", "script", "media", "poster", "object", "link", "style_attr", "style")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class Scan(HTMLParser):
    """Start tags with their places in the text, and the texts of style elements."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.tags: list[tuple[int, str, str, list]] = []
        self.styles: list[tuple[int, str]] = []
        self.lines = [0]
        for m in re.finditer("\n", text):
            self.lines.append(m.end())
        self.inside = ""
        self.feed(text)
        self.close()

    def place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        if not self.inside:
            self.tags.append((self.place(), self.get_starttag_text(), tag, attrs))
        if tag in ("textarea", "title", "style"):
            self.inside = tag

    def handle_startendtag(self, tag, attrs):
        if not self.inside:
            self.tags.append((self.place(), self.get_starttag_text(), tag, attrs))

    def handle_endtag(self, tag):
        if tag == self.inside:
            self.inside = ""

    def handle_data(self, data):
        if self.inside == "style":
            self.styles.append((self.place(), data))


def _srcset_urls(value: str) -> list[str]:
    return [p.split()[0] for p in value.split(",") if p.split()]


def _style_urls(css: str) -> list[str]:
    return [r for m in re.finditer(URL_CALL, css) if not (r := m[2].strip()).startswith("data:")]


def references(text: str) -> tuple[str | None, list[tuple[str, str]]]:
    """The first base href, and (rule, raw reference) in the order of RULES and of the text."""
    scan, base, found = Scan(text), None, {r: [] for r in RULES}
    for _, _, tag, attrs in scan.tags:
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag == "base" and "href" in a and base is None:
            base = a["href"]
        if tag == "a" and "href" in a:
            found["a"].append(a["href"])
        for t, rule in (("iframe", "iframe"), ("img", "img"), ("script", "script")):
            if tag == t and "src" in a:
                found[rule].append(a["src"])
        if tag in SRCSET_TAGS and "srcset" in a:
            found["srcset"] += _srcset_urls(a["srcset"])
        if tag in ("source", "video", "audio", "track", "embed") and "src" in a:
            found["media"].append(a["src"])
        if tag == "video" and "poster" in a:
            found["poster"].append(a["poster"])
        if tag == "object" and "data" in a:
            found["object"].append(a["data"])
        if tag == "link" and "href" in a and (rel := a.get("rel", "").lower().strip()) and (rel in ASSET_RELS or any(r in ASSET_RELS for r in rel.split())):
            found["link"].append(a["href"])
        if a.get("style"):
            found["style_attr"] += _style_urls(a["style"])
    for _, css in scan.styles:
        found["style"] += _style_urls(css)
    return base, [(rule, ref) for rule in RULES for ref in found[rule] if ref or rule in ("a", "iframe")]


def rewrite_references(text: str) -> tuple[str | None, list[str]]:
    """The first base href, and every raw reference that rewriting asks for, each once: one scan."""
    out: dict[str, None] = {}
    scan, base = Scan(text), None
    for _, _, tag, attrs in scan.tags:
        for k, v in attrs:
            v = v or ""
            if base is None and tag == "base" and k == "href":
                base = v
            if (tag, k) in URL_ATTRIBUTES:
                out[v] = None
            elif k == "srcset" and tag in SRCSET_TAGS:
                out |= dict.fromkeys(_srcset_urls(v))
            elif k == "style":
                out |= dict.fromkeys(css_strings(v))
    for _, css in scan.styles:
        out |= dict.fromkeys(css_strings(css))
    return base, list(out)


def css_strings(css: str) -> list[str]:
    return list(dict.fromkeys([m[2].strip() for m in re.finditer(URL_CALL, css)] + [m[2].strip() for m in re.finditer(IMPORT_STRING, css)]))


def rewrite_html(text: str, resolve: Resolver) -> str:
    """base elements out; references replaced where they stand; integrity and crossorigin out where a reference became local."""
    scan, edits = Scan(text), []
    for at, raw, tag, attrs in scan.tags:
        if tag == "base":
            edits.append((at, len(raw), ""))
            continue
        new, drop = {}, False
        for k, v in attrs:
            v = v or ""
            if (tag, k) in URL_ATTRIBUTES and (got := resolve(v)):
                new[k], drop = got[0], drop or got[1]
            elif k == "srcset" and tag in SRCSET_TAGS and (got := rewrite_srcset(v, resolve)) != v:
                new[k], drop = got, True
            elif k == "style" and (got := rewrite_css(v, resolve)) != v:
                new[k] = got
        if new or drop:
            edits.append((at, len(raw), _edited(raw, new, drop)))
    for at, css in scan.styles:
        if (got := rewrite_css(css, resolve)) != css:
            edits.append((at, len(css), got))
    for at, n, s in sorted(edits, reverse=True):
        text = text[:at] + s + text[at + n :]
    return text


_ATTRIBUTE = re.compile(r"""(\s+)([^\s"'<>/=]+)(?:(\s*=\s*)("[^"]*"|'[^']*'|[^\s>]+))?""")


def _edited(raw: str, new: dict[str, str], drop: bool) -> str:
    def one(m: re.Match) -> str:
        name = m[2].lower()
        if drop and name in ("integrity", "crossorigin"):
            return ""
        if name in new and m[3]:
            return f'{m[1]}{m[2]}="{html.escape(new[name], quote=True)}"'
        return m[0]

    head = re.match(r"<[^\s/>]+", raw)[0]
    return head + _ATTRIBUTE.sub(one, raw[len(head) :])


class _Shell(HTMLParser):
    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.hidden, self.body, self.words, self.scripts = [], False, [], False
        self.mount, self.bare = 0, False  # how deep inside the first mount
        self.seen = False
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.mount and tag != "br":
            self.bare, self.mount = False, self.mount + (tag not in VOID)
        elif self.mount:
            self.bare = False
        elif not self.seen and (a.get("id") in MOUNT_IDS or "data-reactroot" in a):
            self.seen = self.bare = True
            self.mount = int(tag not in VOID)
        if tag == "body":
            self.body = True
        if tag == "script" and a.get("src"):
            self.scripts = True
        if tag in ("script", "style", "noscript", "template"):
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if self.mount and tag not in VOID:
            self.mount -= 1
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()

    def handle_data(self, data):
        if self.hidden and self.hidden[-1] == "script" and data.strip():
            self.scripts = True
        if self.mount and data.strip():
            self.bare = False
        if not self.hidden:
            self.words.append(data)


def needs_rendering(text: str) -> bool:
    """Little visible text beside scripts, or an empty mount of a scripted page."""
    body = re.search(r"(?is)<body\b.*", text)
    got = _Shell(text)
    inner = _Shell(body[0]) if body else got
    visible = re.sub(r"\s+", " ", "".join(inner.words)).strip()
    return (len(visible) < 150 and got.scripts) or (got.seen and got.bare)
