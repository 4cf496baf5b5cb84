"""References in style sheets and srcset values: Column expressions, and Python for rewriting with a mapping."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import trimmed

#: What counts as url(...), as @import of a string or url(, and as @import of a bare string; they decide which references there are.
URL_CALL = r"(?i)url\(\s*(['\"]?)([^'\")]+)\1\s*\)"
IMPORT = r"(?i)@import\s+(?:url\(\s*)?(['\"])([^'\"]+)\1"
IMPORT_STRING = r"(?i)@import\s+(['\"])([^'\"]+)\1"


def url_refs(css: Column) -> Column:
    """Targets of url(...), in order; data: aside."""
    return F.filter(F.transform(F.regexp_extract_all(css, F.lit(URL_CALL), F.lit(2)), trimmed), lambda r: ~r.startswith("data:"))


def css_refs(css: Column) -> Column:
    """Targets of url(...) and then of @import, each once."""
    return F.array_distinct(F.concat(url_refs(css), F.transform(F.regexp_extract_all(css, F.lit(IMPORT), F.lit(2)), trimmed)))


def srcset(value: Column) -> Column:
    """array<struct<url, descriptor>> of the candidates that aren't blank."""
    parts = F.filter(F.transform(F.split(value, ","), trimmed), lambda c: c != "")
    return F.transform(parts, lambda c: F.struct(F.regexp_extract(c, r"(?U)^(\S+)", 1).alias("url"), trimmed(F.regexp_extract(c, r"(?Us)^\S+(.*)$", 1)).alias("descriptor")))


def rewritten_srcset(value: Column, mapping: Column) -> Column:
    """Each candidate's URL replaced by its entry in a map, descriptors kept."""
    new = lambda c: F.coalesce(F.try_element_at(mapping, c["url"]), c["url"])
    return F.array_join(F.transform(srcset(value), lambda c: F.when(c["descriptor"] == "", new(c)).otherwise(F.concat(new(c), F.lit(" "), c["descriptor"]))), ", ")


Resolver = Callable[[str], "tuple[str, bool] | None"]


def rewrite_css(css: str, resolve: Resolver) -> str:
    """The sheet with references replaced where they stand: places of both forms are gathered from one pass over the text, the text between them is kept."""
    places = sorted([(*m.span(2), m) for form in (URL_CALL, IMPORT_STRING) for m in re.finditer(form, css)], key=lambda p: p[0])
    out, at = [], 0
    for start, end, m in places:
        if start < at or (got := resolve(m[2].strip())) is None:
            continue
        if m[0][0] == "@":
            start, new = m.start(), f"@import {m[1]}{got[0]}{m[1]}"
        else:
            start, new = m.start(), f"url({m[1]}{got[0]}{m[1]})"
        if start < at:
            continue
        out += [css[at:start], new]
        at = m.end()
    return "".join([*out, css[at:]])


def rewrite_srcset(value: str, resolve: Resolver) -> str:
    """Candidates joined by a comma and a space, blank ones out."""
    candidates = [c.split(None, 1) for c in value.split(",") if c.strip()]
    known = {c[0]: found[0] for c in candidates if (found := resolve(c[0]))}
    return ", ".join(" ".join([known.get(url, url), *map(str.strip, descriptor)]) for url, *descriptor in candidates)
