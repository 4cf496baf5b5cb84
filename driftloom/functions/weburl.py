"""Exact URL resolution in Python, for Arrow functions: what Column expressions can't (hosts beyond ASCII)."""

from __future__ import annotations

import re
from urllib.parse import quote

_PARTS = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$", re.S)
_PORTS = {"http": "80", "https": "443"}


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, p in enumerate(parts):
        plain = re.sub("%2e", ".", p, flags=re.I)
        if plain in (".", ".."):
            if plain == ".." and out:
                out.pop()
            if i == len(parts) - 1:
                out.append("")
        else:
            out.append(p)
    return "/" + "/".join(out)


def _host(host: str) -> str | None:
    user, _, rest = host.rpartition("@")
    name, _, port = rest.rpartition(":") if re.search(r":\d*$", rest) else (rest, "", "")
    if not name.isascii():
        try:
            name = ".".join(x.encode("idna").decode() for x in name.lower().split("."))
        except UnicodeError:
            return None
    if "[" in name and not re.fullmatch(r"\[[0-9a-fA-F:.]+\]", name):
        return None
    if not name or re.search(r"[\x00-\x20#/<>?@\\^|%]", name) or (port and int(port) > 65535):
        return None
    return (f"{user}@" if user else "") + name.lower() + (f":{int(port)}" if port else "")


def normalize(ref: str, base: str | None = None) -> str | None:
    """The canonical http(s) URL of ref without fragment, or None."""
    ref = re.sub(r"[\t\n\r]", "", ref.strip("".join(map(chr, range(33)))))
    scheme = (re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", ref) or [None, None])[1]
    if scheme and scheme.lower() not in _PORTS:
        return None
    head, mark, tail = re.match(r"^([^?#]*)([?#]?)(.*)$", ref, re.S).groups()
    ref = head.replace("\\", "/") + mark + tail
    if scheme:
        ref = scheme.lower() + "://" + ref[len(scheme) + 1 :].lstrip("/")
    own = _PARTS.match(ref)
    at = _PARTS.match(base) if base else None
    if own[1]:
        scheme, host, path, query = own[1], own[2], own[3], own[4]
    elif not at or not at[1] or at[1].lower() not in _PORTS or not at[2]:
        return None
    else:
        scheme, host, path, query = at[1].lower(), at[2], own[3], own[4]
        if own[2] is not None:
            host = own[2]
        elif not path:
            path, query = at[3], own[4] if own[4] is not None else at[4]
        elif not path.startswith("/"):
            path = (at[3] or "/").rpartition("/")[0] + "/" + path
    host = _host(host or "")
    if host is None:
        return None
    host = re.sub(rf":{_PORTS[scheme]}$", "", host)
    path = quote(_dots(path or "/"), safe="/!$&'()*+,;=:@-._~%[]|^\\")
    query = quote(query, safe="?/!$&()*+,;=:@-._~%[]|^\\`{}") if query else ""
    return f"{scheme}://{host}{path}{query}"
