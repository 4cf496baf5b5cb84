"""Schemas of the engine's relations."""

from __future__ import annotations

RESPONSES = (
    "url string, final_url string, http_status int, content_type string, headers map<string,string>, body binary,"
    " redirect_chain array<string>, error struct<kind:string,message:string>, rendered_html string"
)
MANIFEST = "url string, path string, status string, kind string, content_type string, sha256 string, size_bytes bigint, fetcher string, error string, seq bigint"
LINKS = "src_url string, base_url string, source string, ord int, raw_ref string, abs_url string, kind string"
FRONTIER = "url string, kind string, depth int, seq bigint"
PROGRESS = "seq bigint, phase string, pages_done bigint, assets_done bigint, queue_size bigint, bytes bigint, failures bigint, current_url string"

#: Fixed values of the enumerations.
STATUSES = ("ok", "failed", "too-large", "robots", "challenge", "excluded")
KINDS = ("page", "asset")
FETCHERS = ("static", "playwright", "none")
BROWSER_MODES = ("auto", "never", "always")
FETCH_FAILURES = ("timeout", "dns", "tls", "connection", "redirect-limit", "bad-redirect", "network")
