"""Run options: validation of raw settings, command-line arguments, defaults."""

from __future__ import annotations

import argparse
import math
import re
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from ..schemas import BROWSER_MODES

MB = 1 << 20
USER_AGENT = "Mozilla/5.0 (compatible; Driftloom/1.0)"


@dataclass(frozen=True)
class MirrorSpec:
    """One run. 0 means no limit; delays are in milliseconds."""

    url: str
    out: str = ""
    max_pages: int = 0
    max_depth: int = 0
    exclude: tuple[str, ...] = ()
    delay: int = 500
    delay_max: int | None = None
    browser: str = "auto"
    subdomains: bool = True
    respect_robots: bool = True
    max_file_size: int = 200 * MB
    user_agent: str = USER_AGENT
    fresh: bool = False
    rewrite: bool = True
    extra: dict = field(default_factory=dict)


def with_scheme(url: str) -> str:
    return url if re.match(r"(?i)[a-z][a-z0-9+.-]*://", url) else f"https://{url}"


def default_out(url: str, strip_www: bool = False) -> str:
    """mirror-<host>; the panel leaves www. out, the command line doesn't."""
    host = urlsplit(with_scheme(url)).hostname or "site"
    return "mirror-" + (re.sub(r"^www\.", "", host) if strip_www else host)


def validate(raw: object) -> tuple[MirrorSpec | None, list[str]]:
    """Settings as a form sends them (numbers as text, blanks for defaults) to a spec, or what is wrong with them."""
    c = raw if isinstance(raw, dict) else {}
    errors: list[str] = []
    url = c.get("url").strip() if isinstance(c.get("url"), str) else ""
    if not url:
        errors.append("The website address is missing.")
    else:
        url = with_scheme(url)
        try:
            parts = urlsplit(url)
            if parts.scheme.lower() not in ("http", "https"):
                errors.append("The website address must be http or https.")
            elif not parts.hostname or re.search(r"\s", parts.netloc):
                errors.append("The website address is not a URL.")
        except ValueError:
            errors.append("The website address is not a URL.")

    def number(key: str) -> float | None:
        text = str(c.get(key, "") if c.get(key) is not None else "").strip()
        if not text:
            return None
        try:
            n = float(text)
        except ValueError:
            n = math.nan
        if not math.isfinite(n):
            errors.append(f"{key} is not a number.")
        elif n < 0:
            errors.append(f"{key} is negative.")
        else:
            return n
        return None

    depth, pages, size, plain = number("maxDepth"), number("maxPages"), number("maxFileSizeMb"), number("delayMs")
    low, high = number("delayFromS"), number("delayToS")
    if low is not None and high is not None and low > high:
        errors.append("delayFromS is greater than delayToS.")
    browser = c.get("browser") or "auto"
    if browser not in BROWSER_MODES:
        errors.append("browser is none of " + ", ".join(BROWSER_MODES) + ".")
    given = c.get("exclude")
    given = [str(x) for x in given] if isinstance(given, (list, tuple)) else given.split("\n") if isinstance(given, str) else []
    if errors:
        return None, errors
    delay = round(low * 1000) if low is not None else 0 if high is not None else plain if plain is not None else 500
    out = c.get("outDir").strip() if isinstance(c.get("outDir"), str) else ""
    return MirrorSpec(
        url=url, out=out or default_out(url, True), max_pages=int(pages or 0), max_depth=int(depth or 0), exclude=tuple(x.strip() for x in given if x.strip()),
        delay=int(delay), delay_max=round(high * 1000) if high is not None else None, browser=browser, subdomains=c.get("subdomains") is not False, respect_robots=c.get("respectRobots") is not False,
        max_file_size=int((200 if size is None else size) * MB), fresh=c.get("mode") == "fresh" or c.get("fresh") is True,
    ), []


def whole(text: str) -> int:
    if not re.fullmatch(r"\d+", text):
        raise argparse.ArgumentTypeError(f"not a whole number: {text}")
    return int(text)


def seconds(text: str) -> float:
    if not re.fullmatch(r"\d+(\.\d+)?", text):
        raise argparse.ArgumentTypeError(f"not a number of seconds: {text}")
    return float(text)


def port(text: str) -> int:
    if not 0 <= whole(text) < 1 << 16:
        raise argparse.ArgumentTypeError(f"not a port: {text}")
    return int(text)


def parse_ui_args(argv: list[str]) -> argparse.Namespace:
    """Settings of the control panel: port (0: any free one), no_open."""
    p = argparse.ArgumentParser(prog="driftloom ui", description="A local control panel.")
    p.add_argument("--port", type=port, default=0)
    p.add_argument("--no-open", action="store_true")
    return p.parse_args(argv)


def parse_args(argv: list[str]) -> tuple[MirrorSpec, str | None]:
    """A command line to a spec and, if one is named, the table of responses."""
    p = argparse.ArgumentParser(prog="driftloom", description="Mirror a site, from the web or from a table of responses.")
    p.add_argument("--responses")
    p.add_argument("url")
    p.add_argument("--out", default="")
    for name in ("max-pages", "max-depth"):
        p.add_argument(f"--{name}", type=whole, default=0)
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--delay", type=whole, default=500)
    p.add_argument("--delay-min", type=seconds)
    p.add_argument("--delay-max", type=seconds)
    p.add_argument("--browser", choices=BROWSER_MODES, default="auto")
    p.add_argument("--no-subdomains", action="store_true")
    p.add_argument("--no-robots", action="store_true")
    p.add_argument("--max-file-size", type=whole, default=200)
    p.add_argument("--user-agent", default=USER_AGENT)
    p.add_argument("--fresh", action="store_true")
    a = p.parse_args(argv)
    if a.delay_min is not None and a.delay_max is not None and a.delay_max < a.delay_min:
        p.error("--delay-max is less than --delay-min")
    url = with_scheme(a.url)
    if not urlsplit(url).hostname:
        p.error(f"not a URL: {a.url}")
    low = round(a.delay_min * 1000) if a.delay_min is not None else 0 if a.delay_max is not None else a.delay
    spec = MirrorSpec(
        url=url, out=a.out or default_out(url), max_pages=a.max_pages, max_depth=a.max_depth, exclude=tuple(a.exclude), delay=low, delay_max=None if a.delay_max is None else round(a.delay_max * 1000),
        browser=a.browser, subdomains=not a.no_subdomains, respect_robots=not a.no_robots, max_file_size=a.max_file_size * MB, user_agent=a.user_agent, fresh=a.fresh,
    )
    return spec, a.responses
