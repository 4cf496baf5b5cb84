"""Rendering of scripted pages by a browser, where one is installed; without it pages stay as they were fetched."""

from __future__ import annotations

#: Milliseconds that a page may take to settle.
SETTLE = 15_000


class BrowserRenderer:
    """url to the settled HTML, or None; a worker starts its browser at the first page. Anything with the same call can stand in."""

    def __init__(self, user_agent: str):
        self.user_agent, self.context, self.tried = user_agent, None, False

    def __reduce__(self):
        return BrowserRenderer, (self.user_agent,)

    def __call__(self, url: str) -> str | None:
        if not self.tried:
            self.tried = True
            try:
                from playwright.sync_api import sync_playwright
            except ImportError:
                return None
            self.context = sync_playwright().start().chromium.launch(headless=True).new_context(user_agent=self.user_agent)
        if self.context is None:
            return None
        page = self.context.new_page()
        try:
            try:
                page.goto(url, wait_until="networkidle", timeout=SETTLE)
            except Exception:  # late or broken off: what has loaded counts
                pass
            return page.content()
        except Exception:
            return None
        finally:
            page.close()
