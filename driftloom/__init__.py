"""driftloom: offline web-corpus analytics on Spark DataFrames."""

import importlib
import sys

from pyspark import cloudpickle

# Functions travel to the executors with their code, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What a program that uses the engine needs, by module; loaded when it is asked for.
_EXPORTS = {
    "plans.mirror": ("mirror", "Mirror", "Run", "stop_on_signal"),
    "plans.spec": ("MirrorSpec", "validate"),
    "plans.web": ("LiveWeb", "TableWeb"),
    "functions.urls": ("scope_root", "in_scope", "normalize", "local_path", "relative_ref", "sanitize_segment", "is_page_extension"),
    "functions.html": ("rewrite_html", "needs_rendering"),
    "functions.css": ("rewrite_css", "rewrite_srcset", "srcset", "css_refs"),
    "operators.links": ("page_references", "links", "stylesheet_links"),
    "operators.responses": ("is_html",),
    "sources.responses": ("fetch", "live"),
    "sources.render": ("BrowserRenderer",),
    "__main__": ("main",),
}
__all__ = [name for names in _EXPORTS.values() for name in names]


def __getattr__(name: str) -> object:
    for module, names in _EXPORTS.items():
        if name in names:
            return getattr(importlib.import_module(f"{__name__}.{module}"), name)
    raise AttributeError(name)
