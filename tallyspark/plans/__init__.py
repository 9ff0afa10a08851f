"""Named queries over the given tables."""

from importlib import import_module

MODULES = ["ap_queries", "doc_queries", "review_queries", "extract_queries", "cost_queries", "stream_queries", "quality_queries", "block_queries"]


def load() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
