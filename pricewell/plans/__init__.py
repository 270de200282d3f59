"""Named queries over the given tables."""

from __future__ import annotations

from .registry import ORACLES, QUERIES


def load_all():
    """(queries, oracles) with every query module imported."""
    from importlib import import_module

    for m in ("offers_queries", "message_queries", "text_queries", "publish_queries", "stream_queries", "dialog_queries", "tree_queries", "device_queries", "source_queries"):
        import_module(f"{__name__}.{m}")
    return QUERIES, ORACLES
