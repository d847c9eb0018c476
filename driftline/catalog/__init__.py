"""Named queries over the driver tables."""

from __future__ import annotations

from importlib import import_module
from types import SimpleNamespace

_PARTS = ("quality", "baselines", "sequences", "thresholds", "warnings", "studies", "relations")


def load() -> SimpleNamespace:
    """All registered queries and their SQL, in a fixed order."""
    from driftline.catalog import registry

    for part in _PARTS:
        import_module(f"driftline.catalog.{part}")
    return SimpleNamespace(queries=registry.QUERIES, oracle=registry.ORACLE)
