"""Named queries over the given tables and the SQL they are checked with."""

from importlib import import_module

MODULES = ("cleaning", "tables", "windows", "summaries", "evaluation", "control", "streams", "models", "increments")


def load() -> tuple[dict, dict]:
    from fleetlens.catalog.base import ORACLES, QUERIES

    for name in MODULES:
        import_module(f"fleetlens.catalog.{name}")
    return dict(QUERIES), dict(ORACLES)
