"""Registered queries: operators applied to the driver's tables, with their SQL twins."""

from importlib import import_module

#: Modules that register queries.
MODULES: tuple[str, ...] = ("detect", "reports", "behaviour", "folding", "streams", "response", "desk", "intake")


def load() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
