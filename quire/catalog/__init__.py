"""Registered queries over the given tables."""

from importlib import import_module

MODULES = ("texts", "searches", "comparisons", "linkage", "arrangement", "measures", "reports", "marks", "layouts", "tabular", "filling", "arrivals")


def all_queries() -> None:
    for name in MODULES:
        import_module(f"quire.catalog.{name}")
