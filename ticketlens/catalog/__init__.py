"""Registered queries with their reference SQL, one module per subject."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "cleaning",
    "scoring",
    "gates",
    "vectors",
    "routing",
    "evaluation",
    "models",
    "learning",
    "monitoring",
    "streams",
    "arrivals",
    "sqlaccess",
]


def load():
    """Import every catalog module once and return (queries, reference SQL)."""
    from ticketlens.catalog import base

    for name in MODULES:
        import_module(f"ticketlens.catalog.{name}")
    return dict(base.QUERIES), dict(base.REFERENCE)
