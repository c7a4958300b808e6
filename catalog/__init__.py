"""Registered queries over the driver tables, each next to its SQL check."""

from __future__ import annotations

from importlib import import_module

_MODULES = [
    "search_queries",
    "layout_queries",
    "library_queries",
    "record_queries",
    "job_queries",
    "markdown_queries",
    "file_queries",
    "stream_queries",
]


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in _MODULES:
        merged.update(getattr(import_module(f"catalog.{name}"), attribute))
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE")
