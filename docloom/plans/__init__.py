"""Registered queries, one module for each part of the inventory."""

from importlib import import_module

MODULES: tuple[str, ...] = ("text", "relational", "geometry", "grounding", "extraction", "fields", "streams", "layout", "ocr", "rescue", "arabic", "profiles")


def load() -> None:
    for name in MODULES:
        import_module(f"docloom.plans.{name}")
