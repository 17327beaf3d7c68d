"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("pages", "stores", "crawl", "vectors", "answering", "streams")


def _merged(name: str) -> dict:
    merged: dict = {}
    for module in MODULES:
        merged.update(getattr(import_module(f"lexloom.plans.{module}"), name))
    return merged


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLES")
