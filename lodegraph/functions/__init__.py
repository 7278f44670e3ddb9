"""Scalar functions of the query language as builders of Spark columns.

Each module registers its functions by lower-case name in ``REGISTRY``; a
builder takes the argument values and returns a value. ``register`` adds more.
"""

from __future__ import annotations

from collections.abc import Callable

from ..plans.values import Val

REGISTRY: dict[str, Callable[..., Val]] = {}
#: As listed by dbms.functions(), with the case that users know.
SPELLED: dict[str, str] = {}


def register(*names: str):
    """Register a builder under names; users may add functions of their own."""

    def add(fn):
        for n in names:
            REGISTRY[n.lower()] = fn
            SPELLED[n.lower()] = n
        return fn

    return add


def load() -> None:
    from . import convert, lists, numeric, spatial, strings, temporal, vectors  # noqa: F401
