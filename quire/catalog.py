"""All registered queries of the library outside quire.llm, by name."""

from __future__ import annotations

from importlib import import_module
from pkgutil import iter_modules

import quire.queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

for _module in sorted(m.name for m in iter_modules(quire.queries.__path__) if m.name != "registry"):
    _found = import_module(f"quire.queries.{_module}")
    QUERIES |= _found.QUERIES
    ORACLES |= _found.ORACLES
