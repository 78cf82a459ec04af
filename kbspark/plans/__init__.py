"""All registered queries. Importing this package fills the registry."""

import importlib

from .registry import ORACLES, QUERIES

MODULES = [
    "events", "catalog", "retrieval", "spans", "chunks", "markup", "web", "assembly", "dialogue", "store", "live", "changes",
]

for _name in MODULES:
    try:
        importlib.import_module(f"{__name__}.{_name}")
    except ModuleNotFoundError as err:
        if err.name != f"{__name__}.{_name}":
            raise

__all__ = ["ORACLES", "QUERIES"]
