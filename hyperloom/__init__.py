"""A PySpark-native engine for attributed hypergraphs.

Exports are loaded when they are asked for, so that workers import what they run and no more.
"""

from __future__ import annotations

from importlib import import_module

_FROM = {
    "Compressed": "plans.compress", "decompress": "plans.compress", "compress_incremental": "plans.compress", "decompress_incremental": "plans.compress",
    "EDGE": "model", "GRAPH": "model", "NODE": "model", "with_defaults": "model",
}
_PACKAGES = ("functions", "model", "operators", "plans", "sources", "streaming")
__all__ = [*_FROM, *_PACKAGES]


def __getattr__(name: str):
    if name in _FROM:
        return getattr(import_module(f".{_FROM[name]}", __name__), name)
    if name in _PACKAGES:
        return import_module(f".{name}", __name__)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
