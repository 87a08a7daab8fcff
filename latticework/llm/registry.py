"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import importlib

MODULES = ("near_dedup", "language", "chat", "hamming_search", "token_blocks", "packing", "repeats", "resampling", "graph_search", "mixing")


def queries() -> dict:
    out = {}
    for name in MODULES:
        out |= importlib.import_module(f"{__package__}.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{name}"), "ORACLES", {})
    return out
