"""Registered queries, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

import importlib

from featlake.plans.registry import ORACLES, QUERIES

FAMILIES = ["sources", "columns", "scalars", "joins", "profiles", "encoders", "ranks", "blends", "text", "vectorize", "models", "textmodels", "rowmodels"]

for _name in FAMILIES:
    importlib.import_module(f"featlake.plans.{_name}")

__all__ = ["QUERIES", "ORACLES"]
