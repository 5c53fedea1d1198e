"""Imports every plan module so that its queries are registered."""

from __future__ import annotations

import importlib
import pkgutil

import tonelake.plans as plans
from tonelake.plans.registry import ORACLES, QUERIES

_NOT_PLANS = {"catalog", "registry", "role_sql"}


def load() -> tuple[dict, dict]:
    for module in pkgutil.iter_modules(plans.__path__):
        if module.name not in _NOT_PLANS:
            importlib.import_module(f"tonelake.plans.{module.name}")
    return QUERIES, ORACLES
