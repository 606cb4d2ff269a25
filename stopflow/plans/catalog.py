"""All bound queries."""

import importlib
import pkgutil

from . import base
from .base import COVERS, ORACLES, QUERIES  # noqa: F401

_HELPERS = {"base", "catalog"}
for _module in pkgutil.iter_modules(__path__ if "__path__" in globals() else [base.__file__.rsplit("/", 1)[0]]):
    if _module.name not in _HELPERS:
        importlib.import_module(f"{__package__}.{_module.name}")
