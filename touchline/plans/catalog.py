"""All queries, by importing the modules that register them."""

import importlib
import os
import pkgutil

from . import registry

for _module in sorted(m.name for m in pkgutil.iter_modules([os.path.dirname(__file__)])):
    if _module.startswith("catalog_"):
        importlib.import_module(f"{__package__}.{_module}")


def queries():
    return dict(registry.QUERIES)


def checks():
    return dict(registry.CHECKS)
