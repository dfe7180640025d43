"""Named queries by subject; importing the modules registers them."""

import importlib
import pkgutil


def registry():
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    from emberframe.registry import CORE

    return CORE
