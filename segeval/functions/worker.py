"""Objects that a Python worker keeps from task to task."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable
from typing import Any

#: Objects kept per worker; the one used longest ago goes first.
HELD = 4


def held(key: Hashable, load: Callable[[], Any]) -> Any:
    """``load()``, called once per worker and key: later tasks of the same worker get the same object.

    Functions travel to the workers by value, so nothing of this package lives on
    between tasks; the objects are kept in a module of their own.
    """
    kept = sys.modules.setdefault("_segeval_held", types.ModuleType("_segeval_held"))
    objects = kept.__dict__.setdefault("objects", {})
    if key in objects:
        objects[key] = objects.pop(key)  # now the last one used
    else:
        objects[key] = load()
        while len(objects) > HELD:
            del objects[next(iter(objects))]
    return objects[key]
