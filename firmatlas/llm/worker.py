"""What a Python worker process keeps from one task to the next.

Functions are sent to executors by value, so every task has module globals of its own; a module entry made
on first use belongs to the process instead.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType

HOLDER = "firmatlas_worker_kept"


def kept(key: tuple, make: Callable):
    """The value of ``key`` in this process, made on first use."""
    held = sys.modules.setdefault(HOLDER, ModuleType(HOLDER)).__dict__.setdefault("values", {})
    if key not in held:
        held[key] = make()
    return held[key]
