"""Memory of a Python worker, which Spark keeps from task to task and from stage to stage.

An operator that remembers things between tasks registers how to forget them. Every function that runs in
tasks says whose work begins: what the others have remembered goes, and what is free goes back to the
system, as allocators keep it otherwise and the executor's memory is counted by pages.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_forget: dict[str, Callable[[], object]] = {}


def remembers(name: str, forget: Callable[[], object]) -> None:
    _forget[name] = forget


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another system
        pass


def begins(name: str) -> None:
    """Called at the start of a task's function."""
    for other, forget in _forget.items():
        if other != name:
            forget()
    gc.collect()
    _trim()
