"""What a Python worker keeps between tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_HELD: dict[str, object] = {}


def give_back() -> None:
    """Return freed memory to the machine, which allocators otherwise keep for this process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def kept(key: str, make: Callable[[], object]) -> object:
    """The object of this key, made once; a worker keeps one at a time, so memories do not add up."""
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = make()
    return _HELD[key]
