"""What Python workers remember from task to task. Workers outlive a query's steps, so that without more each operator of a
pipeline would leave its memory to the next ones."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

#: glibc keeps what is freed; elsewhere there is no such function.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_held: dict[str, Callable[[], None]] = {}


def use(operator: str, forget: Callable[[], None] | None = None) -> None:
    """To be called where an operator begins to work on a batch: whatever other operators hold in this worker goes.
    ``forget`` drops what this one holds. Memory of earlier batches goes back to the system."""
    others = [o for o in _held if o != operator]
    for other in others:
        _held.pop(other)()
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)
    if forget:
        _held[operator] = forget
