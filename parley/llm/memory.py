"""Give memory back between tasks: Python workers are used again, and allocators keep what a finished task freed."""

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The step of a task over its batches, with freed memory given back before and after."""

    @wraps(step)
    def run(batches: Iterator) -> Iterator:
        give_back()
        yield from step(batches)
        give_back()

    return run
