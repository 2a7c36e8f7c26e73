"""What a Python worker holds from one task to the next.

Spark hands a worker from job to job, so what a module keeps there would stay for ever. A worker holds the
tables of one operator; tasks of operators that hold nothing let them go, and with them the memory that
Arrow has kept from earlier batches.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")
_HELD: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], T]) -> T:
    """What ``make`` returns, made once in a worker; what other operators held there goes."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    _HELD.clear()
    pa.default_memory_pool().release_unused()
