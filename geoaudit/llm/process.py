"""What a Python worker keeps between tasks, and how much it is sent at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_BYTES = 16 << 20
#: Fixed values of the C library's mallopt: the setting for the size from which memory is mapped, and that size.
_MMAP_THRESHOLD, _MAPPED_FROM = -3, 1 << 20
_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """The one object that this process keeps between tasks; asking for another drops it."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def keep_nothing() -> None:
    """For tasks that keep nothing: leave no memory to what earlier operators have kept, or have freed.

    Workers live on from task to task. What numpy and Arrow have freed stays with the process unless it is given
    back, and large arrays stay too once the C library has raised its threshold; from here on they are mapped, and
    go as they are freed. Where the C library has no such calls, nothing is done.
    """
    _kept.clear()
    pa.default_memory_pool().release_unused()
    library = ctypes.CDLL(None)
    if hasattr(library, "mallopt") and hasattr(library, "malloc_trim"):
        library.mallopt(_MMAP_THRESHOLD, _MAPPED_FROM)
        library.malloc_trim(ctypes.c_size_t(0))


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows, unless the session bounds them more tightly."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = spark.conf.get(setting, None)
    if known is None or not known.isdigit() or not 0 < int(known) <= BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))
