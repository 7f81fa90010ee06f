"""Small helpers of the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Rows of one Arrow batch of texts.
ROWS = 2000


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def small_batches(texts: DataFrame) -> DataFrame:
    """``texts`` unchanged; its session hands rows to Python ``ROWS`` at a time at most.

    The usual 10,000 whole texts are some tens of megabytes, held several times over by each task.
    """
    conf, name = texts.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ROWS:
        conf.set(name, str(ROWS))
    return texts


def give_back() -> None:
    """Returns memory that this process holds and does not use to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches; at its end the worker process, which goes on with other tasks, gives back what it no longer uses."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


def released_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for ``run`` of one group."""

    def wrapped(rows: pa.Table) -> pa.Table:
        found = run(rows)
        give_back()
        return found

    return wrapped
