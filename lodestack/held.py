"""Caches that go when the work they serve has been done."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame

_holder: ContextVar[list[DataFrame] | None] = ContextVar("holder", default=None)


def keep(df: DataFrame) -> DataFrame:
    """``df`` cached: until the ``released`` block around ends, or else as long as the session's cache holds it."""
    df = df.persist()
    held = _holder.get()
    if held is not None:
        held.append(df)
    return df


@contextmanager
def released() -> Iterator[None]:
    """Gives back at its end what was kept inside; results that shall stay must have been computed and cached by then."""
    held: list[DataFrame] = []
    token = _holder.set(held)
    try:
        yield
    finally:
        _holder.reset(token)
        for df in held:
            df.unpersist()
