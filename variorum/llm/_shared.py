"""What the operators share: tables that are kept for a job, and Python workers that give memory back."""

from __future__ import annotations

import ctypes
import time

import pyarrow as pa

from variorum.storage import discard, materialize, shared_dir, shared_path

__all__ = ["discard", "materialize", "shared_dir", "shared_path", "tidy", "tidy_both", "tidy_group"]

_given = [0.0]


def _give_back(pause: float) -> None:
    """Freed memory returns to the system, pause seconds after the last time at the earliest."""
    if time.monotonic() - _given[0] < pause:
        return
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone
    if trim is not None:
        trim(0)
    _given[0] = time.monotonic()


def tidy(run):
    """run, for mapInArrow.  Workers outlive their tasks, and several share an executor's memory."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _give_back(0)

    return tidied


def tidy_group(run):
    """run, for applyInArrow."""

    def tidied(table):
        found = run(table)
        _give_back(0.5)
        return found

    return tidied


def tidy_both(run):
    """run, for applyInArrow of two tables."""

    def tidied(left, right):
        found = run(left, right)
        _give_back(0.5)
        return found

    return tidied
