"""The data model: versions of keys, operations, errors.

versions    key, ts (bigint, from 1), op (1 put, 2 delete), value; one row for each (key, ts)
log         offset, op (3 is a commit marker), ts, key, value, status (ok, torn, corrupt, invalid_op)

Keys and values may have any orderable type; BINARY orders by unsigned bytes. A deleted key is a row with
op 2, never a null value, so that an empty value is not a missing one. Versions are ordered by key
ascending, ts descending on two columns (an encoded key puts `ab` before `a`, which is not that order).
"""

from __future__ import annotations

PUT, DELETE, COMMIT = 1, 2, 3
DATA, CONFIG = 0, 1
#: No vote in a term.
NO_VOTE = -1
#: Return time of an operation that never returned.
INFINITY = (1 << 63) - 1


class StoreError(Exception):
    """Base of the errors below."""


class KeyNotFound(StoreError):
    pass


class InvalidOp(StoreError):
    pass


class BadLog(StoreError):
    """A replicated log file without its magic number."""
