"""Planning policies: rows of a slice, and workers asked for."""

from __future__ import annotations

#: Bytes of a batch; limits of the adaptive worker choice.
BATCH_BYTES = 64 << 20
SMALL_BYTES, LARGE_BYTES, GROUP_BYTES, GROUPS_PER_FILE = 128 << 20, 768 << 20, 4 << 20, 256


def workers(n, most: int = 8) -> int:
    if isinstance(n, bool) or not isinstance(n, int):
        raise TypeError("workers must be an integer")
    if not 1 <= n <= most:
        raise ValueError(f"workers must be from 1 to {most}")
    return n


def adaptive_workers(requested: int, groups: int, most_in_file: int, size: int) -> int:
    """Workers worth starting for Parquet input: its row groups, the most of them in one file, its uncompressed bytes."""
    useful = min(requested, most_in_file)
    if min(requested, groups, most_in_file) <= 1:
        return 1
    if size <= SMALL_BYTES:
        return min(2, useful)
    fits = size >= LARGE_BYTES and -(-size // groups) >= GROUP_BYTES and most_in_file <= GROUPS_PER_FILE
    return min(3, useful) if fits else 1


def batch_cap(requested: int, rows: int, size: int) -> int:
    """Rows a slice of one file may have, so that a batch stays near BATCH_BYTES."""
    if requested < 1:
        raise ValueError("batch_size must be positive")
    if not rows or not size:
        return requested
    return min(requested, max(1, BATCH_BYTES // max(1, -(-size // rows))))
