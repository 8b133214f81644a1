"""Sliced columnar table files on Spark: typed scans, slices, encodings, exact layouts, row-key indexes."""

from .functions.types import FormatError

__all__ = ["FormatError"]
