"""Sinks."""

from .pairs import write_lines, write_pairs
from .ranges import key_ranges, read_range, write_ranges
from .swap import replacing

__all__ = ["key_ranges", "read_range", "replacing", "write_lines", "write_pairs", "write_ranges"]
