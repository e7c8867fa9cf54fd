"""Column functions: all built from Spark's own expressions."""

from .fields import layout, number, unpack
from .text import cut_text, flatten_lines, tokens

__all__ = ["cut_text", "flatten_lines", "layout", "number", "tokens", "unpack"]
