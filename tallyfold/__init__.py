"""Batch analytics operators that take DataFrames and return DataFrames.

Every operator only declares a plan: nothing runs until the caller acts on the
result.  The exceptions are named in their own docstrings (the sinks, and the
check for documents that span several rows in :mod:`tallyfold.operators.terms`).
"""

__version__ = "0.1.0"
