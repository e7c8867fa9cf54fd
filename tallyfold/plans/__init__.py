"""The twelve batch jobs, from input folder to result folder."""

from . import jobs

__all__ = ["jobs"]
