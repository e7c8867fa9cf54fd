"""Replacing a result folder so that a failure leaves the old one."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def replacing(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder to write to instead of ``path``; it takes that place when the block ends well.

    The result is written beside the old one, under a name that readers of the parent
    folder skip.  Then the old folder is renamed, the new one takes its name, and the old
    one is deleted.  If the block fails, the new folder is deleted and the old one was never
    touched.  If the driver dies between the two renames, the next call puts the old folder
    back first.  A job may read the folder that it replaces.
    """
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    path = path.rstrip("/")
    parent, name = posixpath.split(path)
    target, fresh, old = jvm_path(path), jvm_path(f"{parent}/_{name}.{uuid.uuid4().hex}"), jvm_path(f"{parent}/_{name}.old")
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(old):
        if store.exists(target):  # died after the swap, before the old result was deleted
            store.delete(old, True)
        elif not store.rename(old, target):
            raise OSError(f"{old.toString()} holds the last result of {path} and cannot be moved back")
    try:
        yield fresh.toString()
    except BaseException:
        store.delete(fresh, True)
        raise
    if store.exists(target) and not store.rename(target, old):
        store.delete(fresh, True)
        raise OSError(f"{path} cannot be moved aside")
    if not store.rename(fresh, target):
        store.rename(old, target)
        store.delete(fresh, True)
        raise OSError(f"the new result cannot be moved to {path}")
    store.delete(old, True)
