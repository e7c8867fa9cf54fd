"""Written stages that are deleted when their last reader has written its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .session import new_path, until_exit


class Stage:
    """A written table and how many stages have yet to read it."""

    def __init__(self, spark: SparkSession, path: str, schema: object, readers: int):
        self._spark, self.path, self._schema, self.readers = spark, path, schema, readers

    @property
    def freed(self) -> bool:
        return self.readers == 0

    def read(self) -> DataFrame:
        if self.freed:
            raise ValueError(f"{self.path} was freed after its last reader")
        return self._spark.read.schema(self._schema).parquet(self.path)

    def done(self) -> None:
        """One reader has written what it made of this."""
        if self.freed:
            raise ValueError(f"{self.path} has no readers left")
        self.readers -= 1
        if self.freed:
            self._delete()

    def _delete(self) -> None:
        target = self._spark._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(target, True)


class Stages:
    """The stages of one pipeline, in the session's shared folder.

    A stage is written as soon as it is asked for, and says how many later stages read it.
    When the last of them is written, its files go; so a chain of any length holds two
    stages at a time.  Inside ``with``, what is left is deleted at the end, but for what
    :meth:`result` gave.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._kept: list[Stage] = []

    def write(self, df: DataFrame, label: str, readers: int = 1) -> Stage:
        """Write a stage that ``readers`` later ones read."""
        if readers < 1:
            raise ValueError(f"a stage needs a reader, not {readers}")
        path = new_path(self._spark, label)
        df.write.parquet(path)
        stage = Stage(self._spark, until_exit(self._spark, path), df.schema, readers)
        self._kept.append(stage)
        return stage

    def derive(self, label: str, function: Callable[..., DataFrame], *inputs: Stage, readers: int = 1) -> Stage:
        """Write ``function`` of the inputs' tables; each of these has one reader less then.

        If writing fails, no input is given up.
        """
        stage = self.write(function(*[i.read() for i in inputs]), label, readers)
        for i in inputs:
            i.done()
        return stage

    def result(self, stage: Stage) -> DataFrame:
        """The table of a stage that stays until the driver ends."""
        self._kept.remove(stage)
        return stage.read()

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *error: object) -> None:
        for stage in self._kept:
            if not stage.freed:
                stage.readers = 0
                stage._delete()
        self._kept = []
