"""Tables that grow by a micro-batch at a time, with few files and without rewriting their history.

Batch n is segment n of level 0. Whenever ``fan`` segments of a level are complete, they are merged into one
segment of the next level, so each row is rewritten once per level, and after n batches a table consists of
fewer than ``fan`` segments on each of log(n) levels. Which segments make up the table after batch n
follows from the digits of n + 1 in base ``fan``; nothing is looked up and no list of files has to be kept
in step with the files.

A batch that is run again overwrites what it wrote, merged segments included: they are built from segments
that are still there. The parts of a merged segment are removed only when the next segment of its level is
built, so that readers of an earlier batch, and a repetition of the last one, still find them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FAN = 8


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the file system that Spark reads it from."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class SegmentTable:
    """One table under a folder; the batches are numbered from 0 without gaps.

    ``merge`` turns the rows of several segments into rows of one, for instance sums by key. It has to be
    associative, and is applied to every read as well. With ``partition``, segments are laid out by that column.
    """

    def __init__(
        self, spark: SparkSession, folder: str, merge: Callable[[DataFrame], DataFrame] | None = None,
        partition: str | None = None, fan: int = FAN,
    ):
        self.spark, self.folder, self.fan = spark, folder.rstrip("/"), fan
        self.merge, self.partition = merge or (lambda rows: rows), partition
        self._schema = None

    def _path(self, level: int, number: int) -> str:
        return f"{self.folder}/level={level}/segment={number}"

    def segments(self, batch_id: int) -> list[tuple[int, int]]:
        """(level, number) of the segments that hold batches 0 to ``batch_id``."""
        found, number, level = [], 0, 0
        while self.fan ** (level + 1) <= batch_id + 1:
            level += 1
        left = batch_id + 1
        for level in range(level, -1, -1):
            number *= self.fan  # in segments of this level
            take = left // self.fan**level
            found += [(level, number + k) for k in range(take)]
            number, left = number + take, left % self.fan**level
        return found

    def _write(self, rows: DataFrame, level: int, number: int) -> None:
        out = rows.write.mode("overwrite")
        if self.partition:
            rows = rows.hint("rebalance", self.partition)
            out = rows.write.mode("overwrite").partitionBy(self.partition)
        out.parquet(self._path(level, number))

    def _read(self, segments: list[tuple[int, int]]) -> DataFrame:
        if self._schema is None:
            self._schema = self.spark.read.parquet(f"{self.folder}/schema").schema
        paths = [self._path(*s) for s in segments]
        if not paths:
            return self.spark.createDataFrame([], self._schema)
        # the folder as base path: level and segment are then no conflict with the table's own partitions
        found = self.spark.read.schema(self._schema).option("basePath", self.folder).parquet(*paths)
        return self.merge(found.select(*self._schema.names))

    def write(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Stores the rows of a batch; returns them as stored."""
        if batch_id == 0:
            rows.limit(0).write.mode("overwrite").parquet(f"{self.folder}/schema")
        self._write(rows, 0, batch_id)
        level, done = 1, batch_id + 1
        while done % self.fan**level == 0:
            number = done // self.fan**level - 1
            parts = range(number * self.fan, (number + 1) * self.fan)
            self._write(self._read([(level - 1, k) for k in parts]), level, number)
            for old in range((number - 1) * self.fan, number * self.fan) if number else ():
                remove(self.spark, self._path(level - 1, old))
            level += 1
        return self.batch(batch_id)

    def batch(self, batch_id: int) -> DataFrame:
        """The rows of one recent batch."""
        return self._read([(0, batch_id)])

    def read(self, batch_id: int) -> DataFrame:
        """The rows of all batches up to this one."""
        return self._read(self.segments(batch_id))
