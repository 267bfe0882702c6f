"""Caches of DataFrames with a bound in bytes, keyed by what determines their rows."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, SparkSession


class FrameCache:
    """Persisted frames, least recently used ones released once their estimated sizes exceed ``capacity`` bytes.

    A frame that alone exceeds the capacity is passed through unpersisted.
    """

    def __init__(self, capacity: int):
        self.capacity, self.hits, self.misses, self.evicted = capacity, 0, 0, 0
        self._held: OrderedDict[Hashable, tuple[DataFrame, int]] = OrderedDict()

    def get(self, key: Hashable, make: Callable[[], DataFrame]) -> DataFrame:
        if key in self._held:
            self.hits += 1
            self._held.move_to_end(key)
            return self._held[key][0]
        self.misses += 1
        frame = make()
        size = int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        if size > self.capacity:
            return frame
        self._held[key] = frame.persist(), size
        while sum(n for _, n in self._held.values()) > self.capacity:
            _, (old, _) = self._held.popitem(last=False)
            old.unpersist()
            self.evicted += 1
        return frame

    def clear(self) -> None:
        while self._held:
            self._held.popitem()[1][0].unpersist()


class FileCache(FrameCache):
    """A ``FrameCache`` keyed by the paths, sizes and times of a folder's files: new files are a new key."""

    def __init__(self, spark: SparkSession, capacity: int):
        super().__init__(capacity)
        self.spark = spark

    def fingerprint(self, path: str) -> tuple:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        found = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
        return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))

    def read(self, path: str) -> DataFrame:
        return self.get((path, self.fingerprint(path)), lambda: self.spark.read.parquet(path))
