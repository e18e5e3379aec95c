"""Folds of a stream's batches, compacted in levels.

Every micro-batch stores the fold of its own rows as level 0, ``path/level=0/last=N``. After ``every`` folds of one level
they are merged into one fold of the next level, so of 1,000 batches with ``every`` = 16 a reader opens at most 45 folders, and
a row is written again once per level.

* A fold counts once its marker file is there, which is made after its rows are written. What a crash leaves without a
  marker is not read, and is written over when the batch is replayed.
* Replaying a batch gives the same folds; one that is marked already is not made again, as its inputs may be gone.
* The inputs of a merge stay until the next merge of their level is marked, so a reader that listed them can finish.

A reader covers the batches from the first on, each time with the highest marked fold that begins there, and
stops at the first gap: it sees a state that was complete after some batch, never half of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

EVERY = 16
_MARKER = "_MARKED"


class Store:
    """The folds below one folder, which every machine of the cluster shares."""

    def __init__(self, spark: SparkSession, path: str, every: int = EVERY):
        if every < 2:
            raise ValueError("a level is merged from two folds at least")
        self.spark, self.path, self.every = spark, path.rstrip("/"), every
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    @staticmethod
    def _name(level: int, last: int) -> str:
        return f"level={level}/last={last}"

    def marked(self) -> set[tuple[int, int]]:
        """(level, last batch) of every fold that counts."""
        found = self._fs.globStatus(self._at(f"level=*/last=*/{_MARKER}")) or []
        names = [str(f.getPath()).split("/")[-3:-1] for f in found]
        return {(int(level.split("=")[1]), int(last.split("=")[1])) for level, last in names}

    def is_marked(self, level: int, last: int) -> bool:
        return self._fs.exists(self._at(f"{self._name(level, last)}/{_MARKER}"))

    def write(self, rows: DataFrame, level: int, last: int) -> None:
        """Store a fold and mark it; rows of an earlier try without a marker are replaced."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{self._name(level, last)}")
        self._fs.create(self._at(f"{self._name(level, last)}/{_MARKER}"), True).close()

    def read(self, folds: list[tuple[int, int]]) -> DataFrame:
        names = [f"{self.path}/{self._name(level, last)}" for level, last in folds]
        return self.spark.read.parquet(*names)

    def cover(self) -> list[tuple[int, int]]:
        """The folds a reader needs: from the first batch on, always the highest that begins there."""
        have, out, start = self.marked(), [], 0
        levels = sorted({level for level, _ in have}, reverse=True)
        while True:
            step = next(((k, start + self.every**k - 1) for k in levels if (k, start + self.every**k - 1) in have), None)
            if step is None:
                return out
            out.append(step)
            start = step[1] + 1

    def drop(self, level: int, first: int, last: int) -> None:
        """Remove the folds of ``level`` that end between two batches."""
        for k, end in self.marked():
            if k == level and first <= end <= last:
                self._fs.delete(self._at(self._name(k, end)), True)

    def add(self, rows: DataFrame, batch: int, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Store the fold of one batch and make the merges it completes."""
        if not self._covered(batch):
            self.write(rows, 0, batch)
        level, span = 0, self.every
        while (batch + 1) % span == 0:
            if not self.is_marked(level + 1, batch):
                step = span // self.every
                parts = [(level, end) for end in range(batch - span + step, batch + 1, step)]
                self.write(merge(self.read(parts)), level + 1, batch)
            # The inputs of the merge before this one: nobody who began reading since then has listed them.
            self.drop(level, batch - 2 * span + 1, batch - span)
            level, span = level + 1, span * self.every

    def _covered(self, batch: int) -> bool:
        """Is the fold of the batch marked, by itself or inside a merge that ends with it?"""
        level, span = 0, 1
        while (batch + 1) % span == 0:
            if self.is_marked(level, batch):
                return True
            level, span = level + 1, span * self.every
        return False


def to_folds(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    fold: Callable[[DataFrame, int], DataFrame],
    merge: Callable[[DataFrame], DataFrame],
    mode: str = "append",
    every: int = EVERY,
) -> StreamingQuery:
    """Fold every micro-batch (``fold(rows, batch id)``), compact in levels, and stop when caught up."""
    spark = stream.sparkSession

    def save(batch: DataFrame, batch_id: int) -> None:
        Store(spark, path, every).add(fold(batch, batch_id), batch_id, merge)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).foreachBatch(save).start()


def read_folds(spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], every: int = EVERY) -> DataFrame | None:
    """All batches stored so far as one fold; None before the first one."""
    store = Store(spark, path, every)
    folds = store.cover()
    return merge(store.read(folds)) if folds else None
