"""The log of results: numbered folders of Parquet, read by last write, fed by appends or by a stream, and compacted.

A write is a folder `seq=N` of its own that appears by one rename, so that a killed write leaves nothing behind. Appends
have even numbers, each higher than all before; a compaction of all up to 2k has the number 2k + 1, so that an append
that comes beside it stays the later one. The last write of a key is the one with the highest number.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


class Folders:
    """Numbered folders under a path of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self.place(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Those of finished writes, ascending."""
        place = self.place(self.path)
        if not self.files.exists(place):
            return []
        names = (s.getPath().getName() for s in self.files.listStatus(place))
        return sorted(int(n.removeprefix("seq=")) for n in names if n.startswith("seq="))

    def read(self) -> DataFrame | None:
        numbers = self.numbers()
        if not numbers:
            return None
        paths = [f"{self.path}/seq={n}" for n in numbers]
        return self.spark.read.option("basePath", self.path).parquet(*paths).withColumn("seq", F.col("seq").cast("long"))

    def write(self, rows: DataFrame, number: int) -> None:
        """The rows as folder `number`, which replaces one of that number."""
        draft = f"{self.path}/_draft-{uuid.uuid4().hex}"
        rows.write.parquet(draft)
        self.delete(number)
        if not self.files.rename(self.place(draft), self.place(f"{self.path}/seq={number}")):
            raise OSError(f"could not publish {self.path}/seq={number}")

    def delete(self, number: int) -> None:
        self.files.delete(self.place(f"{self.path}/seq={number}"), True)

    def clear(self) -> None:
        self.files.delete(self.place(self.path), True)


def last_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The whole row of each key's last write; partial maxima before the shuffle, so a hot key sends one row a task."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    last = F.max_by(F.struct(*rest), order).alias("last")
    return rows.groupBy(*keys).agg(last, F.max(order).alias(order)).select(*keys, "last.*", order)


class Log:
    """Results of earlier runs under a folder, a table for each phase; emptied at the start unless a run is resumed."""

    def __init__(self, spark: SparkSession, path: str | None, resume: bool):
        self.spark, self.path = spark, path.rstrip("/") if path else path
        if path and not resume:
            Folders(spark, path).clear()

    def _folders(self, phase: str) -> Folders:
        return Folders(self.spark, f"{self.path}/{phase}")

    def stored(self, phase: str, keys: list[str]) -> DataFrame | None:
        """(keys, fingerprint, result): the last result of each key; null if there's none."""
        held = self._folders(phase).read() if self.path else None
        return None if held is None else last_rows(held, keys, "seq").drop("seq")

    def append(self, phase: str, rows: DataFrame) -> None:
        if self.path:
            folders = self._folders(phase)
            numbers = folders.numbers()
            folders.write(rows, (numbers[-1] // 2 + 1) * 2 if numbers else 0)

    def compact(self, phase: str, keys: list[str], *, now: bool = False) -> None:
        """Put a phase's last writes into one folder.

        Folders that it replaces go with the next compaction, so that readers of today's can finish, or at once if
        `now`. The view is the same at every moment: before the new folder appears, with it beside the old ones, and
        after each of these is deleted, as the new one has the last write of every key up to its number.
        """
        folders = self._folders(phase)
        numbers = folders.numbers()
        for old in numbers:
            # What an earlier compaction has replaced.
            if any(n % 2 and n > old for n in numbers):
                folders.delete(old)
        numbers = folders.numbers()
        held = folders.read()
        if held is None or len(numbers) < 2:
            return
        top = numbers[-1] | 1
        folders.write(last_rows(held, keys, "seq").drop("seq"), top)
        for old in numbers if now else []:
            if old != top:
                folders.delete(old)

    def merged(self, phase: str, keys: list[str], rows: DataFrame, checkpoint: str, order: str) -> StreamingQuery:
        """Feed a phase from a stream of rows (keys, order and whatever else) until all files of today are read.

        Every micro-batch keeps the last row of each key by `order` and is written under its own number, so that one
        that is repeated after a crash replaces itself. `view` reads the log by the same order, so late files don't
        win over later writes.
        """
        folders = self._folders(phase)

        def put(batch: DataFrame, number: int) -> None:
            folders.write(last_rows(batch, keys, order), 2 * number)

        return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def view(self, phase: str, keys: list[str], order: str) -> DataFrame | None:
        """The last row of each key by an order of the rows' own."""
        held = self._folders(phase).read()
        return None if held is None else last_rows(held.drop("seq"), keys, order)


def phases(spark: SparkSession, path: str) -> Iterator[str]:
    """Names of the phases that a log holds."""
    at = Folders(spark, path)
    place = at.place(at.path)
    for status in at.files.listStatus(place) if at.files.exists(place) else []:
        name = status.getPath().getName()
        if status.isDirectory() and not name.startswith("_"):
            yield name
