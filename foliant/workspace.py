"""Written tables that cut lineage and survive lost executors.

Tables go to the folder that the cluster names in ``spark.checkpoint.dir``; only where that is unset
(tests, a laptop) does a temporary folder of this machine stand in.
"""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="foliant-")
    return _fallback[app]


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Have Arrow batches hold at most `rows` rows and about `size` bytes, unless the session sets numbers of its own.

    At Spark's default of 10,000 rows, whole texts or sets of shingles make batches of 100 MB, held by the
    executor and by its Python worker at once. So do 1,000 pairs of long texts, which a join sorts side by side.
    """
    conf, key, most = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(rows))
    if conf.get(most, None) is None:
        conf.set(most, str(size))


class Workspace:
    """Temporary Parquet tables of one query."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: list[str] = []

    def put(self, df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
        """Write, in a folder for each value of `by` if given, and reread; the returned frame starts at the files."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path, partitionBy=by)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._foliant_path = path
        self.paths.append(path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        self._delete([df._foliant_path for df in frames])

    def only(self, *frames: DataFrame) -> None:
        """Delete all tables written so far but these."""
        kept = {df._foliant_path for df in frames}
        self._delete([p for p in self.paths if p not in kept])

    def _delete(self, paths: list[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        for path in paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            self.paths.remove(path)

    def sweep(self) -> None:
        """Let Spark release the shuffle files of finished steps: it does so once the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)  # the cleaner works in the background
