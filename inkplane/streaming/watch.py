"""Files of a watched folder as a stream: a stability gate, batches one after the other, and failures that are tried again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FILES = "path string, modificationTime timestamp, length bigint, content binary"
STABLE = "path string, scan_no bigint, size bigint, mtime bigint"


def watched(spark: SparkSession, folder: str, pattern: str = "*", per_batch: int = 1) -> DataFrame:
    """New files of a folder, ``per_batch`` of them in a batch, with their bytes."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(folder)


def stable(scans: DataFrame) -> DataFrame:
    """Of a stream of scans(path, scan_no, size, mtime), those in which a path looks as in the scan just before.

    The state of a path is its last scan. A gap between scans starts over.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(parts)).sort_values("scan_no")
        out = []
        for r in rows.itertuples():
            seen = (int(r.scan_no), int(r.size), int(r.mtime))
            if last is not None and last[0] == seen[0] - 1 and last[1:] == seen[1:]:
                out.append((key[0], *seen))
            last = seen
        state.update(last)
        yield pd.DataFrame(out, columns=["path", "scan_no", "size", "mtime"])

    return scans.groupBy("path").applyInPandasWithState(step, STABLE, "scan_no bigint, size bigint, mtime bigint", "append", GroupStateTimeout.NoTimeout)


def process(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], out: str, failed: str, checkpoint: str, remove: bool = False) -> StreamingQuery:
    """Run ``handle`` on each batch; what it returns goes to ``out`` under the batch's number, failures to ``failed``.

    Batches that failed in earlier runs are tried again first, in order; their files stay where they are until they
    succeed, and ``failed`` holds what is still open. With ``remove``, the files of a batch are deleted once its output
    is written. A batch that the stream runs again after a crash is not handled twice: a mark beside the checkpoint
    tells that its output stands. Failed files that are gone are no longer tried.
    """
    spark = stream.sparkSession
    handled = f"{checkpoint}/handled"

    def attempt(batch: DataFrame, number: int) -> bool:
        try:
            handle(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        except Exception as e:  # the file stays for a later run, and the stream goes on
            batch.select("path", F.lit(str(e)[:500]).alias("reason")).write.mode("overwrite").parquet(f"{failed}/batch={number}")
            return False
        return True

    def drop(paths: list[str]) -> None:
        for p in paths if remove else []:
            _delete(spark, p)

    for number in _batches(spark, failed):
        where = f"{failed}/batch={number}"
        paths = [r.path for r in spark.read.schema("path string").parquet(where).collect() if _exists(spark, r.path)]  # one batch's files
        if not paths or attempt(spark.read.schema(FILES).format("binaryFile").load(paths), number):
            _delete(spark, where)  # before the files, so that none of them is tried without the others
            drop(paths)

    def each(batch: DataFrame, number: int) -> None:
        _delete(spark, f"{handled}/{number - 1}")  # batches come one after the other
        stands = _exists(spark, f"{handled}/{number}")
        if stands or attempt(batch, number):
            paths = [r.path for r in batch.select("path").collect()] if remove and not stands else []
            _fs(spark, handled).mkdirs(_path(spark, f"{handled}/{number}"))
            drop(paths)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _fs(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, name: str) -> bool:
    return _fs(spark, name).exists(_path(spark, name))


def _delete(spark: SparkSession, name: str) -> None:
    _fs(spark, name).delete(_path(spark, name), True)


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches written below a folder, ascending."""
    if not _exists(spark, folder):
        return []
    names = [x.getPath().getName() for x in _fs(spark, folder).listStatus(_path(spark, folder))]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch="))


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of an event stream by window and type, with a watermark for late events."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
