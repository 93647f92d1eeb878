"""Resumable passes over growing folders: only rows whose key is not done are processed.

A pass is a stream with the ``availableNow`` trigger: it takes what has arrived since
its checkpoint, in bounded batches, and ends. Each batch leaves out keys that the sink
already has, so a pass can be stopped, repeated or fed the same file twice.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.session import cut


class SourceGone(RuntimeError):
    """Nothing but missing files: the source is not there, so the pass stops before it records anything."""


MOST_MISSING = 10


def _done(spark: SparkSession, sink: str, keys: Sequence[str], error: str | None = None) -> DataFrame | None:
    """Keys that count as done: rows of failures do not."""
    try:
        got = spark.read.parquet(sink)
        return (got.where(F.col(error).isNull()) if error else got).select(*keys)
    except AnalysisException:  # nothing written yet
        return None


def run_pass(
    spark: SparkSession, source: str, sink: str, checkpoint: str, keys: Sequence[str], process: Callable[[DataFrame], DataFrame],
    glob: str | None = None, files_per_batch: int = 1000, error: str | None = None, missing: Callable[[Column], Column] | None = None, most_missing: int = MOST_MISSING,
) -> None:
    """Process the new rows of a parquet folder into ``sink`` (parquet, append-only, one row per key).

    ``process`` must keep the key columns. Repeated keys within a batch count once. Rows
    whose ``error`` column is set are recorded and left to ``retry``. With ``missing``, a
    batch of which ``most_missing`` rows or more are missing and none succeeded raises
    SourceGone and is not written; the next pass takes it again.
    """
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    stream = spark.readStream.schema(reader.parquet(source).schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        stream = stream.option("pathGlobFilter", glob)

    def batch(df: DataFrame, _: int) -> None:
        new = df.dropDuplicates(list(keys))
        done = _done(df.sparkSession, sink, keys, error)
        if done is not None:
            new = new.join(done, list(keys), "left_anti")
        out = process(new)
        if error and missing:
            out = cut(out)
            _check(out, error, missing, most_missing)
        out.write.mode("append").parquet(sink)

    stream.parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _check(out: DataFrame, error: str, missing: Callable[[Column], Column], most: int) -> None:
    gone, fine = out.agg(F.count_if(missing(F.col(error))), F.count_if(F.col(error).isNull())).first()
    if gone >= most and not fine:
        raise SourceGone(f"{gone} files are missing and none was read")


def retry(
    spark: SparkSession, source: DataFrame, sink: str, keys: Sequence[str], process: Callable[[DataFrame], DataFrame], error: str,
    missing: Callable[[Column], Column] | None = None, most_missing: int = MOST_MISSING,
) -> int:
    """Process again the rows of ``source`` of which the sink has failures only; returns how many.

    Their new rows, failures too, are appended; ``latest_success`` reads the outcome.
    """
    done = _done(spark, sink, keys, error)
    seen = _done(spark, sink, keys)
    if done is None or seen is None:
        return 0
    failed = seen.distinct().join(done, list(keys), "left_anti")
    again = cut(source.dropDuplicates(list(keys)).join(failed, list(keys), "left_semi"))
    out = cut(process(again))
    if missing:
        _check(out, error, missing, most_missing)
    out.write.mode("append").parquet(sink)
    return again.count()


def latest_success(sink: DataFrame, keys: Sequence[str], error: str) -> DataFrame:
    """Rows of keys that succeeded, and one failure of each key that never did."""
    fine = sink.where(F.col(error).isNull())
    return fine.unionByName(sink.where(F.col(error).isNotNull()).join(fine.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys)))


def folder_and_glob(path: str) -> tuple[str, str | None]:
    """A table may be one file or a folder of parts; a stream reads folders."""
    local = path.removeprefix("file://")
    return (os.path.dirname(path), os.path.basename(path)) if os.path.isfile(local) else (path, None)
