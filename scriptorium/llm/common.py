"""Plumbing shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components, hinted, spread_join, with_ids
from ..session import ship
from ..storage import discard, fresh_path, stash, work_folder

__all__ = ["ARROW_ROWS", "components", "discard", "fresh_path", "hinted", "lean", "one_of_each", "small_batches", "spread_join", "stash", "with_ids", "work_folder"]

#: Rows handed to a Python worker at a time; long texts are common, so batches stay small.
ARROW_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Makes ready for Python workers: they can import this package, and an Arrow batch of this session has few rows; a smaller setting is left alone."""
    ship(spark)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= ARROW_ROWS:
        spark.conf.set(setting, str(ARROW_ROWS))


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs without those whose group (doc_id, component_id) another doc_id stands for, all columns as they were. Rows that share a doc_id stay or go together."""
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return with_ids(docs, stash(groups.groupBy("doc_id").agg(stays.alias("stays")).where("not stays").select("doc_id"), "dropped"), "left_anti")


def lean(of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """of, after which a Python worker, that later tasks use again, gives the memory it has freed back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from of(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run
