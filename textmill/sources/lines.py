"""Lines of text files with their numbers, files split by byte ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.operators.tables import side, stored


def text_lines(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """(file, start, value) of each line: start is the first byte of the range that Spark's reader took it from."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each line's place in its range; a range's lines come in order, in one task."""
    held, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = batch.column(0), batch.column(1)
        new = np.ones(len(file), bool)
        new[1:] = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(start[1:], start[:-1])).to_numpy(zero_copy_only=False)
        new[0] = (file[0].as_py(), start[0].as_py()) != held
        at = np.arange(len(file))
        first = np.maximum.accumulate(np.where(new, at, -1))
        place = np.where(first < 0, at + n, at - first)
        held, n = (file[-1].as_py(), start[-1].as_py()), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=["file", "start", "value", "place"])


def numbered_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(file, line_number from 1, line) of each line of the files, without a byte-order mark at a file's start.

    A large file is read by many tasks, each a range of its bytes; a number is the line's place in its range and the lines of
    the file's ranges before it, a row a range. No line is shuffled; the lines are a stored table, so that a range is cut the
    same in both. Lines end with \\n, \\r\\n or \\r; an empty file has none."""
    lines = stored(text_lines(spark, path, pattern).mapInArrow(_placed, "file string, start long, value string, place long"), "lines")
    ranges = lines.groupBy("file", "start").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    ranges = stored(ranges.select("file", "start", F.coalesce(before, F.lit(0)).alias("before")), "ranges")
    number = F.col("before") + F.col("place") + 1
    line = F.when(number == 1, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value"))
    return lines.join(side(ranges), ["file", "start"]).select("file", number.alias("line_number"), line.alias("line"))
