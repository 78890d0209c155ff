"""Reading many price lists at once, from any file system, so that a list that fails is a row and not the end of all.

Files come from Spark's own binaryFile reader and are read in one pass. What a file holds and whether it could be read are
two channels of one table: a file's rows are there only if the whole file was read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .files import binary_files
from .sheets import csv_rows, xlsx_rows

#: Rows of a batch that a task gives back.
BATCH = 2000
SCHEMA = "path string, sheet string, source_row int, cells array<string>, n_rows int, error string"


def _rows_of(raw: bytes, sheet: str | None, delimiter: str | None) -> Iterator[tuple[str | None, int, list[str | None]]]:
    if raw[:4] == b"PK\x03\x04":
        yield from xlsx_rows(raw, sheet)
    elif raw[:8] == bytes.fromhex("D0CF11E0A1B11AE1"):
        raise ValueError("the older binary workbook format is not read")
    else:
        for number, cells in csv_rows(raw, delimiter):
            yield None, number, cells


def _plain(path: Column) -> Column:
    """A path without what file systems write in several ways before it."""
    return F.regexp_replace(path, r"^([a-z0-9]+):/+", "$1:/")


def grids(spark: SparkSession, path: str, sheet: str | None = None, delimiter: str | None = None, glob: str = "*.{xlsx,xls,csv}") -> tuple[DataFrame, DataFrame]:
    """(rows: path, sheet, source_row, cells; files: path, n_rows, error), every file under path once.

    A file whose bytes cannot be had, or that has none, has the error "unreadable or empty"; one that cannot be understood
    has the reader's."""
    # scans pass over files of no bytes, so the names are those of the file index: as many as there are lists
    named = binary_files(spark, path, glob=glob).inputFiles()
    listed = spark.createDataFrame([(unquote(n),) for n in named], "path string").withColumn("__name", _plain(F.col("path")))
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    names = ["path", "sheet", "source_row", "cells", "n_rows", "error"]
    types = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch["path"].to_pylist(), batch["content"]):
                try:
                    # rows count only when the file's end was reached
                    found = list(_rows_of(raw.as_py(), sheet, delimiter))
                    status = (file, None, None, None, len(found), None)
                except Exception as e:  # any content is possible, and each has its row
                    found, status = [], (file, None, None, None, 0, f"{type(e).__name__}: {e}")
                for s in range(0, len(found), BATCH):
                    yield batch_of([(file, name, number, cells, None, None) for name, number, cells in found[s : s + BATCH]])
                yield batch_of([status])

    read = table(reader.load(path).select("path", "content").mapInArrow(parse, SCHEMA))
    status = read.where("n_rows is not null").select("path", "n_rows", "error")
    files = listed.withColumnRenamed("path", "__listed").join(status.withColumn("__name", _plain(F.col("path"))), "__name", "left").select(F.coalesce("path", "__listed").alias("path"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.when(F.col("n_rows").isNull(), "unreadable or empty").otherwise(F.col("error")).alias("error"))
    return read.where("n_rows is null").select("path", "sheet", "source_row", "cells"), files
