"""Finding files, telling their format by content, and their identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the first bytes of OLE2 and ZIP containers
OLE2, ZIP = "D0CF11E0A1B11AE1", "504B0304"


def binary_files(spark: SparkSession, path: str, recursive: bool = True, glob: str = "*.{xlsx,xls,csv}") -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path)


def profiles(files: DataFrame) -> DataFrame:
    """path, size, format (xls, xlsx or csv, whatever the name says), sha256, file_id (its first 16 digits), by path."""
    head = F.hex(F.substring("content", 1, 8))
    kind = F.when(head == OLE2, "xls").when(F.startswith(head, F.lit(ZIP)), "xlsx").otherwise("csv")
    digest = F.sha2("content", 256)
    return files.select("path", F.col("length").alias("size"), kind.alias("format"), digest.alias("sha256"), F.substring(digest, 1, 16).alias("file_id")).orderBy(F.lower("path"))
