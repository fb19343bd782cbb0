"""Load manifest (S3): what was read of every file, against what it holds.

A failure belongs to a table only if Spark says that a file could not be read
and which; that is its error condition, not the text of a message or a stack
trace.  Everything else (memory, disks, lost executors, bugs) is an error of the
job and is raised."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesift.functions import text as tx

# Spark's conditions for files that can't be read.
READ_CONDITIONS = ("FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "CANNOT_READ_FILE", "MALFORMED_CSV_RECORD", "PATH_NOT_FOUND")

MANIFEST_SCHEMA = "table_idx int, table_name string, status string, error string, files bigint, footer_rows bigint, rows_read bigint"


@dataclass(frozen=True)
class ReadFailure:
    path: str | None
    error: str


def _causes(e: BaseException):
    """Error conditions and parameters of an exception and of its causes."""
    while e is not None:
        if isinstance(e, PySparkException):
            yield e.getCondition(), e.getMessageParameters() or {}
        # the exception of the JVM, whether PySpark has wrapped it or not
        origin = getattr(e, "_origin", None) or getattr(e, "java_exception", None)
        while origin is not None:
            try:
                condition = origin.getCondition()
                parameters = dict(origin.getMessageParameters() or {})
            except Exception:  # not an exception of Spark's own
                condition, parameters = None, {}
            yield condition, parameters
            origin = origin.getCause()
        e = e.__cause__


def read_failure(e: BaseException) -> ReadFailure | None:
    """The file that ended a job, if one that can't be read did; else None."""
    for condition, parameters in _causes(e):
        if condition and condition.split(".")[0] in READ_CONDITIONS:
            return ReadFailure(parameters.get("path"), condition)
    return None


def _hashable(field: T.StructField):
    """A column in a form that Spark hashes (maps as text)."""
    column = F.col(tx.quoted(field.name))
    return F.to_json(column) if "map<" in field.dataType.simpleString() else column


def scanned_rows(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    """(table_idx, files, footer_rows, rows_read): rows by the files' footers (a
    scan without columns) and rows whose columns were all decoded, per file."""
    def of(idx: int, df: DataFrame) -> DataFrame:
        file = F.col("_metadata.file_path").alias("file")
        footer = df.select(file).groupBy("file").agg(F.count(F.lit(1)).alias("footer_rows"))
        # the digest asks for every column of every row
        digest = F.xxhash64(*(_hashable(f) for f in df.schema.fields))
        read = df.select(file, digest.alias("digest")).groupBy("file").agg(
            F.count(F.lit(1)).alias("rows_read"), F.bit_xor("digest").alias("digest"))
        both = footer.join(read.where("digest is not null"), "file", "left")
        return both.agg(F.count(F.lit(1)).alias("files"), F.sum("footer_rows").alias("footer_rows"),
                        F.coalesce(F.sum("rows_read"), F.lit(0)).alias("rows_read")).select(F.lit(idx).alias("table_idx"), "*")

    return reduce(DataFrame.unionByName, [of(i, df) for i, df in parts])
