"""The lake: a folder of tables (S1-S5) and its long ``cells`` form.

A lake table is one file (CSV or Parquet) directly inside the lake folder;
its name is the file name including the extension and tables are numbered in
path order.  Only metadata is handled on the driver (the file listing, the
schemas, one row per table and per column); cell data is only ever touched by
Spark jobs.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesift.functions import text as tx
from lakesift.plans.util import maybe_broadcast

TABLE_DIM_SCHEMA = T.StructType([
    T.StructField("table_idx", T.IntegerType(), False),
    T.StructField("table_name", T.StringType(), False),
    T.StructField("n_cols", T.IntegerType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("error", T.StringType(), True),
])

COLUMN_DIM_SCHEMA = T.StructType([
    T.StructField("table_idx", T.IntegerType(), False),
    T.StructField("col_idx", T.IntegerType(), False),
    T.StructField("column_name", T.StringType(), False),
    T.StructField("src_class", T.StringType(), False),
])

#: Most part files whose order is put into the plan, and the bytes of a table of
#: file names that is broadcast.
ORDER_FILES, FILES_BYTES = 64, 32 << 20
ONE_SLASH = "^([A-Za-z][A-Za-z0-9+.-]*):/+"

#: Lines read for a header that spans lines, and the column of records that don't fit.
HEADER_LINES = 200
BAD_RECORD = "_bad_record"
#: Cells that mark rows of CSV tables: every row, and rows with too many fields.
ROW_MARK, BAD_MARK = -1, -2

CELL_SCHEMA_DDL = "table_idx int, col_idx int, value string"


@dataclass(frozen=True)
class LakeTable:
    table_idx: int
    name: str
    path: str
    fmt: str


@dataclass
class _Loaded:
    df: DataFrame
    columns: list[tuple[str, str, T.DataType]]  # (source column, lake name, type)
    size_bytes: int | None = None


def list_lake(spark: SparkSession, root: str, pattern: str = "*.csv") -> list[str]:
    """Files and folder tables matching ``pattern`` directly in ``root``,
    sorted by path.  File system errors are raised, never an empty lake."""
    sc = spark.sparkContext
    hpath = sc._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/" + pattern)
    fs = hpath.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(sc._jvm.org.apache.hadoop.fs.Path(root)):
        raise FileNotFoundError(f"no such lake folder: {root}")
    return sorted(s.getPath().toString() for s in fs.globStatus(hpath) or [])


def lake_version(spark: SparkSession, root: str, pattern: str) -> int:
    """Hash of the files of a lake folder with their sizes and times of change."""
    sc = spark.sparkContext
    hpath = sc._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/" + pattern)
    fs, seen = hpath.getFileSystem(sc._jsc.hadoopConfiguration()), []
    todo = list(fs.globStatus(hpath) or [])
    while todo:
        s = todo.pop()
        seen.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        if s.isDirectory():
            todo += list(fs.listStatus(s.getPath()))
    return hash(tuple(sorted(seen)))


def header_names(lines: list[str]) -> list[str]:
    """Column names from the first lines of a CSV text: the first record that
    isn't blank (it may span lines inside quotes); a blank name is named by its
    position, duplicates are numbered."""
    for record in csv.reader(io.StringIO("\n".join(lines), newline="")):
        if len(record) > 1 or (record and record[0].strip()):
            return dedupe_names([n if n != "" else f"Unnamed: {i}" for i, n in enumerate(record)])
    raise ValueError("No columns to parse from file")


def dedupe_names(names: list[str]) -> list[str]:
    """Duplicate header names become ``a, a.1, a.2`` (first one unchanged)."""
    seen: dict[str, int] = {}
    used = set(names)
    out = []
    for n in names:
        if n in seen:
            k = seen[n]
            cand = f"{n}.{k}"
            while cand in used:
                k += 1
                cand = f"{n}.{k}"
            seen[n] = k + 1
            used.add(cand)
            out.append(cand)
        else:
            seen[n] = 1
            out.append(n)
    return out


def _one_slash(path: F.Column) -> F.Column:
    """A file's URI, written with one slash after its scheme."""
    return F.regexp_replace(path, ONE_SLASH, "$1:/")


def _plain(path: str) -> str:
    """The path of a URI, without a slash at its end."""
    return unquote(urlsplit(path).path).rstrip("/")


def by_name(df: DataFrame, names: list[str], headers: dict[str, list[str]]) -> DataFrame:
    """Columns by name where part files have them in another order than ``names``;
    part files of other columns are an error."""
    orders: dict[tuple[int, ...], list[str]] = {}
    for file, own in headers.items():
        if own != names:
            if sorted(own) != sorted(names):
                raise ValueError(f"part files with different columns: {posixpath.basename(file)}")
            orders.setdefault(tuple(own.index(n) for n in names), []).append(file)
    if not orders:
        return df
    file = F.col("_metadata.file_path")
    columns = []
    for i in range(len(names)):
        column = F.col(f"_c{i}")
        for order, files in orders.items():
            column = F.when(file.isin(files), F.col(f"_c{order[i]}")).otherwise(column)
        columns.append(column.alias(f"_c{i}"))
    return df.select(*columns, BAD_RECORD, "_metadata")


class Lake:
    """Tables of a lake plus their load status (S3)."""

    def __init__(self, spark: SparkSession, tables: list[LakeTable],
                 rebalance_bytes: int = 2 << 20, schema_threads: int = 16):
        self.spark = spark
        self.tables = tables
        self.csv_files = self._scan_csv()
        self.rebalance_bytes = rebalance_bytes
        self.loaded: dict[int, _Loaded] = {}
        self.errors: dict[int, str] = {}

        def load(t: LakeTable):
            try:
                return t.table_idx, self._load(t), None
            except Exception as e:  # S3: the table takes part in no pair
                return t.table_idx, None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"

        # Schema resolution is driver-side metadata work (footers, header
        # lines); a thread pool overlaps it for lakes with many files.
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(max_workers=max(1, min(schema_threads, len(tables) or 1))) as pool:
            for idx, ld, err in pool.map(load, tables):
                if ld is not None:
                    self.loaded[idx] = ld
                else:
                    self.errors[idx] = err

    # -- construction -----------------------------------------------------
    @classmethod
    def from_folder(cls, spark: SparkSession, root: str, fmt: str = "csv", **kw) -> "Lake":
        paths = list_lake(spark, root, f"*.{fmt}")
        return cls.from_paths(spark, paths, **kw)

    @classmethod
    def from_paths(cls, spark: SparkSession, paths: list[str], **kw) -> "Lake":
        tables = []
        for i, p in enumerate(paths):
            name = posixpath.basename(p.rstrip("/"))
            fmt = "csv" if name.lower().endswith(".csv") else "parquet"
            tables.append(LakeTable(i, name, p, fmt))
        return cls(spark, tables, **kw)

    def _load(self, t: LakeTable) -> _Loaded:
        if t.fmt == "parquet":
            df = self.spark.read.parquet(t.path)
            cols = [(f.name, f.name, f.dataType) for f in df.schema.fields]
            if not cols:
                raise ValueError("table has no columns")
            return _Loaded(df, cols, self._size(t.path))
        # CSV: every column read as text, by position; names from the header
        if t.name.startswith(("_", ".")):
            raise ValueError("hidden name: Spark's readers skip it")
        multiline, headers = self.csv_files.get(t.table_idx, (False, {}))
        if not headers:
            raise ValueError("No columns to parse from file")
        headers = {f: self._long_header(f) if line.count('"') % 2 else header_names([line]) for f, line in headers.items()}
        names = headers[min(headers)]
        fields = [T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))]
        schema = T.StructType([*fields, T.StructField(BAD_RECORD, T.StringType())])
        df = (self.spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", BAD_RECORD).option("escape", '"')
              .option("multiLine", multiline).option("enforceSchema", True)
              .csv(t.path))
        cols = [(f.name, name, T.StringType()) for f, name in zip(fields, names)]
        return _Loaded(by_name(df, names, headers), cols, self._size(t.path))

    def _long_header(self, file: str) -> list[str]:
        """Names of a header that spans lines inside quotes."""
        return header_names([r[0] for r in self.spark.read.text(file).limit(HEADER_LINES).collect()])

    def _scan_csv(self) -> dict[int, tuple[bool, dict[str, str]]]:
        """Of each CSV table, from one distributed pass over all of them: whether
        a line break stands inside quotes (a line with an odd number of quotes;
        only such tables are read unsplit), and each file's first line that
        isn't blank."""
        idx = [t.table_idx for t in self.tables if t.fmt == "csv" and not t.name.startswith(("_", "."))]
        if not idx:
            return {}
        odd = (F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
        start = (F.col("_metadata.file_block_start") == 0) & F.col("value").rlike("\\S")
        lines = self.spark.read.text([self.tables[i].path for i in idx]).select(
            F.col("_metadata.file_path").alias("file"), odd.alias("odd"),
            F.when(start, F.col("value")).alias("line"), F.when(start, F.monotonically_increasing_id()).alias("at"))
        files = lines.groupBy("file").agg(F.max("odd").alias("odd"), F.min_by("line", "at").alias("line")).collect()
        out: dict[int, tuple[bool, dict[str, str]]] = {}
        of_path = {_plain(self.tables[i].path): i for i in idx}
        for r in files:
            i = of_path.get(_plain(r["file"]), of_path.get(_plain(posixpath.dirname(r["file"]))))
            if i is not None:
                multiline, headers = out.setdefault(i, (False, {}))
                if r["line"] is not None:
                    headers[r["file"]] = r["line"]
                out[i] = multiline or r["odd"], headers
        return out

    def _size(self, path: str) -> int | None:
        """File size from the file system listing (metadata only)."""
        try:
            sc = self.spark.sparkContext
            hpath = sc._jvm.org.apache.hadoop.fs.Path(path)
            fs = hpath.getFileSystem(sc._jsc.hadoopConfiguration())
            return int(fs.getContentSummary(hpath).getLength())
        except Exception:
            import os

            return os.path.getsize(path) if os.path.exists(path) else None

    @property
    def multiline(self) -> set[int]:
        """CSV tables that are read unsplit."""
        return {i for i, (multiline, _) in self.csv_files.items() if multiline}

    # -- dimensions (driver metadata, one row per table / column) ----------
    def ok_indices(self) -> list[int]:
        return sorted(self.loaded)

    def n_tables(self) -> int:
        return len(self.tables)

    def table_dim(self) -> DataFrame:
        rows = []
        for t in self.tables:
            ld = self.loaded.get(t.table_idx)
            rows.append((t.table_idx, t.name, len(ld.columns) if ld else 0,
                         "ok" if ld else "error", self.errors.get(t.table_idx)))
        return self.spark.createDataFrame(rows, TABLE_DIM_SCHEMA)

    def column_rows(self) -> list[tuple[int, int, str, str]]:
        rows = []
        for t in self.tables:
            ld = self.loaded.get(t.table_idx)
            if ld is None:
                continue
            for i, (_, name, dtype) in enumerate(ld.columns):
                rows.append((t.table_idx, i, name, tx.source_class(dtype, t.fmt == "csv")))
        return rows

    def column_dim(self) -> DataFrame:
        return self.spark.createDataFrame(self.column_rows(), COLUMN_DIM_SCHEMA)

    # -- cells --------------------------------------------------------------
    def _ordinal(self, t: LakeTable) -> F.Column | None:
        """Row position in file order, as one ``long`` (used for first-appearance
        order; a long keeps ``min(ord)`` on the hash-aggregate path).  None for
        tables of many files, see :meth:`_with_ordinal`.

        Parquet: the row index.  CSV: split start offset + row number within
        the task; a row takes at least one byte, so positions of a split stay
        below the next split's start offset and file order is preserved."""
        files = self._file_names(t)
        if len(files) < 2:
            return self._place(t)
        if len(files) > ORDER_FILES:
            return None
        at = F.array_position(F.array(*(F.lit(f) for f in files)), _one_slash(F.col("_metadata.file_path")))
        return F.shiftleft(at, 42) + self._place(t)

    @staticmethod
    def _place(t: LakeTable) -> F.Column:
        if t.fmt == "parquet":
            return F.col("_metadata.row_index")
        return F.col("_metadata.file_block_start") + F.expr("monotonically_increasing_id() & 8589934591")

    def _file_names(self, t: LakeTable) -> list[str]:
        return sorted(re.sub(ONE_SLASH, r"\1:/", f) for f in self.loaded[t.table_idx].df.inputFiles())

    def _with_ordinal(self, t: LakeTable, keep: list[F.Column]) -> DataFrame:
        """Some columns of a table and ``__ord``, its rows' position.  The order of
        many files is joined from a table of their names, not put into the plan."""
        df, place = self.loaded[t.table_idx].df, self._ordinal(t)
        if place is not None:
            return df.select(place.alias("__ord"), *keep)
        files = self._file_names(t)
        order = self.spark.createDataFrame(list(zip(files, range(1, len(files) + 1))), "__file string, __at bigint")
        order = maybe_broadcast(order, sum(map(len, files)) + 32 * len(files), FILES_BYTES)
        rows = df.select(_one_slash(F.col("_metadata.file_path")).alias("__file"), self._place(t).alias("__place"), *keep)
        return rows.join(order, "__file").withColumn("__ord", F.shiftleft("__at", 42) + F.col("__place")).drop("__file", "__at", "__place")

    def table_cells(self, table_idx: int, with_ord: bool = False,
                    max_cols: int | None = None, keep_nulls: bool = False, marks: bool = False) -> DataFrame:
        """One row per cell ``(table_idx, col_idx, value[, ord])``.

        Null cells are dropped right after the unpivot (F1) unless
        ``keep_nulls``; row counts come from :meth:`table_rows`."""
        t = self.tables[table_idx]
        ld = self.loaded[table_idx]
        structs = []
        for i, (src, _, dtype) in enumerate(ld.columns):
            if max_cols is not None and i >= max_cols:  # R3: column prefix cut
                break
            value = tx.cell_text(src, dtype)
            if t.fmt == "csv":
                value = tx.null_tokens_to_null(value)
            structs.append(F.struct(F.lit(i).alias("col_idx"), value.alias("value")))
        if marks and t.fmt == "csv":
            # row count and malformed rows from the same pass as the cells
            rest = F.regexp_replace(F.col(BAD_RECORD), '"([^"]|"")*"', "")
            bad = F.char_length(rest) - F.char_length(F.replace(rest, F.lit(","), F.lit(""))) >= len(ld.columns)
            for mark, value in ((ROW_MARK, F.lit("")), (BAD_MARK, F.when(bad, F.lit("")))):
                structs.append(F.struct(F.lit(mark).alias("col_idx"), value.alias("value")))
        src_df = ld.df
        ord_col = self._ordinal(t) if with_ord else None
        parts = self._rebalance_parts(t, ld)
        if parts or (with_ord and ord_col is None):
            keep = [F.col(tx.quoted(src)) for src, _, _ in ld.columns]
            if t.fmt == "csv":
                keep.append(F.col(BAD_RECORD))
            src_df = self._with_ordinal(t, keep)
            ord_col = F.col("__ord") if with_ord else None
        if parts:
            # Narrow scan of a heavy file (e.g. one row group): spread the rows
            # before the unpivot + aggregation, which cost far more per row
            # than the scan.  Hash on the row ordinal: deterministic, no sort.
            src_df = src_df.repartition(parts, "__ord")
        sel = [F.lit(table_idx).alias("table_idx")]
        if ord_col is not None:
            sel.append(ord_col.alias("ord"))
        out = src_df.select(*sel, F.inline(F.array(*structs)))
        cols = ["table_idx", "col_idx", "value"] + (["ord"] if with_ord else [])
        out = out.select(*cols)
        return out if keep_nulls else out.where(F.col("value").isNotNull())

    def _rebalance_parts(self, t: LakeTable, ld: "_Loaded") -> int:
        """Target partitions when a table's scan is too narrow for its size, else 0.

        Only files whose bytes per scan partition exceed ``rebalance_bytes``
        are spread, to about one partition per ``rebalance_bytes``, but no more
        than the session runs tasks at once.  Tables that Spark splits for all of
        these - the normal case for large lakes - are never shuffled here."""
        if not self.rebalance_bytes or ld.size_bytes is None:
            return 0
        try:
            scan_parts = ld.df.rdd.getNumPartitions()
        except Exception:
            return 0
        want = min(-(-ld.size_bytes // self.rebalance_bytes), self.spark.sparkContext.defaultParallelism)
        return want if want > scan_parts else 0

    def table_of(self, path: str | None, among: list[int]) -> int | None:
        """The table (of some) that a file belongs to."""
        if not path:
            return None
        return next((i for i in among if f"{_plain(path)}/".startswith(f"{_plain(self.tables[i].path)}/")), None)

    def fail(self, table_idx: int, error: str) -> None:
        """S3: take a table that turned out unreadable out of the lake."""
        self.loaded.pop(table_idx, None)
        self.errors[table_idx] = error

    def table_rows(self, subset: list[int] | None = None) -> DataFrame:
        """P1 row counts ``(table_idx, n_rows)`` of Parquet tables: column-free
        scans, answered from footers.  CSV rows are counted by their marks."""
        idx = self.ok_indices() if subset is None else subset
        idx = [i for i in idx if self.tables[i].fmt == "parquet"]
        parts = [self.loaded[i].df.agg(F.count(F.lit(1)).alias("n_rows"))
                 .select(F.lit(i).alias("table_idx"), "n_rows") for i in idx]
        if not parts:
            return self.spark.createDataFrame([], "table_idx int, n_rows bigint")
        return reduce(DataFrame.unionByName, parts)

    def cells(self, with_ord: bool = False, max_cols: int | None = None,
              keep_nulls: bool = False, subset: list[int] | None = None, marks: bool = False) -> DataFrame:
        """Cells of the loaded tables (``subset`` or all): one UNION ALL of
        per-table scans."""
        idx = self.ok_indices() if subset is None else subset
        parts = [self.table_cells(i, with_ord, max_cols, keep_nulls, marks) for i in idx]
        if not parts:
            schema = CELL_SCHEMA_DDL + (", ord bigint" if with_ord else "")
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, parts)
