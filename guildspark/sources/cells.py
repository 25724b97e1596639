"""Delimited tables as a Spark data source that keeps where every cell stood, and blocks of such tables as a sink.

`spark.read.format("delimited_cells")` lists the files, takes each file's separator from its first line and deals
byte ranges to tasks. A task reads the header again and hands out one row per cell that is not blank, with the number of the
file, the byte where its line starts and the place in the line, so a later cell is later in any run, whatever
tasks and retries did. Lines that start in a range belong to it; a line end inside quotes is a line end.

Rows: file, offset, place, key (the line's first field), name (the header's field), cell. Place 0 tells the key itself, and
offset 0 the header: a row per name, without a cell. Paths are those of Arrow file systems: shared folders, hdfs:, s3:, gs:."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tables import BOM, delimiter, number

NAME = "delimited_cells"
SCHEMA = "file int, offset long, place int, key string, name string, cell string"
ARROW = pa.schema([("file", pa.int32()), ("offset", pa.int64()), ("place", pa.int32()), ("key", pa.string()), ("name", pa.string()), ("cell", pa.string())])
RANGE_BYTES, BATCH_ROWS = 32 << 20, 50_000
#: Cells of whole tables that are no numbers.
NULL, NOT_FINITE = "null", ("NaN", "Infinity", "-Infinity")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[fs.FileInfo]:
    """The file, or the folder's files by name; names that start with a dot or an underscore are no tables."""
    system, where = opened(path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.File:
        return [info]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(where, recursive=True))
    return sorted((f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.path)


@dataclass
class Range(InputPartition):
    """Lines of a file that start in bytes start to end."""

    file: int
    path: str
    start: int
    end: int


def fields_of(line: bytes, separator: str) -> list[str]:
    return next(csv.reader([line.decode("utf-8", "replace").rstrip("\r\n")], delimiter=separator), [])


class CellsReader(DataSourceReader):
    def __init__(self, paths: list[str], range_bytes: int):
        self.paths, self.range_bytes = paths, range_bytes

    def partitions(self) -> list[Range]:
        files = [(path, f) for path in self.paths for f in files_of(path)]
        if not files:
            raise ValueError("no tables in " + ", ".join(self.paths))
        step = self.range_bytes
        scheme = lambda path, f: f"{path.split(':', 1)[0]}://{f.path}" if ":" in path.split("/", 1)[0] and not path.startswith("file:") else f.path
        return [Range(i, scheme(path, f), at, min(at + step, f.size)) for i, (path, f) in enumerate(files) for at in range(0, max(1, f.size), step)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, where = opened(part.path)
        with io.BufferedReader(system.open_input_file(where), 1 << 20) as raw:
            first = raw.readline()
            header = first.decode("utf-8", "replace").lstrip(BOM)
            separator = delimiter(header)
            names = [n.strip() for n in fields_of(header.encode(), separator)]
            rows: list[tuple] = []
            if part.start == 0:
                if not header.strip():
                    raise ValueError(f"empty table: {part.path}")
                rows += [(part.file, 0, i, names[0], n, None) for i, n in enumerate(names) if i]
                at = len(first)
            else:
                at = part.start
                if at > len(first):  # a line that starts before the range is another's
                    raw.seek(at - 1)
                    at += len(raw.readline()) - 1
                at = max(at, len(first))
            raw.seek(at)
            while at < part.end:
                line = raw.readline()
                if not line:
                    break
                fields = fields_of(line, separator)
                if fields and (key := fields[0].strip()):
                    rows.append((part.file, at, 0, key, None, None))
                    rows += [(part.file, at, i, key, n, c) for i, (n, c) in enumerate(zip(names, fields, strict=False)) if i and c and not c.isspace()]
                at += len(line)
                if len(rows) >= BATCH_ROWS:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


class Cells(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CellsReader:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return CellsReader(paths, int(self.options.get("range_bytes", RANGE_BYTES)))


def read_cells(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    if not paths:
        raise ValueError("no tables")
    spark.dataSource.register(Cells)
    return spark.read.format(NAME).option("paths", json.dumps(paths)).option("range_bytes", range_bytes).load()


def said(text: Column) -> Column:
    """A name as a table can hold it: one that is null, blank or empty, starts with the escape or has anything but letters, digits and
    plain marks of ASCII (single spaces within it too) is written as a percent sign and its URL code, and null as two percent signs."""
    plain = text.rlike(r"\A[A-Za-z0-9_#.:-]+( [A-Za-z0-9_#.:-]+)*\z")
    return F.when(text.isNull(), "%%").when(plain, text).otherwise(F.concat(F.lit("%"), F.url_encode(text)))


def unsaid(name: Column) -> Column:
    """The name that said() wrote."""
    return F.when(name == "%%", F.lit(None).cast("string")).when(name.startswith("%"), F.url_decode(F.substring(name, 2, 2**31 - 1))).otherwise(name)


def turned(cells: DataFrame, ids: DataFrame, whole: bool = False) -> DataFrame:
    """(file, turned): whether a file has its samples as columns, that is more of the known ids in its header than in its first column."""
    text = F.col("sample_id").cast("string")
    known = ids.select((said(text) if whole else F.trim(text)).alias("id")).distinct()
    told = cells.where("cell is null").select("file", F.when(F.col("place") == 0, F.col("key")).otherwise(F.col("name")).alias("id"), (F.col("place") > 0).alias("top")).distinct()
    hits = told.join(known.withColumn("hit", F.lit(True)), "id", "left")
    top, side = F.count_if(F.col("top") & F.col("hit")), F.count_if(~F.col("top") & F.col("hit"))
    return hits.groupBy("file").agg((top > side).alias("turned"))


def long_cells(cells: DataFrame, ids: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """(sample_id, feature, value, feature_ord, and where the cell stood: file, offset, place) of every numeric cell.

    whole: the tables were written so; names are unescaped, and cells of null, NaN and the infinities count too."""
    if ids is None:
        side = cells.withColumn("turned", F.lit(False))
    else:
        side = cells.join(turned(cells, ids, whole), "file")
    own = side.where("cell is not null and trim(name) <> ''").withColumn("value", number(F.col("cell")))
    if whole:
        own = own.withColumn("value", F.when(F.col("cell").isin(*NOT_FINITE), F.col("cell").try_cast("double")).otherwise(F.col("value")))
    own = own.where((F.col("value").isNotNull() | (F.col("cell") == NULL)) if whole else F.col("value").isNotNull())
    key, name, t = F.col("key"), F.trim("name"), F.col("turned")
    if whole:
        key, name = unsaid(key), unsaid(name)
    return own.select(F.when(t, name).otherwise(key).alias("sample_id"), F.when(t, key).otherwise(name).alias("feature"), "value", F.when(t, F.col("offset")).otherwise(F.col("place").cast("long")).alias("feature_ord"), "file", "offset", "place")


def load_tables(spark: SparkSession, paths: list[str], ids: DataFrame | None = None, range_bytes: int = RANGE_BYTES, whole: bool = False) -> DataFrame:
    """(sample_id, feature, value, feature_ord) of all files in either orientation; a later cell of a sample and feature replaces
    an earlier one, and a feature keeps the place of its first file. One group-by finds the last cells, another the first places."""
    cells = long_cells(read_cells(spark, paths, range_bytes), ids, whole)
    last = cells.groupBy("sample_id", "feature").agg(F.max(F.struct("file", "offset", "place", "value")).alias("c"), F.min(F.struct("file", "feature_ord")).alias("o"))
    first = F.min("o").over(Window.partitionBy("feature"))
    return last.withColumn("o", first).select("sample_id", "feature", F.col("c.value").alias("value"), F.col("o.feature_ord").alias("feature_ord"))


def table_samples(spark: SparkSession, paths: list[str], ids: DataFrame | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(sample_id) of all files, those without any number among their cells too."""
    cells = read_cells(spark, paths, range_bytes)
    side = cells.withColumn("turned", F.lit(False)) if ids is None else cells.join(turned(cells, ids), "file")
    told = side.where("cell is null").where(F.col("turned") == (F.col("place") > 0))
    return told.select(F.trim(F.when(F.col("turned"), F.col("name")).otherwise(F.col("key"))).alias("sample_id")).where("sample_id <> ''").distinct()


def load_conditions(spark: SparkSession, paths: list[str], column: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(sample_id, condition): the last line of a sample that names a condition wins; a file without the column is an error."""
    cells = read_cells(spark, paths, range_bytes)
    having = cells.where("offset = 0").groupBy("file").agg(F.max(F.col("name") == column).alias("has"))
    lacking = having.where(~F.col("has"))
    if not lacking.isEmpty():
        raise ValueError(f"metadata column {column!r} is missing")
    own = cells.where((F.col("name") == column) & F.col("cell").isNotNull())
    return own.groupBy(F.col("key").alias("sample_id")).agg(F.max_by(F.trim("cell"), F.struct("file", "offset", "place")).alias("condition"))


def _quoted(text, separator: str):
    """The name as a field. A name with a separator that readers would prefer to this one in a header is an error."""
    preferred = {",": [";", "\t"], ";": ["\t"], "\t": []}[separator]
    misleading = F.lit(False)
    for c in preferred:
        misleading |= text.contains(c)
    quoted = F.when(text.contains(separator) | text.contains('"'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
    return F.when(misleading, F.raise_error(F.concat(F.lit("the name would be taken for several fields: "), text)).cast("string")).otherwise(quoted)


def write_tables(cells: DataFrame, path: str, separator: str = ",", transposed: bool = False, samples_per_file: int = 1000, mode: str = "error", whole: bool = False) -> None:
    """Writes long cells (sample_id, feature, value) as tables of up to about samples_per_file samples each, a header in every one.

    A file's samples are picked by hash. Cells that do not occur are blank. Names that hold the separator or a quote are quoted.
    whole: names and values that a table cannot hold (null, blanks, line ends, NaN) are escaped, for long_cells(whole=True). No cells
    are a table of a header alone."""
    own = cells.select(F.col("sample_id").cast("string").alias("sample_id"), "feature", F.col("value").cast("double").cast("string").alias("value"))
    if whole:
        own = own.select(said(F.col("sample_id")).alias("sample_id"), said(F.col("feature")).alias("feature"), F.coalesce("value", F.lit(NULL)).alias("value"))
    n = own.select("sample_id").distinct().count()
    if not n:
        own.sparkSession.range(0, 1, 1, 1).select(F.lit("id").alias("value")).write.mode(mode).text(path)
        return
    blocks = -(-n // samples_per_file)
    own = own.withColumn("block", F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int"))
    row, column = ("feature", "sample_id") if transposed else ("sample_id", "feature")
    if transposed:
        columns = own.groupBy("block").agg(F.array_sort(F.collect_set(column)).alias("columns"))
    else:
        every = own.agg(F.array_sort(F.collect_set(column)).alias("columns"))
        columns = own.select("block").distinct().crossJoin(F.broadcast(every))  # one row: the header that every file has
    lines = own.groupBy("block", F.col(row).alias("key")).agg(F.map_from_entries(F.collect_list(F.struct(column, "value"))).alias("m"))
    fill = F.transform("columns", lambda c: F.coalesce(F.try_element_at("m", c), F.lit("")))
    body = lines.join(columns, "block").select("block", F.lit(1).alias("o"), "key", F.concat_ws(separator, _quoted(F.col("key"), separator), F.concat_ws(separator, fill)).alias("value"))
    head = columns.select("block", F.lit(0).alias("o"), F.lit("").alias("key"), F.concat_ws(separator, F.lit("id"), F.concat_ws(separator, F.transform("columns", lambda c: _quoted(c, separator)))).alias("value"))
    # dealt by a hash of the block: both parts may be dealt by the block itself, and Spark then leaves out an exchange by it and puts their partitions together unlike
    every = head.unionByName(body).repartition(F.xxhash64("block")).sortWithinPartitions("block", "o", "key")
    every.select("block", "value").write.mode(mode).partitionBy("block").text(path)


def write_with_header(lines: DataFrame, header: DataFrame, path: str, rows_per_file: int = 1_000_000, line_end: str = "\n") -> None:
    """Writes lines (value) as files of up to about rows_per_file lines, each with the one-row header on top. The order of lines is not kept."""
    blocks = -(-lines.count() // rows_per_file) or 1
    own = lines.select(F.pmod(F.xxhash64("value"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("o"), "value")
    tops = header.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("o"), "value")
    tops.unionByName(own).repartition("block").sortWithinPartitions("block", "o").select("block", "value").write.option("lineSep", line_end).partitionBy("block").text(path)
