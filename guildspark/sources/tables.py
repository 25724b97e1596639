"""File sources: delimited abundance tables in either orientation, metadata, edge lists and square matrices.

Everything is read by Spark, so paths may be in any store it knows; the driver looks at a header line only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
BOM = "﻿"


def number(cell: Column) -> Column:
    """A trimmed decimal number, null for blanks and everything else."""
    t = F.trim(cell)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def delimiter(header: str) -> str:
    return "\t" if "\t" in header else ";" if ";" in header else ","


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; the separator is taken from the header, a byte order mark is removed."""
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"empty table: {path}")
    df = spark.read.option("header", True).option("sep", delimiter(first[0])).option("encoding", "UTF-8").option("quote", '"').option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip(BOM).strip().strip('"') if i == 0 else c for i, c in enumerate(df.columns)])


def is_transposed(df: DataFrame, ids: DataFrame) -> bool:
    """Samples are columns if more of the known ids are in the header than in the first column."""
    known = spark_names(df.sparkSession, df.columns[1:])
    in_header = known.join(ids.select(F.trim("sample_id").alias("name")).distinct(), "name", "left_semi").count()
    first = df.select(F.trim(F.col(f"`{df.columns[0]}`")).alias("sample_id")).distinct()
    return in_header > 0 and in_header > first.join(ids.select(F.trim("sample_id").alias("sample_id")), "sample_id", "left_semi").count()


def spark_names(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n.strip(),) for n in names], "name string").distinct()


def unpivot(df: DataFrame, transposed: bool = False) -> DataFrame:
    """Long cells (sample_id, feature, value, feature_ord): blank and non-numeric cells are absent."""
    key, names = df.columns[0], df.columns[1:]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.lit(n).alias("n"), F.col(f"`{n}`").alias("v")) for i, n in enumerate(names)]))
    long = df.select(F.trim(F.col(f"`{key}`")).alias("k"), F.monotonically_increasing_id().alias("row"), cells.alias("c"))
    if transposed:
        out = long.select(F.trim("c.n").alias("sample_id"), F.col("k").alias("feature"), number(F.col("c.v")).alias("value"), F.col("row").alias("feature_ord"))
    else:
        out = long.select(F.col("k").alias("sample_id"), F.col("c.n").alias("feature"), number(F.col("c.v")).alias("value"), F.col("c.o").cast("long").alias("feature_ord"))
    return out.where("value is not null and sample_id <> '' and feature <> ''")


def load_abundance(spark: SparkSession, paths: list[str], ids: DataFrame | None = None) -> DataFrame:
    """(sample_id, feature, value, feature_ord) of all files; the last value of a cell wins, features keep their first place."""
    parts = None
    for i, path in enumerate(paths):
        df = read_delimited(spark, path)
        df = df.withColumn("_row", F.monotonically_increasing_id())
        body = df.drop("_row")
        cells = unpivot(body, ids is not None and is_transposed(body, ids)).withColumn("file_ord", F.lit(i)).withColumn("row_ord", F.monotonically_increasing_id())
        parts = cells if parts is None else parts.unionByName(cells)
    if parts is None:
        raise ValueError("no abundance files")
    last = Window.partitionBy("sample_id", "feature").orderBy(F.desc("file_ord"), F.desc("row_ord"))
    order = Window.partitionBy("feature")
    return parts.withColumn("rn", F.row_number().over(last)).withColumn("feature_ord", F.min(F.struct("file_ord", "feature_ord")).over(order)).where("rn = 1").select("sample_id", "feature", "value", F.col("feature_ord.feature_ord").alias("feature_ord"))


def sample_ids(spark: SparkSession, paths: list[str], ids: DataFrame | None = None) -> DataFrame:
    """(sample_id) of all files, those without any number among their cells too."""
    parts = None
    for path in paths:
        df = read_delimited(spark, path)
        own = spark_names(spark, df.columns[1:]).select(F.col("name").alias("sample_id")) if ids is not None and is_transposed(df, ids) else df.select(F.trim(F.col(f"`{df.columns[0]}`")).alias("sample_id"))
        parts = own if parts is None else parts.unionByName(own)
    if parts is None:
        raise ValueError("no abundance files")
    return parts.where("sample_id <> ''").distinct()


def load_metadata(spark: SparkSession, paths: list[str], column: str) -> DataFrame:
    """(sample_id, condition): rows without either are dropped, the last row of a sample wins."""
    parts = None
    for i, path in enumerate(paths):
        df = read_delimited(spark, path)
        if column not in df.columns:
            raise ValueError(f"metadata column {column!r} is missing in {path}")
        one = df.select(F.trim(F.col(f"`{df.columns[0]}`")).alias("sample_id"), F.trim(F.col(f"`{column}`")).alias("condition"), F.lit(i).alias("file_ord"), F.monotonically_increasing_id().alias("row_ord"))
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        raise ValueError("no metadata files")
    last = Window.partitionBy("sample_id").orderBy(F.desc("file_ord"), F.desc("row_ord"))
    return parts.where("sample_id <> '' and condition <> ''").withColumn("rn", F.row_number().over(last)).where("rn = 1").select("sample_id", "condition")


def metadata_columns(spark: SparkSession, path: str) -> list[str]:
    return [c.strip().strip("\"'") for c in read_delimited(spark, path).columns]


def common_columns(spark: SparkSession, paths: list[str]) -> list[str]:
    """Columns that every metadata file has, in the first file's order."""
    lists = [metadata_columns(spark, p) for p in paths]
    return [c for c in lists[0] if all(c in x for x in lists[1:])] if lists else []


def distinct_conditions(metadata: DataFrame) -> DataFrame:
    return metadata.where("condition is not null and trim(condition) <> ''").groupBy("condition").agg(F.countDistinct("sample_id").alias("n_samples"))


def require_two_conditions(metadata: DataFrame, most: int = 1000) -> list[str]:
    """The conditions by name; under two of them, or more than `most`, are an error."""
    found = [r[0] for r in distinct_conditions(metadata).select("condition").orderBy("condition").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} conditions: the column is no grouping of samples")
    if len(found) < 2:
        raise ValueError("at least two conditions are needed")
    return found


def count_samples(metadata: DataFrame) -> int:
    return metadata.select("sample_id").distinct().count()


def read_edge_list(spark: SparkSession, path: str, min_abs: float = 0.0, max_p: float | None = None) -> DataFrame:
    """White-space edge file with a header: row_id source target weight p. A row of under five fields is an error."""
    lines = spark.read.text(path).withColumn("f", F.split(F.trim("value"), r"\s+")).where("trim(value) <> ''")
    header = spark.read.text(path).first()
    if header is None:
        raise ValueError("the edge file is empty")
    body = lines.where(F.col("value") != header[0])
    checked = body.withColumn("f", F.when(F.size("f") >= 5, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("malformed row: "), "value"))))
    out = checked.select(F.get("f", F.lit(0)).alias("row_id"), F.get("f", F.lit(1)).alias("source"), F.get("f", F.lit(2)).alias("target"), F.get("f", F.lit(3)).cast("double").alias("weight"), F.get("f", F.lit(4)).cast("double").alias("p"))
    out = out.where(F.abs("weight") >= min_abs)
    return out if max_p is None else out.where(F.col("p") <= max_p)


def read_edge_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges (source, target, weight, p) and one row of skip counts (blank, self_loops)."""
    df = read_delimited(spark, path)
    missing = {"source", "target", "correlation"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    p = number(F.col("p_value")) if "p_value" in df.columns else F.lit(None).cast("double")
    rows = df.select(F.trim("source").alias("source"), F.trim("target").alias("target"), number(F.col("correlation")).alias("weight"), p.alias("p"))
    blank = F.coalesce((F.col("source") == "") | (F.col("target") == ""), F.lit(True)) | F.col("weight").isNull()
    loop = ~blank & (F.col("source") == F.col("target"))
    return rows.where(~blank & ~loop), rows.agg(F.count_if(blank).alias("blank"), F.count_if(loop).alias("self_loops"))


def read_square_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(left, right, value) of a matrix with features in its header and first column."""
    return unpivot(read_delimited(spark, path)).select(F.col("sample_id").alias("left"), F.col("feature").alias("right"), "value")


GRAPH = "nodes array<struct<id string, overabundance double>>, edges array<struct<row_id string, source string, target string, correlation double, weight double, p_value double>>"


def read_graph_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and edges (source, target, weight, p) of JSON documents with `nodes` and `edges`, one or several files.

    An edge's weight is its correlation, else its weight, else 0; edges without both ends are dropped, and ends that no
    node names are nodes too."""
    doc = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    e = doc.select(F.explode("edges").alias("e")).select(F.col("e.source").alias("source"), F.col("e.target").alias("target"), F.coalesce("e.correlation", "e.weight", F.lit(0.0)).alias("weight"), F.col("e.p_value").alias("p"))
    e = e.where("source <> '' and target <> ''")
    named = doc.select(F.explode("nodes").alias("n")).select(F.col("n.id").alias("id"))
    return named.unionByName(e.select(F.explode(F.array("source", "target")).alias("id"))).where("id is not null").distinct(), e


def describe_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, modified) of each different path; one that is not a readable file is an error."""
    files = spark.read.format("binaryFile").load(list(dict.fromkeys(paths)))
    return files.select("path", "length", F.col("modificationTime").alias("modified"))
