"""Sinks and the job archive. Every write goes through Spark's writers, so only whole outputs appear."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guildspark.functions.scalars import evidence_type, weight_type

from .cells import write_with_header
from .commits import Versions

PAIR_COLUMNS = ("row", "column", "cor", "p", "weight_type", "evidence_type", "selection_method", "selected")
SUMMARY_AS_PARAMETERS = ("dataset_type", "correlation_method", "grouping_mode", "p_value_threshold", "condition_a", "condition_b", "selected_conditions")
ARCHIVE_LIMIT, CACHE_VERSION = 500, 2
HISTORY = "id string, analysis_name string, script_name string, status string, created_at long, updated_at long, run_count int, payload string, summary string"


def pair_table(pairs: DataFrame, method: str) -> DataFrame:
    """condition and the eight columns of a pair file; only methods that select edges say how and which."""
    selects = method in ("spieceasi", "spring")
    how = F.lit("StARS" if selects else None).cast("string")
    chosen = F.col("selected") if selects else F.lit(None).cast("boolean")
    return pairs.select("condition", F.col("left").alias("row"), F.col("right").alias("column"), F.col("rho").alias("cor"), "p", weight_type(F.lit(method)).alias("weight_type"), evidence_type(F.lit(method)).alias("evidence_type"), how.alias("selection_method"), chosen.alias("selected"))


def write_pairs(pairs: DataFrame, path: str, method: str = "spearman") -> None:
    """One folder per raw condition, so names that look alike in a file name cannot overwrite each other."""
    pair_table(pairs, method).select("condition", *PAIR_COLUMNS).write.mode("overwrite").partitionBy("condition").option("header", True).csv(path)


def write_result(out: dict[str, DataFrame], request: str, path: str) -> None:
    """The tables of a job as Parquet folders, and `document`: one JSON line with the request, the statistics of each
    condition and the names of the tables. Graphs stay tables, as a document would hold one in a single row."""
    for name, table in out.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = out["stats"].sparkSession
    gathered = {n: spark.read.parquet(f"{path}/{n}").agg(F.sort_array(F.collect_list(F.struct("condition", *[F.col(c) for c in out[n].columns if c != "condition"]))).alias(n)) for n in ("stats", "samples")}
    both = gathered["stats"].crossJoin(gathered["samples"])
    document = both.select(F.lit(True).alias("success"), F.lit(request).alias("request"), "stats", "samples", F.array(*[F.lit(n) for n in sorted(out)]).alias("tables"))
    document.coalesce(1).write.mode("overwrite").json(f"{path}/document")


def summary_rows(df: DataFrame, key: str = "condition", hidden: tuple[str, ...] = SUMMARY_AS_PARAMETERS) -> DataFrame:
    """(key, name, value) of the columns of a summary as text: four decimals, Yes or No, and `Not applicable` for null.
    Columns that are shown as parameters already are left out."""

    def shown(c: str, kind: str) -> Column:
        x = F.col(f"`{c}`")
        text = F.format_string("%.4f", x.cast("double")) if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal") else F.when(x, "Yes").otherwise("No") if kind == "boolean" else x.cast("string")
        return F.struct(F.lit(c).alias("name"), F.when(x.isNull(), "Not applicable").otherwise(text).alias("value"))

    cells = [shown(c, kind) for c, kind in df.dtypes if c != key and c not in hidden]
    return df.select(key, F.explode(F.array(*cells)).alias("s")).select(key, "s.name", "s.value")


def write_csv(df: DataFrame, path: str) -> None:
    """RFC 4180 quoting; nested columns become JSON, which CSV cannot hold otherwise."""
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def csv_lines(df: DataFrame) -> tuple[DataFrame, str]:
    """Rows as lines (value) of RFC 4180 and their header: a field is quoted only if it holds a comma, a quote or a line end, null is an empty field."""

    def field(x: Column) -> Column:
        text = F.coalesce(x, F.lit(""))
        return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    cells = [F.to_json(F.col(f"`{c}`")) if t.startswith(("struct", "array", "map")) else F.col(f"`{c}`").cast("string") for c, t in df.dtypes]
    quoted = ['"' + c.replace('"', '""') + '"' if any(x in c for x in '",\r\n') else c for c in df.columns]
    return df.select(F.concat_ws(",", *[field(c) for c in cells]).alias("value")), ",".join(quoted)


def write_csv_crlf(df: DataFrame, path: str) -> None:
    """Comma-separated files whose lines end in CR and LF, a header in each, as spreadsheets expect them."""
    lines, header = csv_lines(df)
    write_with_header(lines, df.sparkSession.createDataFrame([(header,)], "value string"), path, line_end="\r\n")


def export(df: DataFrame, path: str, fmt: str) -> None:
    if fmt not in ("csv", "json"):
        raise ValueError(f"unknown export format: {fmt}")
    if df.isEmpty():
        raise ValueError("nothing to export")
    write_csv(df, path) if fmt == "csv" else df.write.mode("overwrite").json(path)


def union_by_keys(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def count_matrix(abundance: DataFrame, features: list[str]) -> DataFrame:
    """Features by samples with 0 for missing cells, as external tools read it; the sample list must fit a header."""
    return abundance.where(F.col("feature").isin(*features)).groupBy("feature").pivot("sample_id").agg(F.first("value")).na.fill(0)


def graph_cache_key(job_id: str, condition: str, method: str, max_p: float | None, min_abs: float, fingerprint: str) -> str:
    return hashlib.sha1(json.dumps([job_id, condition, method, max_p, min_abs, fingerprint]).encode()).hexdigest()


def dataset_fingerprint(paths: list[str]) -> str:
    return hashlib.sha1(json.dumps(sorted(paths)).encode()).hexdigest()


def write_graph(edges: DataFrame, root: str, key: str) -> None:
    edges.withColumn("cache_version", F.lit(CACHE_VERSION)).write.mode("overwrite").parquet(f"{root}/cache_key={key}")


def read_graph(spark: SparkSession, root: str, key: str) -> DataFrame:
    """Older graphs of SPIEC-EASI carry p-values that the method does not have; they are removed on reading."""
    df = spark.read.parquet(f"{root}/cache_key={key}")
    old = (F.col("cache_version") < CACHE_VERSION) & (F.col("method") == "spieceasi")
    return df.withColumn("p", F.when(~old, F.col("p"))).drop("cache_version")


class Archive:
    """Job history as a Parquet table of versions; the newest version is the state.

    A change writes a whole new version folder and then the note that makes it the next one; of two writers the later one makes its
    change again to what the earlier one left, and a lost job leaves the former state. Logs of the first releases are read on."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, self.root, self._logged)

    def _logged(self) -> tuple[int, str | None]:
        try:
            row = self.spark.read.schema("version long, folder string").json(f"{self.root}/_log").orderBy(F.desc("version")).first()
        except AnalysisException as e:  # the folder is not there yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            row = None
        return (row["version"], row["folder"]) if row else (0, None)

    def _of(self, folder: str | None) -> DataFrame:
        return self.spark.read.schema(HISTORY).parquet(f"{self.root}/{folder}") if folder else self.spark.createDataFrame([], HISTORY)

    def entries(self) -> DataFrame:
        """Newest first."""
        return self._of(self.versions.latest()[1]).orderBy(F.desc("updated_at"), "id")

    def _change(self, make) -> None:
        """make(the entries) -> the new ones; it may run again, on the entries that another writer left."""
        self.versions.change(lambda folder: make(self._of(folder)).orderBy(F.desc("updated_at"), "id").limit(ARCHIVE_LIMIT))

    def upsert(self, new: DataFrame) -> None:
        """New rows replace those of the same id; the creation time stays and the run count rises unless it is given."""

        def change(now: DataFrame) -> DataFrame:
            j = now.alias("a").join(normalized(new).alias("b"), "id", "full")
            pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c)
            rerun = F.col("b.updated_at").isNotNull() & F.col("a.updated_at").isNotNull()
            count = F.when(F.col("b.run_count").isNotNull(), F.col("b.run_count")).when(rerun, F.col("a.run_count") + 1).otherwise(F.coalesce("a.run_count", F.lit(1)))
            return j.select("id", *[pick(c) for c in ("analysis_name", "script_name", "status")], F.coalesce("a.created_at", "b.created_at").alias("created_at"), pick("updated_at"), count.cast("int").alias("run_count"), pick("payload"), pick("summary"))

        self._change(change)

    def update(self, entry_id: str, **patch) -> None:
        def change(now: DataFrame) -> DataFrame:
            return now.withColumns({c: F.when(F.col("id") == entry_id, F.lit(v).cast(now.schema[c].dataType)).otherwise(F.col(c)) for c, v in patch.items()})

        self._change(change)

    def remove(self, ids: list[str]) -> None:
        self._change(lambda now: now.where(~F.col("id").isin(*ids)))

    def clear(self) -> None:
        self._change(lambda now: now.limit(0))

    def import_legacy(self, old: DataFrame) -> None:
        """Ids that exist stay as they are."""

        def change(now: DataFrame) -> DataFrame:
            fresh = normalized(old).withColumn("run_count", F.coalesce("run_count", F.lit(1))).join(now.select("id"), "id", "left_anti")
            return now.unionByName(fresh.select(*now.columns))

        self._change(change)

    def rebuild(self, results: DataFrame) -> None:
        """Adds entries for stored results (id, summary, updated_at) that the history lacks, and fills missing summaries."""

        def change(now: DataFrame) -> DataFrame:
            known = results.select("id", F.col("summary").alias("_s"))
            filled = now.join(known, "id", "left").withColumn("summary", F.coalesce("summary", "_s")).drop("_s")
            fresh = results.join(now.select("id"), "id", "left_anti").select("id", F.lit("Recovered analysis").alias("analysis_name"), F.lit(None).cast("string").alias("script_name"), F.lit("completed").alias("status"), F.col("updated_at").alias("created_at"), "updated_at", F.lit(1).alias("run_count"), F.lit(None).cast("string").alias("payload"), "summary")
            return filled.select(*now.columns).unionByName(fresh)

        self._change(change)


def normalized(raw: DataFrame) -> DataFrame:
    """All history columns, with defaults; rows without an id are dropped."""
    have = {c: F.col(c) for c in raw.columns}
    get = lambda c, t: have.get(c, F.lit(None)).cast(t).alias(c)
    df = raw.select(get("id", "string"), get("analysis_name", "string"), get("script_name", "string"), get("status", "string"), get("created_at", "long"), get("updated_at", "long"), get("run_count", "int"), get("payload", "string"), get("summary", "string")).where("id is not null and id <> ''")
    a, b = F.get_json_object("payload", "$.params.conditionA"), F.get_json_object("payload", "$.params.conditionB")
    return df.withColumn("analysis_name", F.coalesce("analysis_name", F.concat(a, F.lit(" vs "), b))).withColumn("updated_at", F.coalesce("updated_at", F.unix_millis(F.current_timestamp()))).withColumn("created_at", F.coalesce("created_at", "updated_at")).withColumn("status", F.coalesce("status", F.lit("completed")))


def json_safe(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A table of a report's aggregates; one that is longer than `limit` rows ends with a line that says so."""
    rows = df.limit(limit + 1).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *[line(r) for r in rows[:limit]], *([f"The first {limit} rows; the table has more."] if len(rows) > limit else [])])


class Snapshots:
    """Cluster snapshots of jobs, one folder per job and cache key; a later one of the same key takes its place.

    Deleting a job writes a marker: snapshots saved before it are no longer shown."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, job_id: str, cache_key: str, members: DataFrame, saved_at: int) -> None:
        members.withColumn("saved_at", F.lit(saved_at).cast("long")).write.mode("overwrite").parquet(f"{self.root}/snapshots/job_id={job_id}/cache_key={cache_key}")

    def delete(self, job_id: str, deleted_at: int) -> None:
        self.spark.createDataFrame([(job_id, deleted_at)], "job_id string, deleted_at long").coalesce(1).write.mode("append").json(f"{self.root}/deleted")

    def _read(self, read, schema: str) -> DataFrame:
        try:
            return read()
        except AnalysisException as e:  # nothing is stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def all(self) -> DataFrame:
        """(job_id, cache_key, condition, node, rank, saved_at) of the jobs that are not deleted."""
        schema = "condition string, node string, rank int, saved_at long, job_id string, cache_key string"
        rows = self._read(lambda: self.spark.read.schema(schema).parquet(f"{self.root}/snapshots"), schema)
        gone = self._read(lambda: self.spark.read.schema("job_id string, deleted_at long").json(f"{self.root}/deleted"), "job_id string, deleted_at long").groupBy("job_id").agg(F.max("deleted_at").alias("deleted_at"))
        return rows.join(gone, "job_id", "left").where("deleted_at is null or saved_at > deleted_at").select("job_id", "cache_key", "condition", "node", "rank", "saved_at")

    def of(self, graphs: DataFrame) -> DataFrame:
        """The graphs (job_id, cache_key, ...) with n_members of their snapshot; null without one."""
        sizes = self.all().groupBy("job_id", "cache_key").agg(F.count("*").alias("n_members"))
        return graphs.join(sizes, ["job_id", "cache_key"], "left")


def side_by_side(entries: DataFrame, first: str, second: str) -> DataFrame:
    """(parameter, a, b, same): the parameters of two history entries beside each other; null where one has none."""
    params = entries.where(F.col("id").isin(first, second)).select("id", F.explode(F.from_json(F.get_json_object("payload", "$.params"), "map<string,string>")).alias("parameter", "value"))
    by = params.groupBy("parameter").agg(*[F.max(F.when(F.col("id") == i, F.col("value"))).alias(n) for i, n in ((first, "a"), (second, "b"))])
    return by.withColumn("same", F.col("a").eqNullSafe(F.col("b")))
