"""Tables whose names and values a delimited file cannot hold as they stand."""

import math

from guildspark.plans import catalog
from guildspark.sources import cells as FC

NAMES = [None, "", "  ", " a", "a", "a;b", "a,b\t\"c\"\n\r é", "%", "%%", "%41", "null", "Brand#1", "x y", "x  y"]


def test_names_come_back(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    rows = df.select("n", FC.said(df.n).alias("s"), FC.unsaid(FC.said(df.n)).alias("u")).collect()
    assert all(r["n"] == r["u"] for r in rows) and len({r["s"] for r in rows}) == len(NAMES)
    assert {r["n"] for r in rows if r["n"] == r["s"]} == {"a", "null", "Brand#1", "x y"}


def test_queries_through_files_keep_odd_rows(spark, tmp_path):
    """src1, src2 and src5 on null and blank names, values that are no numbers, and an event named as a brand."""
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    values = [1.0, None, math.nan, math.inf]
    put([(i, b) for i, b in enumerate(NAMES)], "p_partkey long, p_brand string", "part")
    put([(i, None if i == 2 else i) for i in range(5)], "o_orderkey long, o_custkey long", "orders")
    put([(i % 5, i % len(NAMES), None if i % 3 == 0 else i % 3, values[i % 4]) for i in range(70)], "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double", "lineitem")
    put([(None if i == 3 else i % 3, NAMES[i]) for i in range(len(NAMES))], "user_id long, event_type string", "events")
    put([(None if i == 4 else i, NAMES[i]) for i in range(len(NAMES))], "c_custkey long, c_mktsegment string", "customer")

    def own(query):
        return sorted(map(repr, query(spark, str(tmp_path)).collect()))

    from pyspark.sql import functions as F

    from guildspark.sources import demo

    text = F.col("sample_id").cast("string").alias("sample_id")
    long = lambda f: f(spark, str(tmp_path)).select(text, "feature", "value")
    assert own(catalog.src1_tables_both_ways) == sorted(map(repr, long(demo.bacteria).unionByName(long(demo.fungi)).collect()))
    assert own(catalog.src5_transposed_unpivot) == sorted(map(repr, long(demo.dense).select("feature", "sample_id", "value").collect()))
    assert own(catalog.src2_metadata_files) == sorted(map(repr, demo.conditions(spark, str(tmp_path)).select(text, "condition").collect()))


def test_no_cells_are_a_table_without_rows(spark, tmp_path):
    none = spark.createDataFrame([], "sample_id long, feature string, value double")
    for transposed in (False, True):
        path = f"{tmp_path}/{transposed}"
        FC.write_tables(none, path, ";", transposed, whole=True)
        assert FC.load_tables(spark, [path], none.select("sample_id"), whole=True).count() == 0
