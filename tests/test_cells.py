"""Delimited tables as a data source: every cell with its file, byte and place, whatever ranges they are read in."""

import csv
import io

import pytest

from guildspark.sources import cells as FC


def put(folder, name, text):
    path = folder / name
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(path)


def brute(path):
    """(offset, place, key, name, cell) of the cells that are not blank."""
    data = open(path, "rb").read()
    out, at, names = [], 0, None
    sep = None
    for line in data.split(b"\n"):
        text = line.decode().rstrip("\r")
        if names is None:
            text = text.removeprefix("﻿")
            sep = "\t" if "\t" in text else ";" if ";" in text else ","
            names = [n.strip() for n in next(csv.reader(io.StringIO(text), delimiter=sep))]
        elif text:
            fields = next(csv.reader(io.StringIO(text), delimiter=sep))
            if fields[0].strip():
                out += [(at, i, fields[0].strip(), n, c) for i, (n, c) in enumerate(zip(names, fields, strict=False)) if i and c.strip()]
        at += len(line) + 1
    return out


def test_ranges_lose_and_repeat_nothing(spark, tmp_path):
    rows = "".join(f'"s;{i}";{i};;"a ""b"" é";{i}.5\r\n' if i % 3 else f" s{i} ; {i} \r\n" for i in range(60))
    path = put(tmp_path, "t.csv", "﻿id;one;two;three;four\r\n" + rows + ";9;9;9;9\r\n\r\nlast;1;2;3;4")
    want = brute(path)
    for size in (97, 1000, 1 << 20):
        got = FC.read_cells(spark, [path], size).where("cell is not null").collect()
        assert sorted((r["offset"], r["place"], r["key"], r["name"], r["cell"]) for r in got) == sorted(want), size
    short = put(tmp_path, "s.csv", "id,a\nx,1\n\ny,2")
    for size in range(1, 12):
        assert [(r["offset"], r["cell"]) for r in FC.read_cells(spark, [short], size).where("cell is not null").orderBy("offset").collect()] == [(5, "1"), (10, "2")]
    heads = FC.read_cells(spark, [path], 1000).where("offset = 0").collect()
    assert sorted((r["place"], r["name"]) for r in heads) == [(1, "one"), (2, "two"), (3, "three"), (4, "four")]


def test_orientations_and_last_wins(spark, tmp_path):
    a = put(tmp_path, "a.csv", "id,f1,f2,f1\ns1,1,2,3\ns2,x,4,\ns1,,5,6\nempty,,,\n")
    b = put(tmp_path, "b.tsv", "id\ts2\ts3\tsilent\nf1\t7\t8\t\nf3\t1e3\t-2.\t\nf1\t\t9\tn/a\n")
    ids = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("silent",)], "sample_id string")
    for size in (30, 1 << 20):
        got = {(r["sample_id"], r["feature"]): r["value"] for r in FC.load_tables(spark, [a, b], ids, size).collect()}
        assert got == {("s1", "f1"): 6.0, ("s1", "f2"): 5.0, ("s2", "f2"): 4.0, ("s2", "f1"): 7.0, ("s3", "f1"): 9.0, ("s2", "f3"): 1000.0, ("s3", "f3"): -2.0}
        assert {r[0] for r in FC.table_samples(spark, [a, b], ids, size).collect()} == {"s1", "s2", "empty", "s3", "silent"}
    # the other order of files: the earlier value of a cell is now the later one
    turned = {(r["sample_id"], r["feature"]): r["value"] for r in FC.load_tables(spark, [b, a], ids).collect()}
    assert turned[("s2", "f2")] == 4.0 and turned[("s2", "f1")] == 7.0
    assert {r["feature"] for r in FC.load_tables(spark, [b]).collect()} == {"s2", "s3"}  # without ids, rows are samples


def test_conditions_and_errors(spark, tmp_path):
    m = put(tmp_path, "m.tsv", "sample\tgroup\ns1\ta\ns2\t \ns1\tb\ns3\n")
    assert {tuple(r) for r in FC.load_conditions(spark, [m], "group").collect()} == {("s1", "b")}
    with pytest.raises(ValueError):
        FC.load_conditions(spark, [m], "absent")
    with pytest.raises(Exception, match="nowhere"):
        FC.read_cells(spark, [str(tmp_path / "nowhere")]).count()
    with pytest.raises(Exception, match="empty table"):
        FC.read_cells(spark, [put(tmp_path, "e.csv", "")]).count()
    with pytest.raises(ValueError):
        FC.read_cells(spark, [])
    assert FC.load_tables(spark, [put(tmp_path, "h.csv", "id,f1\n")]).count() == 0


@pytest.mark.parametrize(("separator", "transposed"), [(",", False), ("\t", True), (";", False), (";", True)])
def test_round_trip(spark, tmp_path, separator, transposed):
    rows = [(f"s{i}", f, float(i) + 0.25) for i in range(40) for f in ("plain", 'q"uote', "com,ma", "semi;colon") if (i + len(f)) % 3 and (separator != "," or ";" not in f)]
    cells = spark.createDataFrame(rows, "sample_id string, feature string, value double")
    path = str(tmp_path / "out")
    FC.write_tables(cells, path, separator, transposed, samples_per_file=7)
    assert len(FC.files_of(path)) > 3
    got = FC.load_tables(spark, [path], cells.select("sample_id"), range_bytes=400)
    assert {(r["sample_id"], r["feature"], r["value"]) for r in got.collect()} == set(rows)
    if separator == ",":
        with pytest.raises(Exception, match="several fields"):
            FC.write_tables(spark.createDataFrame([("s", "a;b", 1.0)], cells.schema), str(tmp_path / "bad"), separator)


def test_a_header_stays_with_its_lines_where_nothing_is_broadcast(spark, tmp_path):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "3000b", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    cells = spark.range(3000).selectExpr("concat('s', id div 5) as sample_id", "concat('f', id % 5) as feature", "cast(id as double) as value")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for separator, transposed in ((",", False), ("\t", True)):
            path = str(tmp_path / str(transposed))
            FC.write_tables(cells, path, separator, transposed, samples_per_file=30)
            files = [f.path for f in FC.files_of(path)]
            assert len(files) == len({f.rsplit("/", 1)[0] for f in files}) == 20
            assert all(open(f).readline().startswith("id" + separator) for f in files)
            assert sorted(map(tuple, FC.load_tables(spark, [path], cells.select("sample_id")).select(*cells.columns).collect())) == sorted(map(tuple, cells.collect()))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_table_with_more_samples_than_a_plan_has_columns_is_unpivoted(spark, tmp_path):
    from guildspark.plans import catalog

    n = 10_500  # more than spark.sql.pivotMaxValues
    spark.range(n).selectExpr("id % 3 as l_partkey", "id as l_suppkey", "cast(id % 7 + 1 as double) as l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(3).selectExpr("id as p_partkey", "concat('b', id) as p_brand").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r["feature"], r["sample_id"], r["value"]) for r in catalog.QUERIES["src5_transposed_unpivot"](spark, str(tmp_path)).collect()}
    assert got == {(f"b{i % 3}", str(i), float(i % 7 + 1)) for i in range(n)}
