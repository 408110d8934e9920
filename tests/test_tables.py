"""Typed files there and back, required columns, global ids and new identifiers."""

import pytest

from meshwright.operators import reports, versions
from meshwright.sources import tables


def test_csv_there_and_back(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'a "quoted", text\nof two lines', "yes"), ("x", "", None)], "n string, t string, b string")
    tables.write_csv(rows.coalesce(1), f"{tmp_path}/out")
    kinds = {"n": "int", "t": "string", "b": "boolean"}
    got = tables.read_csv(spark, f"{tmp_path}/out", kinds, required=["n", "t"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 'a "quoted", text\nof two lines', True), (None, None, None)], key=str)
    with pytest.raises(ValueError, match="gone"):
        tables.read_csv(spark, f"{tmp_path}/out", {"gone": "int"}, required=["gone"])
    assert tables.typed(rows, {"gone": "int"}).dtypes == [("gone", "int")]


def test_packages(spark, tmp_path):
    tables.write_package({"a": spark.range(3), "b": spark.range(2).selectExpr("id as k")}, str(tmp_path))
    read = tables.read_package(spark, str(tmp_path), ["a", "b"])
    assert (read["a"].count(), read["b"].columns) == (3, ["k"])


def test_global_ids_are_compared_in_one_form(spark):
    rows = spark.createDataFrame([("L", 1, "{ab}"), ("L", 2, "AB"), ("L", 3, None), ("L", 4, "{}"), ("M", 5, "ab")], "class string, fid long, gid string")
    got = {r.fid: r.gid for r in versions.backfill(rows, "class", "gid", "fid").collect()}
    assert (got[1], got[5]) == ("{ab}", "ab") and len({got[2], got[3], got[4]}) == 3 and None not in got.values() and got[2] != "AB"


def test_new_ids_skip_those_in_use(spark):
    existing = spark.createDataFrame([("P-000002",), ("P-7000004",), ("Q-70000001",), ("free text",)], "assetid string")
    wanted = spark.createDataFrame([("P-", 1), ("P-7", 1), ("P-7", 2), ("Q-", 1), ("Q-7", 1), ("R-", 1)], "prefix string, key long")
    got = {(r.prefix, r.key): r.assetid for r in reports.next_ids(existing, wanted).collect()}
    assert got == {("P-", 1): "P-7000005", ("P-7", 1): "P-7000001", ("P-7", 2): "P-7000002", ("Q-", 1): "Q-70000002", ("Q-7", 1): "Q-7000001", ("R-", 1): "R-000001"}
