"""Workbooks written and read by tasks: exact round trips, files of bounded rows, what is refused."""

import io
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.plans.staging import fresh_path
from tallyspark.sources import tabular, workbooks

ODD = ["=1+1", "'quoted", "'=x", "+36", "-5", "@a", " two  blanks ", "a\nb", "tab\there", "\ttab", "<&>\"", "_x0041_", "bell\x07", "cr\r\nlf", "", None, "árvíztűrő 日本 😀", "0012"]


def test_what_goes_out_comes_back(spark):
    rows = [(k, text, Decimal(k * 1000003) / 100 if k % 3 else None, k / 7, k % 2 == 0) for k, text in enumerate(ODD)]
    df = spark.createDataFrame(rows, "k long, text string, amount decimal(18,2), x double, even boolean").repartition(3)
    path = fresh_path(spark, "books")
    workbooks.write(df, path)
    assert sorted(map(tuple, workbooks.read(spark, path, df.schema).collect())) == sorted(map(tuple, df.collect()))
    plain = workbooks.read(spark, path)
    assert plain.columns == df.columns and {t for _, t in plain.dtypes} == {"string"}
    assert {r["text"] for r in plain.collect()} == set(ODD)


def test_files_hold_so_many_rows_and_any_reader_reads_them(spark):
    df = spark.range(25).select("id", F.concat(F.lit("n"), "id").alias("name")).coalesce(1)
    path = fresh_path(spark, "books")
    workbooks.write(df, path, rows_per_file=10)
    files = spark.read.format("binaryFile").load(path).select("path", "content").collect()
    assert len(files) == 3
    sizes = sorted(len(list(tabular.xlsx_rows(bytes(f["content"])))) for f in files)
    assert sizes == [6, 11, 11]  # a header in each
    assert workbooks.read(spark, path, "id long").agg(F.sum("id")).first()[0] == 300
    one = spark.read.format("workbook").option("split_bytes", 1).load(path)
    assert one.rdd.getNumPartitions() == 3 and one.count() == 25


def test_columns_are_found_by_name_and_what_cannot_be_read_is_null(spark):
    path = fresh_path(spark, "books")
    workbooks.write(spark.createDataFrame([("12", "x"), ("no", "y")], "a string, b string").coalesce(1), path)
    got = workbooks.read(spark, path, "b string, a long, c string").orderBy("b").collect()
    assert [tuple(r) for r in got] == [("x", 12, None), ("y", None, None)]


def test_modes(spark):
    path = fresh_path(spark, "books")
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    for mode, n in (("append", 1), ("append", 2), ("overwrite", 1)):
        workbooks.write(df, path, mode)
        assert workbooks.read(spark, path).count() == n
    with pytest.raises(Exception, match="1 to 1048575"):
        workbooks.write(df, path, rows_per_file=2_000_000)


def test_a_failed_task_leaves_nothing(spark):
    path = fresh_path(spark, "books")
    bad = spark.range(0, 100, 1, 4).select("id", F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise("x").cast("string").alias("v"))
    with pytest.raises(Exception, match="lost"):
        workbooks.write(bad, path)
    left = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path.rsplit("/", 1)[0]).where(F.contains("path", F.lit(path.rsplit("/", 1)[1]))).count()
    assert left == 0


def test_an_empty_table_and_declarations(spark):
    path = fresh_path(spark, "books")
    workbooks.write(spark.createDataFrame([], "k long"), path)
    assert workbooks.read(spark, path, "k long").count() == 0
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", "<!DOCTYPE x [<!ENTITY a 'b'>]><worksheet><sheetData><row><c><v>&a;</v></c></row></sheetData></worksheet>")
    with pytest.raises(ValueError, match="declarations"):
        list(workbooks.sheet_rows(io.BytesIO(data.getvalue())))
