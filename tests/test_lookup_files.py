"""Lookup files: malformed records set aside, line breaks, null against empty text."""
import os

import pytest
from pyspark.sql import types as T

from leadspark.sources import files

SCHEMA = T.StructType([T.StructField("zip", T.StringType()), T.StructField("n", T.IntegerType()),
                       T.StructField("note", T.StringType())])


def _file(tmp_path, text):
    path = tmp_path / "lookup.csv"
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def test_bad_records_are_set_aside(spark, tmp_path):
    path = _file(tmp_path, 'zip,n,note\n01234,1,"two\nlines, and a ""quote"""\n00001,x,not a number\n'
                           '00002,2\n00003,3,a,b\n00004,,\n00005,5,""\n')
    quarantine = str(tmp_path / "bad")
    for k in (1, 2):  # a second read appends
        got = files.read_lookup(spark, path, SCHEMA, quarantine)
        assert (got.n_rows, got.n_bad) == (3, 3)
        assert sorted(map(tuple, got.rows.collect())) == [
            ("00004", None, None), ("00005", 5, ""), ("01234", 1, 'two\nlines, and a "quote"')]
        bad = spark.read.parquet(quarantine)
        assert bad.count() == 3 * k and bad.select("read_id").distinct().count() == k
        assert {r.record.strip() for r in bad.collect()} == {"00001,x,not a number", "00002,2", "00003,3,a,b"}
        assert {r.path for r in bad.collect()} == {path}


def test_a_file_of_another_layout_is_refused(spark, tmp_path):
    path = _file(tmp_path, "zip,n,note\n1,2\n3,4\n5,6,z\n")
    with pytest.raises(ValueError, match="2 of 3"):
        files.read_lookup(spark, path, SCHEMA, str(tmp_path / "bad"), most_bad=0.5)
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2
    with pytest.raises(Exception):
        files.read_lookup_csv(spark, path, SCHEMA).collect()


def test_empty_and_clean_files(spark, tmp_path):
    got = files.read_lookup(spark, _file(tmp_path, "zip,n,note\n"), SCHEMA, str(tmp_path / "bad"))
    assert (got.n_rows, got.n_bad, got.rows.count()) == (0, 0, 0) and not os.path.exists(tmp_path / "bad")
    with pytest.raises(ValueError):
        files.read_lookup(spark, "x", T.StructType([T.StructField("_bad_record", T.StringType())]))


@pytest.mark.parametrize("multiline", [False, True])
def test_export_keeps_nulls_empty_texts_and_blanks(spark, tmp_path, multiline):
    rows = [("", None, None), (None, 1, ""), (" a ", 2, 'say "x", y'), ("-", 3, "tab\tand é"), ("\\", 4, "null")]
    if multiline:
        rows.append(("line\nbreak", 5, "cr\r\nlf"))
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "out")
    files.export_csv(df, path)
    back = files.read_lookup(spark, path, SCHEMA, multiline=multiline)
    assert sorted(map(tuple, back.rows.collect()), key=repr) == sorted(rows, key=repr) and back.n_bad == 0
    assert sorted(map(tuple, files.read_lookup_csv(spark, path, SCHEMA, multiline=multiline).collect()), key=repr) == sorted(
        rows, key=repr)
