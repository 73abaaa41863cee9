"""Sources, sinks and streams on small files."""

import json
import zipfile

from pyspark.sql import functions as F

from scorewright.sources import readers, sinks
from scorewright.streaming import events


def test_csv_with_mark_blanks_and_missing_files(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("﻿id,name,extra\n1,,x\n2,b,y\n", encoding="utf-8")
    rows = readers.csv(spark, str(p), ["id", "name", "other"]).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "", ""), ("2", "b", "")]
    assert readers.csv(spark, str(tmp_path / "none.csv"), ["id"]).count() == 0
    assert readers.missing_columns(spark, str(p), ["id", "q"]) == ["q"]


def test_mapped_takes_the_first_filled_synonym(spark):
    df = spark.createDataFrame([("", "u", "t"), ("x", "v", "s")], "Title string, Headline string, Extra string")
    assert [tuple(r) for r in readers.mapped(df, {"title": ["headline"], "url": ["link"]}).collect()] == [("u", ""), ("x", "")]


def test_records_in_every_shape(spark, tmp_path):
    item = {"a": 1, "b": "x"}
    for name, value in (("list", [item, item]), ("object", item), ("wrapped", {"items": [item]})):
        p = tmp_path / f"{name}.json"
        p.write_text(json.dumps(value))
        assert {tuple(r) for r in readers.records(spark, str(p), "a int, b string").collect()} == {(1, "x")}
    p = tmp_path / "lines.jsonl"
    p.write_text(json.dumps(item) + "\n" + json.dumps(item) + "\n")
    assert readers.records(spark, str(p), "a int, b string").count() == 2


def test_parsed_records_tell_failures(spark, tmp_path):
    (tmp_path / "x_parsed.json").write_text('{"score": 3}')
    (tmp_path / "y_parsed.json").write_text('{"score": ')
    got = {r["path"].rsplit("/", 1)[-1]: (r["ok"], r["record"]["score"] if r["record"] else None) for r in readers.parsed_records(spark, str(tmp_path), "score int").collect()}
    assert got == {"x_parsed.json": (True, 3), "y_parsed.json": (False, None)}


def test_archives_office_files_and_discovery(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.csv", "k,v\n1,a\n2,b\n")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>Hello</w:t></w:p></w:document>')
    (tmp_path / "c.docx").write_bytes(b"no archive")
    (tmp_path / "d.txt").write_text("plain")
    rows = readers.archive_rows(spark, str(tmp_path / "a.zip"), ["k", "v"]).orderBy("row_ord").collect()
    assert [(r["member"], r["k"], r["v"]) for r in rows] == [("one.csv", "1", "a"), ("one.csv", "2", "b")]
    office = {r["path"].rsplit("/", 1)[-1]: (r["text"], r["error"]) for r in readers.office_files(spark, str(tmp_path)).collect()}
    assert office == {"b.docx": ("Hello", ""), "c.docx": ("", "unreadable_docx"), "d.txt": ("plain", "")}
    kinds = {r["path"].rsplit("/", 1)[-1]: r["kind"] for r in readers.discovered(spark, str(tmp_path), ["c.docx"]).collect()}
    assert kinds == {"a.zip": "archive", "b.docx": "text", "d.txt": "text"}


def test_checksums_tell_changes(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a").write_text("1")
    before = spark.createDataFrame(readers.checksums(spark, str(d)).collect())
    (d / "a").write_text("2")
    (d / "b").write_text("3")
    got = {r["path"].rsplit("/", 1)[-1]: r["change"] for r in readers.changed(before, readers.checksums(spark, str(d))).collect()}
    assert got == {"a": "altered", "b": "added"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "z"), (2, "q", "w")], "a int, b string, c string")
    sinks.write_csv(df, str(tmp_path / "o"), ["b", "a", "none"])
    got = sorted(tuple(r) for r in readers.csv(spark, str(tmp_path / "o"), ["a", "b", "none"]).collect())
    assert got == [("1", "", ""), ("2", "q", "")]
    path = str(tmp_path / "p")
    spark.createDataFrame([(1, "x"), (2, "y")], "v int, k string").write.partitionBy("k").parquet(path)
    sinks.replace_partitions(spark.createDataFrame([(9, "y")], "v int, k string"), path, "k")
    assert sorted((r["v"], r["k"]) for r in spark.read.parquet(path).collect()) == [(1, "x"), (9, "y")]
    kept = sinks.without_keys(df, df.where("a = 1").withColumn("c", F.lit("new")), ["a"])
    assert sorted((r["a"], r["c"]) for r in kept.collect()) == [(1, "new"), (2, "w")]
    assert sinks.markdown(df.where("a = 1")).splitlines()[-1] == "| 1 |  | z |"
    assert sum(r["n"] for r in sinks.histogram(spark.range(50), "id").collect()) == 50


def test_stream_drops_copies(spark, tmp_path):
    rows = [(i % 6, f"2024-01-01 00:00:0{i % 6}", i, "view", 1.0, "{}") for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = events.append_to(events.deduplicated(events.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
