import random

import pyarrow as pa
import pytest

import priceloom.operators.joins as joins
import priceloom.sources.csv_ranges as csv_ranges
import priceloom.sources.listings as source
from priceloom.schema import RAW_COLUMNS
from priceloom.sources.csv_ranges import csv_records, read_csv_ranges


def write(path, rows, end="\n", seed=1):
    """Rows as CSV; fields with quotes, commas or line breaks are quoted, others now and then."""
    rng = random.Random(seed)

    def field(v):
        quoted = any(c in v for c in '",\n\r') or rng.random() < 0.2
        return '"' + v.replace('"', '""') + '"' if quoted else v

    path.write_bytes(end.join(",".join(map(field, r)) for r in rows).encode() + rng.choice([b"", end.encode()]))


def table(n, seed):
    rng = random.Random(seed)
    texts = ["plain", 'said "so"', "two\nlines", 'a "b\nc" d', "comma, here", "x" * 3000, "é\n\n€", '"', "\n", "many\n" * 400]
    return [["key", "text", "more"]] + [[f"{seed}-{i}", rng.choice(texts), rng.choice(texts)] for i in range(n)]


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("proven_small", [True, False])
def test_many_tasks_read_what_one_task_reads(spark, tmp_path, small_ranges, monkeypatch, proven_small):
    if not proven_small:
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    tables = [table(150, 1), table(1, 2), [["key", "text", "more"]]]
    for i, rows in enumerate(tables):
        write(tmp_path / f"{i}.csv", rows, seed=i)
    path = str(tmp_path)
    read = read_csv_ranges(spark, path)
    got = sorted(map(tuple, read.collect()))
    assert got == sorted(tuple(r) for rows in tables for r in rows[1:])
    one_task = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    assert got == sorted(map(tuple, one_task.collect()))
    assert spark.read.text(path).rdd.getNumPartitions() > 40


def test_carriage_returns_blank_lines_and_short_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿key,text\r\n\r\n1,"a\r\nb"\r\n\r\n2,\r\n3\r\n"4","say ""hi"""\r\n'.encode())
    read = read_csv_ranges(spark, str(tmp_path))
    assert read.columns == ["key", "text"]
    got = {r.key: r.text for r in read.collect()}
    assert got.keys() == {"1", "2", "3", "4"} and got["2"] is None and got["3"] is None and got["4"] == 'say "hi"'
    assert got["1"].replace("\r\n", "\n") == "a\nb"


def test_headers_must_agree(spark, tmp_path):
    write(tmp_path / "a.csv", [["key", "text"], ["1", "x"]])
    write(tmp_path / "b.csv", [["text", "key"], ["x", "1"]])
    with pytest.raises(Exception, match="header differs"):
        read_csv_ranges(spark, str(tmp_path)).collect()


def test_one_record_longer_than_many_ranges(spark, tmp_path, small_ranges):
    long = "line\n" * 5000
    write(tmp_path / "a.csv", [["key", "text"], ["1", long], ["2", "b"]])
    assert {r.key: r.text for r in read_csv_ranges(spark, str(tmp_path)).collect()} == {"1": long, "2": "b"}
    assert csv_records(spark, str(tmp_path)).where("first").count() == 1


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_listings_on_both_sides_of_the_size(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(source, "RANGE_BYTES", limit)
    rows = [[f"{c} {i}\nline" for c in RAW_COLUMNS] for i in range(20)]
    write(tmp_path / "a.csv", [RAW_COLUMNS, *rows])
    read = source.read_listings_csv(spark, str(tmp_path))
    assert read.columns == RAW_COLUMNS
    assert sorted(map(list, read.collect())) == sorted(rows)
    (tmp_path / "a.csv").write_text("key,text\n1,x\n")
    with pytest.raises(KeyError):
        source.read_listings_csv(spark, str(tmp_path))


def test_the_border_scan_passes_on_no_whole_record():
    lines = ["tail of one", "", "1,a", "2,\"two", "lines\"", "\r", "3,ü", "4,\"goes", "on"]
    columns = {"range": [7] * 9, "odd": [False] * 9, "top": [False] * 9, "value": [f"{x}\n" for x in lines]}
    found = {}
    for border in (True, False):
        batches = pa.table(columns).to_batches(max_chunksize=4)
        out = pa.Table.from_batches(list(csv_ranges._cut(border)(iter(batches))))
        found[border] = list(zip(out.column("part").to_pylist(), out.column("record").to_pylist()))
        assert set(out.column("range").to_pylist()) == {7} and not any(out.column("first").to_pylist())
    assert found[True] == [(csv_ranges.TAIL, "4,\"goes\non")]
    assert found[False] == [(csv_ranges.WHOLE, r) for r in ("tail of one", "1,a", "2,\"two\nlines\"", "3,ü")] + found[True]
    inside = {**columns, "odd": [True] * 9, "value": [f"{x}\n" for x in ["goes", "on\"", *lines[2:]]]}
    out = pa.Table.from_batches(list(csv_ranges._cut(True)(iter(pa.table(inside).to_batches()))))
    assert out.column("part").to_pylist() == [csv_ranges.HEAD, csv_ranges.TAIL]
    assert out.column("record").to_pylist() == ["goes\non\"", "4,\"goes\non"]
