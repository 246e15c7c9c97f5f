"""Records with line breaks in fields, put together from byte ranges, against the sequential reader."""

import csv
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from monofila.sources.delimited import scan
from monofila.sources.records import records, states
from monofila.schemas import SOURCES


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "10", "spark.sql.files.minPartitionNum": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def written(folder, seed, ending="\n", rows=150):
    rng = random.Random(seed)

    def field():
        if rng.random() < 0.7:
            return rng.choice(["plain", "", "5 inch", "é", "a b", "12"])
        return '"' + rng.choice(["a\nb", "x;y|z", 'say ""hi""', "\n\nlong " * rng.choice([1, 1, 1, 60]), "", 'é\n"";""', '""\n']) + '"'

    path = folder / f"f{seed}.csv"
    with open(path, "w", encoding="latin-1", newline="") as out:
        out.write(f"a|b|c{ending}")
        for _ in range(rows):
            out.write("|".join(field() for _ in range(3)) + ending * (1 + (rng.random() < 0.05)))
    return str(path)


def sequential(path):
    """Rows as the csv module reads them, and how many empty lines lie between them."""
    with open(path, encoding="latin-1", newline="") as f:
        rows = [[v.replace("\r\n", "\n") for v in r] for r in csv.reader(f, delimiter="|")]
    return [r for r in rows if r], sum(not r for r in rows)


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_rows_of_many_ranges_equal_the_sequential_reader(spark, tmp_path, small_ranges, ending):
    paths = [written(tmp_path, seed, ending) for seed in (1, 2, 3)]
    found = records(spark, paths, "|")
    options = {"sep": "|", "quote": '"', "escape": '"', "multiLine": "true", "emptyValue": "", "nullValue": "\0"}
    rows = found.rows.filter("record != ''").select("heading", F.from_csv("record", "a string, b string, c string", options).alias("r"))
    want = [sequential(p) for p in paths]
    got = sorted(tuple(v or "" for v in r.r) for r in rows.collect())
    assert got == sorted(tuple(r) for part, _ in want for r in part)
    assert [tuple(r.r) for r in rows.filter("heading").collect()] == [("a", "b", "c")] * 3
    assert found.blank == sum(n for _, n in want)


def test_a_single_large_file_is_read_by_several_tasks(spark, tmp_path, small_ranges):
    path = written(tmp_path, 9, rows=400)
    assert records(spark, [path], "|").rows.rdd.getNumPartitions() > 20
    # One record longer than several ranges, and a field that nobody closes.
    long, cut = tmp_path / "long.csv", tmp_path / "cut.csv"
    long.write_text('a|b\n1|"' + "x\n" * 2_000 + '"\n2|y\n')
    cut.write_text('a|b\n1|"open\n' + "rest\n" * 300)
    assert sorted(len(r.record) for r in records(spark, [str(long)], "|").rows.collect()) == [3, 3, 4_004]
    assert sorted(len(r.record) for r in records(spark, [str(cut)], "|").rows.collect()) == [3, 7 + 5 * 300]


def test_loader_reads_such_files_alike_in_small_and_large_ranges(spark, tmp_path, small_ranges):
    source = next(s for s in SOURCES if s.separator == "|" and not s.shared)
    names = list(source.columns)[:3]
    rng = random.Random(4)
    with open(tmp_path / source.file, "w", encoding="latin-1", newline="") as out:
        out.write("|".join([*names, "other"]) + "\n")
        for i in range(300):
            out.write(f'{i}|"a\n\nñ {rng.random()}"|c|d\n' + ("\n" if i % 50 == 0 else "") + ("short|row\n" if i % 70 == 0 else ""))
    small = scan(spark, str(tmp_path / source.file), source)
    rows = sorted(tuple(r) for r in small.rows.select(*names, "_short").collect())
    assert small.ignored == ["other"] and small.blank_lines == 6
    assert sum(r[-1] for r in rows) == 5 and len(rows) == 305
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100m")
    assert sorted(tuple(r) for r in scan(spark, str(tmp_path / source.file), source).rows.select(*names, "_short").collect()) == rows


def test_states_compose():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(0, 12))
        outside, inside = rng.random(n) < 0.5, rng.random(n) < 0.5
        for entered in (False, True):
            want = [entered]
            for o, i in zip(outside, inside):
                want.append(bool(i if want[-1] else o))
            assert states(entered, outside, inside).tolist() == want
