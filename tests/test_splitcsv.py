"""CSV in splits against the reader that takes whole files."""

from __future__ import annotations

import csv
import random

import pytest
from pyspark.sql import types as T

from nextbest.sources import splitcsv

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b", "c")])
PIECES = ["x", "yy", ",", '"', "\n", "\n\n", " ", "é", "12", "", "a,b", 'say "hi"', "tail\n"]


def whole(spark, path):
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').schema(SCHEMA).csv(path)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}

    def use(size):
        for n in names:
            spark.conf.set(n, str(size if n == names[0] else 1))
    yield use
    for n, v in old.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", [40, 97, 1000, 1 << 27])
def test_quoted_breaks_at_every_split(spark, tmp_path, small_splits, size):
    rng = random.Random(size)
    for k in range(3):
        with open(tmp_path / f"{k}.csv", "w", newline="") as f:
            out = csv.writer(f, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
            out.writerow(["a", "b", "c"])
            for i in range(60):
                out.writerow([f"k{i}", "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 6))), rng.choice(["", "z", "end\nof"])])
    want = rows_of(whole(spark, str(tmp_path)))
    assert len(want) == 180
    small_splits(size)
    got = splitcsv.read_csv(spark, str(tmp_path), SCHEMA)
    assert rows_of(got) == want


def test_files_without_breaks_are_not_shuffled(spark, tmp_path, small_splits):
    (tmp_path / "one.csv").write_text('a,b,c\n1,"two ""2""",3\n\n4,,"6,7"\r\n')
    small_splits(8)
    got = splitcsv.read_csv(spark, str(tmp_path), SCHEMA)
    assert rows_of(got) == [("1", 'two "2"', "3"), ("4", None, "6,7")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan


def test_bad_rows(spark, tmp_path):
    (tmp_path / "one.csv").write_text('a,b,c\n1,"two\nlines",3\n4,5\n')
    with pytest.raises(Exception):
        splitcsv.read_csv(spark, str(tmp_path), SCHEMA).collect()
    kept = splitcsv.read_csv(spark, str(tmp_path), T.StructType([*SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())]), "PERMISSIVE").collect()
    assert sorted((r.a, r._corrupt_record) for r in kept) == [("1", None), ("4", "4,5")]
