"""CSV files with quoted line breaks, read in splits.

A reader that must see whole records takes each file as one task.  Here the lines of a file are read in splits
(a line belongs to the split it starts in), and records are put together afterwards:

* a line with an odd number of quotes opens or closes a quoted field, so the quotes of all lines before it say
  whether a line starts inside a field; each split is summed up to a parity, and a prefix scan over the splits of
  a file gives the parity at the start of each;
* lines that start outside and end outside are whole records and are parsed where they are;
* the other lines are grouped by the line that opens their record, across splits, and joined.

Where no line of a folder has an odd number of quotes, which one narrow pass tells, no record holds a line break and
Spark's own reader takes the lines in splits, without a shuffle.  Lines end with a line feed, alone or after a carriage
return; records come in no particular order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BEFORE = (Window.unboundedPreceding, -1)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, line, odd): every line with its place."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"),
                       F.col("value").alias("line"), (F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'))), F.lit(2)) == 1).alias("odd"))


def _flips(odd: Column | str) -> Column:
    return F.sum(F.col(odd).cast("long") if isinstance(odd, str) else odd)


def records(lines: DataFrame) -> DataFrame:
    """(file, block, seq, record): the records of all files, each with the place of its first line."""
    place = ["file", "block"]
    inner = Window.partitionBy(*place).orderBy("seq")  # the lines of one split
    outer = Window.partitionBy("file").orderBy("block")  # one row for each split of a file
    blocks = lines.groupBy(*place).agg(_flips("odd").alias("flips"))
    blocks = blocks.select(*place, F.coalesce(F.sum("flips").over(outer.rowsBetween(*_BEFORE)), F.lit(0)).alias("before"))
    known = lines.join(blocks, place).withColumn("inside", F.pmod(F.col("before") + F.coalesce(_flips("odd").over(inner.rowsBetween(*_BEFORE)), F.lit(0)), F.lit(2)) == 1)
    known = known.withColumn("opens", ~F.col("inside") & F.col("odd"))
    single = known.where("NOT inside AND NOT odd").select(*place, "seq", F.col("line").alias("record"))
    parts = known.where("inside OR odd")
    # the line that opens a record: in the same split, or the last one that any split before it opens
    own = F.last(F.when(F.col("opens"), F.struct("block", "seq")), True).over(inner)
    parts = parts.withColumn("head", own)
    last = parts.groupBy(*place).agg(F.max(F.when(F.col("opens"), F.struct("block", "seq"))).alias("last"))
    carried = last.select(*place, F.last("last", True).over(outer.rowsBetween(*_BEFORE)).alias("carried"))
    parts = parts.join(carried, place).withColumn("head", F.coalesce("head", "carried"))
    joined = parts.groupBy("file", "head").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "line"))).alias("x"))
    several = joined.select("file", "head.block", "head.seq", F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("record"))
    return single.unionByName(several)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, bad_rows: str = "FAILFAST") -> DataFrame:
    """The rows of CSV files with a header line; fields may be quoted, hold doubled quotes, separators and line breaks."""
    lines = _lines(spark, path)
    if not lines.where("odd").limit(1).count():
        return spark.read.option("header", True).option("mode", bad_rows).option("quote", '"').option("escape", '"').schema(schema).csv(path)
    rows = records(lines)
    first = rows.where("block = 0").groupBy("file").agg(F.min("seq").alias("first"))  # one row for each file
    rows = rows.join(first, "file").where("block > 0 OR seq > first")
    text = F.regexp_replace("record", "\r$", "")
    options = {"mode": bad_rows, "quote": '"', "escape": '"', "multiLine": "true", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = rows.select(text.alias("record")).where(F.length("record") > 0).select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options).alias("row"))
    return parsed.select(*[F.col("row").getField(f.name).alias(f.name) for f in schema])
