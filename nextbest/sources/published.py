"""Published tables: replaced as a whole, read by name, looked up by key.

A published table is a folder of versions and pointers.  A write goes to a version folder of its own; only when it
has ended does a numbered pointer name that version, and readers follow the pointer with the highest number that is
complete.  A write that fails half way leaves no pointer, so the rows before it stay readable; two writers take
different numbers.  The version before the current one is kept for readers that already planned their scan.

Pointers are one small file each, created once and never changed, through the Hadoop file system of the path.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIXES = 256
PREFIX = "key_prefix"


class PublishedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- pointers ------------------------------------------------------------
    def _pointers(self) -> list[tuple[int, str]]:
        """(number, version) of the complete pointers, in order."""
        folder = self._path(f"{self.root}/_pointers")
        if not self._store.exists(folder):
            return []
        found = []
        for status in self._store.listStatus(folder):
            name = status.getPath().getName()
            if name.isdigit():
                found.append((int(name), self._content(status.getPath()).removesuffix("\n") if status.getLen() else ""))
        return sorted((n, version) for n, version in found if version)

    def _content(self, path) -> str:
        stream = self._store.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return text if text.endswith("\n") else ""

    def _point(self, version: str) -> None:
        """Make ``version`` the current one under the first free number."""
        number = max((n for n, _ in self._pointers()), default=0)
        while True:
            number += 1
            path = self._path(f"{self.root}/_pointers/{number:020d}")
            try:
                stream = self._store.create(path, False)  # fails if another writer took the number
            except Exception:
                if not self._store.exists(path):
                    raise
                continue
            try:
                stream.write(bytearray(f"{version}\n".encode()))
            finally:
                stream.close()
            return

    # -- rows ----------------------------------------------------------------
    def versions(self) -> list[str]:
        return [version for _, version in self._pointers()]

    def replace(self, df: DataFrame, prefix_of: str | None = None, prefixes: int = PREFIXES) -> DataFrame:
        """Create or replace the table with the rows of ``df``; with ``prefix_of`` partitioned by that key's hash prefix."""
        version = f"v-{uuid.uuid4().hex}"
        place = f"{self.root}/{version}"
        if prefix_of:
            marked = df.withColumn(PREFIX, key_prefix(prefix_of, prefixes))
            marked.repartition(PREFIX).write.partitionBy(PREFIX).parquet(place)
        else:
            df.write.parquet(place)
        self._point(version)
        self._clean()
        return self.read()

    def read(self) -> DataFrame:
        """The rows of the current version."""
        versions = self.versions()
        if not versions:
            raise FileNotFoundError(f"nothing is published at {self.root}")
        return self.spark.read.parquet(f"{self.root}/{versions[-1]}")

    def _clean(self, keep: int = 2) -> None:
        """Remove the versions before the last ``keep``, their pointers first."""
        for number, version in self._pointers()[:-keep]:
            self._store.delete(self._path(f"{self.root}/_pointers/{number:020d}"), False)
            self._store.delete(self._path(f"{self.root}/{version}"), True)


def key_prefix(key: str, prefixes: int = PREFIXES) -> Column:
    """The partition of a key: its hash modulo the number of prefixes."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(prefixes)).cast("int")


def rows_of(table: DataFrame, asked: DataFrame, key: str, prefixes: int = PREFIXES) -> DataFrame:
    """The rows of a table partitioned by ``key``'s prefix whose key is asked for.

    The prefixes that occur among the asked keys, at most ``prefixes`` numbers, are read when the frame is made, so that
    the scan opens only their partitions, however the join is run."""
    keys = asked.select(key).where(F.col(key).isNotNull()).distinct().withColumn(PREFIX, key_prefix(key, prefixes))
    some = sorted(r[PREFIX] for r in keys.select(PREFIX).distinct().collect())
    return table.where(F.col(PREFIX).isin(some)).join(keys, [PREFIX, key], "left_semi").drop(PREFIX)


# -- tables by name ------------------------------------------------------------
class SchemaMismatch(ValueError):
    """A table's files do not hold the declared columns."""


def declare(spark: SparkSession, name: str, location: str, schema: T.StructType) -> None:
    """Enter ``SCHEMA.TABLE`` as an external table over the Parquet files at ``location``, after a check that they hold
    the declared columns with the declared types."""
    database, _, table = name.rpartition(".")
    if not (database.isidentifier() and table.isidentifier()):
        raise ValueError(f"{name!r} is no name of the form SCHEMA.TABLE")
    found = {f.name.lower(): f.dataType for f in spark.read.parquet(location).schema}
    wrong = [f"{f.name}: declared {f.dataType.simpleString()}, found {found[f.name.lower()].simpleString() if f.name.lower() in found else 'nothing'}"
             for f in schema if found.get(f.name.lower()) != f.dataType]
    if wrong:
        raise SchemaMismatch(f"{name}: {'; '.join(wrong)}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    spark.sql(f"DROP TABLE IF EXISTS {database}.{table}")  # external: the files stay
    spark.catalog.createTable(f"{database}.{table}", path=location, source="parquet", schema=schema)
