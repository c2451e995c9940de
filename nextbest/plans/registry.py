"""Query registry: name -> (spark, sf_dir) -> DataFrame, plus its oracle SQL."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nextbest.plans.models import Models
from nextbest.session import apply_tuning

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
# the same queries as functions of a model graph, for plan reports
MODEL_QUERIES: dict[str, Callable[[Models], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# One model graph per application, input folder and state of its files: queries share its written tables.
_MODELS: dict[tuple[str, str, str], Models] = {}


def fingerprint(spark: SparkSession, folder: str) -> str:
    """A digest of the names, sizes and times of change of all files below a folder; one listing a level, no data read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    digest, below = hashlib.sha256(), folder.rstrip("/")
    while True:
        below += "/*"
        found = store.globStatus(path(below))
        if found is None or not len(found):
            return digest.hexdigest()
        # reading a file changes its time of access only
        digest.update(re.sub(r"access_time=\d+; ?", "", jvm.org.apache.commons.lang3.ArrayUtils.toString(found)).encode())


def models_for(spark: SparkSession, sf_dir: str) -> Models:
    """The shared model graph of a folder.  Files that were added, removed or written anew give a new graph, which builds
    its tables again; frames made before go on reading the old tables until ``forget``."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), fingerprint(spark, sf_dir))
    m = _MODELS.get(key)
    if m is None or m.spark is not spark:
        m = _MODELS[key] = Models(spark, sf_dir.rstrip("/"))
    return m


def forget(spark: SparkSession, sf_dir: str) -> None:
    """Drop the shared model graphs of a folder and their written tables; the next query builds anew."""
    for key in [k for k in _MODELS if k[:2] == (spark.sparkContext.applicationId, sf_dir.rstrip("/"))]:
        _MODELS.pop(key).close()


def query(name: str, oracle: str | None = None):
    """Register ``fn(models) -> DataFrame`` as query ``name``."""

    def deco(fn: Callable[[Models], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_tuning(spark)
            return fn(models_for(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        MODEL_QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from nextbest.plans import (  # noqa: F401
        answer_queries,
        gold_queries,
        insight_queries,
        quality_queries,
        signal_queries,
        source_queries,
    )
