"""Data-quality tests (Q1-Q3): ``unique`` and ``not_null`` column checks and a
suite over declared (model, column, test) entries.

A suite groups the declared tests by model and reads each model once; failing
rows are never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_unique(df: DataFrame, col: str) -> DataFrame:
    """Failing values: non-NULL values that occur more than once."""
    return (df.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias("n_records"))
            .where(F.col("n_records") > 1))


def check_not_null(df: DataFrame, col: str) -> DataFrame:
    """Failing rows: rows where the column is NULL."""
    return df.where(F.col(col).isNull())


def run_checks(models: dict[str, DataFrame], declared: list[tuple[str, str, str]]) -> DataFrame:
    """One row per declared (model, column, test): failure count and pass flag.

    A model is read once: its rows are counted by the columns that have a
    ``unique`` test (one aggregate by value), and NULLs of all tested columns are
    summed in the same pass."""
    parts = []
    for model in dict.fromkeys(m for m, _, _ in declared):
        tests = [(c, t) for m, c, t in declared if m == model]
        if unknown := [t for _, t in tests if t not in ("unique", "not_null")]:
            raise ValueError(f"unknown test {unknown[0]!r}")
        parts.append(_model_checks(models[model], model, tests))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("passed", F.col("failures") == 0)


def _model_checks(df: DataFrame, model: str, tests: list[tuple[str, str]]) -> DataFrame:
    unique = list(dict.fromkeys(c for c, t in tests if t == "unique"))
    nulls = list(dict.fromkeys(c for c, t in tests if t == "not_null"))
    counts = [F.sum(F.col(c).isNull().cast("bigint")).alias(f"null_{i}") for i, c in enumerate(nulls)]
    if unique:
        # values of each unique column side by side: (which column, value) with its rows and, once, the NULL sums
        entry = F.array(*[F.struct(F.lit(i).alias("which"), F.col(c).cast("string").alias("value"), F.lit(i == 0).alias("first"))
                          for i, c in enumerate(unique)])
        rows = df.select(*[F.col(c).isNull().cast("bigint").alias(f"n_{i}") for i, c in enumerate(nulls)], F.explode(entry).alias("e"))
        by_value = rows.groupBy("e.which", "e.value").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col("e.first"), F.col(f"n_{i}"))).alias(f"null_{i}") for i in range(len(nulls))])
        one = by_value.agg(
            *[F.sum(((F.col("which") == i) & F.col("value").isNotNull() & (F.col("n") > 1)).cast("bigint")).alias(f"dup_{i}") for i in range(len(unique))],
            *[F.sum(f"null_{i}").alias(f"null_{i}") for i in range(len(nulls))])
    else:
        one = df.agg(*counts)
    cells = [F.struct(F.lit(model).alias("model"), F.lit(c).alias("column_name"), F.lit(t).alias("test"),
                      F.coalesce(F.col(f"dup_{unique.index(c)}" if t == "unique" else f"null_{nulls.index(c)}"), F.lit(0)).cast("bigint").alias("failures"))
             for c, t in tests]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")
