"""Exploratory insights as distributed aggregates.

Nothing is collected to the driver: every number is a (small) aggregate
DataFrame; one-row aggregates are broadcast where they are joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nextbest import constants as C
from nextbest.functions.scalars import round_half_up
from nextbest.sources import dims


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts per non-NULL value, most frequent first (ties by value)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col(col)))


def avg_amount_by_category(txn: DataFrame) -> DataFrame:
    """Mean amount per category, highest first."""
    return (txn.where(F.col("category").isNotNull()).groupBy("category")
            .agg(F.avg("amount").alias("avg_amount"))
            .orderBy(F.col("avg_amount").desc(), F.col("category")))


def products_per_customer(held: DataFrame) -> DataFrame:
    """Non-NULL product ids per customer (not distinct)."""
    return (held.where(F.col("customer_id").isNotNull()).groupBy("customer_id")
            .agg(F.count("product_id").alias("num_products")))


def products_per_customer_stats(held: DataFrame) -> DataFrame:
    per = products_per_customer(held)
    # exact decimal mean, rounded half-up
    return per.agg(round_half_up(F.avg(F.col("num_products").cast("decimal(38,0)")), 2).cast("double")
                   .alias("avg_products"),
                   F.max("num_products").alias("max_products"),
                   F.min("num_products").alias("min_products"))


def value_weights(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by..., value, weight): rows per distinct value, what distribution numbers are made from."""
    return (df.where(F.col(value).isNotNull()).groupBy(*by, value)
            .agg(F.count(F.lit(1)).alias("weight")))


def histogram(weights: DataFrame, col: str, bins: int = 8) -> DataFrame:
    """Equal-width histogram over [min, max] from a frame of ``value_weights``
    (written, as it is read for the range and for the counts); the last bin is
    closed on the right; min == max widens the range by 0.5 on each side.
    Empty bins are emitted with count 0."""
    x = F.col(col).cast("double")
    stats = weights.agg(F.min(x).alias("_mn"), F.max(x).alias("_mx"))
    stats = stats.select(
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"))
    rng = stats.select(F.struct("_lo", "_hi")).scalar()  # one subquery, both bounds
    lo, hi = rng.getField("_lo"), rng.getField("_hi")
    binned = (weights.select(F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int").alias("bin"), "weight")
              .groupBy("bin").agg(F.sum("weight").alias("count")))
    # the one-row range frame carries the bin numbers 0..bins-1
    edges = stats.select("_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return (edges.join(binned, "bin", "left")
            .select("bin",
                    (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
                    (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"),
                    F.coalesce(F.col("count"), F.lit(0)).alias("count"))
            .orderBy("bin"))


def ranged_weights(df: DataFrame, value: str, by: str) -> DataFrame:
    """(by, value, weight, part): ``value_weights`` in ranges of (by, value).  To be written: the parts must not change
    between two reads."""
    x = F.col(value).cast("double").alias(value)
    return value_weights(df.where(F.col(by).isNotNull()).select(by, x), value, by).repartitionByRange(by, value).withColumn("part", F.spark_partition_id())


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Box-plot numbers per group of ``df``; see ``box_of``."""
    return box_of(ranged_weights(df, value, by).checkpoint(), value, by)


def box_of(ranged: DataFrame, value: str, by: str) -> DataFrame:
    """Box-plot numbers per group from written ``ranged_weights``: quartiles (linear interpolation), whiskers at the
    furthest points within 1.5 IQR, and the outlier count.

    A rank is looked for in two steps.  The totals of a group's parts, one number a part, tell which part holds it;
    only those parts are sorted, each by itself.  So a group with most rows, or with all values different, is never
    in one task."""
    totals = ranged.groupBy(by, "part").agg(F.sum("weight").alias("weight"))
    groups = totals.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("part", "weight"))).alias("parts"), F.sum("weight").alias("total"))
    quarters = (0.25, 0.5, 0.75)

    def place(q: float):
        return (F.col("total") - 1) * q

    def found(rank):
        """The part that holds a rank, and how many rows of the group lie before that part."""
        nowhere = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("bigint").alias("before"))
        return F.aggregate("parts", nowhere, lambda at, p: F.struct(
            (at["seen"] + p["weight"]).alias("seen"),
            F.when(at["part"].isNull() & (rank < at["seen"] + p["weight"]), p["part"]).otherwise(at["part"]).alias("part"),
            F.when(at["part"].isNull() & (rank < at["seen"] + p["weight"]), at["seen"]).otherwise(at["before"]).alias("before")))

    ranks = [f(place(q)).cast("bigint") for q in quarters for f in (F.floor, F.ceil)]
    asked = groups.select(by, "total", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), r.alias("rank"), found(r).alias("at")) for i, r in enumerate(ranks)])).alias("x"))
    asked = asked.groupBy(by, F.col("x.at.part").alias("part")).agg(
        F.max("total").alias("total"), F.collect_list(F.struct("x.i", (F.col("x.rank") - F.col("x.at.before")).alias("rank"))).alias("asked"))
    inside = ranged.join(asked, [by, "part"])
    before = F.coalesce(F.sum("weight").over(Window.partitionBy(by, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = inside.withColumn("_before", before).withColumn(
        "hit", F.explode(F.filter("asked", lambda r: (F.col("_before") <= r["rank"]) & (r["rank"] < F.col("_before") + F.col("weight")))))
    at = hits.groupBy(by).agg(F.max("total").alias("total"), *[F.max(F.when(F.col("hit.i") == i, F.col(value))).alias(f"_{i}") for i in range(len(ranks))])

    def quantile(k: int):
        low, high = F.col(f"_{2 * k}"), F.col(f"_{2 * k + 1}")
        return low + (place(quarters[k]) - F.floor(place(quarters[k]))) * (high - low)

    box = at.select(by, *[quantile(k).alias(n) for k, n in enumerate(("q1", "median", "q3"))])
    # back to the rows by part, so that the group alone is no join key of theirs
    by_part = box.join(groups.select(by, "parts"), by).select(by, "q1", "median", "q3", F.explode("parts.part").alias("part"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    near = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return (ranged.join(by_part, [by, "part"]).groupBy(by, "q1", "median", "q3")
            .agg(F.min(F.when(near, F.col(value))).alias("whisker_low"),
                 F.max(F.when(near, F.col(value))).alias("whisker_high"),
                 F.sum(F.when(near, 0).otherwise(F.col("weight"))).cast("bigint").alias("outliers"))
            .orderBy(by))


def owned_sets(held: DataFrame, col: str = "product_id") -> DataFrame:
    """Per customer the sorted set of held products.  Pairs are de-duplicated
    first, so a set holds at most one entry per distinct product."""
    pairs = held.where(F.col("customer_id").isNotNull() & F.col(col).isNotNull()).select("customer_id", col).distinct()
    return pairs.groupBy("customer_id").agg(F.array_sort(F.collect_list(col)).alias("owned"))


def missing_products(held: DataFrame) -> DataFrame:
    """Per customer with holdings, each catalog product it does not hold.

    The catalog is a fixed 8-entry literal: the owned set is restricted to
    it (bounded) and subtracted from the literal array -- no cross join."""
    catalog = F.array(*[F.lit(p) for p in C.PRODUCT_IDS])
    holders = held.where(F.col("customer_id").isNotNull())
    owned = (holders.select("customer_id", F.when(F.col("product_id").isin(C.PRODUCT_IDS), F.col("product_id"))
                            .alias("product_id"))
             .groupBy("customer_id").agg(F.collect_set("product_id").alias("_owned")))
    return owned.select("customer_id", F.explode(F.array_except(catalog, F.col("_owned"))).alias("product_id"))


def missing_product_counts(held: DataFrame) -> DataFrame:
    """Per catalog product, how many customers with holdings lack it, with
    its name, most missed first.  Computed as holders - adopters per product
    (two aggregates), not by listing every missing pair."""
    holders = held.where(F.col("customer_id").isNotNull())
    n = holders.select(F.countDistinct("customer_id")).scalar()
    adopters = (holders.where(F.col("product_id").isin(C.PRODUCT_IDS))
                .groupBy("product_id").agg(F.countDistinct("customer_id").alias("_adopters")))
    catalog = dims.small(dims.product_labels(held.sparkSession).select("product_id", "product_name"))
    return (catalog.join(adopters, "product_id", "left")
            .select("product_id", "product_name",
                    (n - F.coalesce(F.col("_adopters"), F.lit(0))).alias("missing_count"))
            .where(F.col("missing_count") > 0)
            .orderBy(F.col("missing_count").desc(), F.col("product_name")))


def insight_summary(cust: DataFrame, txn: DataFrame, held: DataFrame) -> DataFrame:
    """One row: totals, average products per customer (2 dp), the most missed
    product, its count and its share of all customers (1 dp).

    Holdings are reduced once to a row per customer (its number of products and
    which of the catalog's it lacks) and those to one row; customers and
    transactions are counted in one pass each."""
    per = (held.where(F.col("customer_id").isNotNull()).groupBy("customer_id")
           .agg(F.count("product_id").alias("n"),
                *[F.max(F.when(F.col("product_id") == p, 0).otherwise(1) * -1).alias(f"has_{i}") for i, p in enumerate(C.PRODUCT_IDS)]))
    # has_i is 0 for an owner and -1 for a customer without the product
    one = per.agg(F.avg(F.col("n").cast("decimal(18,0)")).alias("mean"),
                  *[F.coalesce(-F.sum(f"has_{i}"), F.lit(0)).alias(f"miss_{i}") for i in range(len(C.PRODUCT_IDS))])
    missed = F.array(*[F.struct((-F.col(f"miss_{i}")).alias("key"), F.lit(name).alias("name")) for i, name in enumerate(C.PRODUCT_NAMES)])
    top = F.array_min(F.filter(missed, lambda m: m["key"] < 0))
    out = one.select(
        cust.select(F.count(F.lit(1))).scalar().alias("total_customers"),
        txn.select(F.count(F.lit(1))).scalar().alias("total_transactions"),
        round_half_up(F.col("mean"), 2).cast("double").alias("avg_products_per_customer"),
        top["name"].alias("biggest_opportunity"), (-top["key"]).alias("biggest_opportunity_count"))
    return out.where(F.col("biggest_opportunity").isNotNull()).withColumn(
        "cross_sell_gap_pct",
        round_half_up(F.col("biggest_opportunity_count") / F.col("total_customers") * 100, 1))


def null_profile(df: DataFrame) -> DataFrame:
    """NULL count per column in one pass, as (column_name, null_count) rows."""
    counts = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "null_count").select(
        "column_name", F.coalesce(F.col("null_count"), F.lit(0)).cast("bigint").alias("null_count"))


def table_overview(tables: dict[str, DataFrame]) -> DataFrame:
    """Row and column counts per named table."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count"))
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def service_summary(features: DataFrame, recs: DataFrame) -> DataFrame:
    """Customers served and recommendations available."""
    return features.agg(F.count(F.lit(1)).alias("total_customers")).select(
        "total_customers", recs.select(F.count(F.lit(1))).scalar().alias("total_recommendations"))
