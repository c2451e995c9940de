"""Recommendation signals: content (cosine), collaborative (ALS or a
deterministic stand-in), segment affinity, and their hybrid blend.

Scale notes
-----------
* Content scores are row-local: the 8 product profiles are literals, so each
  customer row yields its 8 cosines, drops owned products and keeps its top 3
  with array functions -- no join, no shuffle, whole-stage codegen around it.
* Global min-max bounds are one scalar subquery (a struct of all six
  bounds, a single global aggregate run once); never an un-partitioned
  window and no cross join.
* The hybrid merge re-partitions the (<= 6 per customer) candidate rows once
  by customer_id; the merge aggregate, the join with the customer_id-bucketed
  features and the per-customer top-k all reuse that partitioning.
* Collaborative filtering is ``pyspark.ml`` block ALS on dense integer ids.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nextbest import constants as C
from nextbest.functions.scalars import round_half_up
from nextbest.sources import dims

SCORE_KEY_DP = 10  # ranking key: score rounded to 10 dp (stable ties), then name


# ---------------------------------------------------------------------------
# content signal
# ---------------------------------------------------------------------------
def customer_vectors(features: DataFrame) -> DataFrame:
    """Per customer the 8 spend shares in vector order; missing share -> 0."""
    return features.select("customer_id", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in C.SHARE_COLUMNS])


VEC = [f"_s{i}" for i in range(len(C.SHARE_COLUMNS))]
NORM = "_norm"


def with_vector(df: DataFrame) -> DataFrame:
    """Add the share vector (missing share -> 0) as ``_s0.._s7`` and its
    Euclidean norm as ``_norm``, computed once per row."""
    v = df.select("*", *[F.coalesce(F.col(c), F.lit(0.0)).alias(s) for c, s in zip(C.SHARE_COLUMNS, VEC)])
    sq = None
    for s in VEC:
        term = F.col(s) * F.col(s)
        sq = term if sq is None else sq + term
    return v.withColumn(NORM, F.sqrt(sq))


def cosine(weights: list[float]) -> Column:
    """Cosine of the row's share vector (see ``with_vector``) with a literal
    weight vector; a zero vector scores 0."""
    dot = None
    for s, w in zip(VEC, weights):
        term = F.col(s) * float(w)
        dot = term if dot is None else dot + term
    w_norm = math.sqrt(sum(float(w) * float(w) for w in weights))
    norm = F.col(NORM)
    return F.when(norm == 0, 0.0).otherwise(dot / (norm * w_norm))


def cosine_columns() -> dict[str, Column]:
    return {name: cosine(C.PRODUCT_PROFILES[name]) for name in C.PRODUCT_NAMES}


def cosine_wide(features: DataFrame) -> DataFrame:
    """customer_id + one cosine column per product."""
    v = with_vector(features)
    return v.select("customer_id", *[c.alias(f"{n}_score") for n, c in cosine_columns().items()])


def _score_array(features: DataFrame) -> Column:
    """Array of (rank key, product, score, owned) structs, one per product;
    ``features`` must carry the vector columns of ``with_vector``."""
    cols = cosine_columns()
    structs = []
    for name, flag in zip(C.PRODUCT_NAMES, C.FLAG_COLUMNS):
        score = cols[name]
        structs.append(F.struct(
            (-F.round(score, SCORE_KEY_DP)).alias("key"),
            F.lit(name).alias("product_name"),
            score.alias("score"),
            (F.coalesce(F.col(flag), F.lit(0)) == 1).alias("owned")))
    return F.array(*structs)


def content_scores(features: DataFrame) -> DataFrame:
    """Long form: every customer x 8 products with the raw cosine and its rank."""
    v = with_vector(features)
    ranked = F.sort_array(_score_array(v))
    return (v.select("customer_id", F.posexplode(ranked).alias("pos", "s"))
            .select("customer_id", F.col("s.product_name").alias("product_name"),
                    F.col("s.score").alias("score"), (F.col("pos") + 1).alias("score_rank"),
                    F.col("s.owned").alias("owned")))


def content_recommendations(features: DataFrame, k: int = C.TOP_K) -> DataFrame:
    """Top-k unowned products per customer by cosine (ties: product name).

    cb_score is rounded to 4 dp; ranking uses the unrounded cosine.
    """
    v = with_vector(features)
    arr = _score_array(v)
    top = F.slice(F.sort_array(F.filter(arr, lambda s: ~s["owned"])), 1, k)
    return (v.select("customer_id", F.posexplode(top).alias("pos", "s"))
            .select("customer_id", F.col("s.product_name").alias("product_name"),
                    round_half_up(F.col("s.score"), 4).alias("cb_score")))


# ---------------------------------------------------------------------------
# collaborative stand-in (deterministic, SQL-checkable)
# ---------------------------------------------------------------------------
def segment_popularity_signal(features: DataFrame, affinity: DataFrame, k: int = C.TOP_K, pairs: int | None = None) -> DataFrame:
    """Stand-in for the collaborative signal, used where results must be
    checked exactly: per customer the k products most adopted in its segment
    (ties: product name), score = adopters / segment size rounded to 4 dp.
    Like ALS output it does not exclude owned products.  Lists of segments reach
    the customers as rates do (``with_rates``)."""
    w = Window.partitionBy("segment").orderBy(F.col("customers_with_product").desc(), F.col("product_name"))
    top = (affinity.select("segment", "product_name", "customers_with_product", "total_customers")
           .withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
           .select("segment", "product_name",
                   round_half_up(F.col("customers_with_product") / F.col("total_customers"), 4).alias("als_score")))
    top = top.where(F.col("segment").isNotNull())
    customers = features.select("customer_id", "segment")
    if pairs is not None and pairs <= MOST_RATES:
        lists = top.groupBy("segment").agg(F.collect_list(F.struct("product_name", "als_score")).alias("items"))
        by_segment = lists.select(F.map_from_entries(F.collect_list(F.struct("segment", "items")))).scalar()
        return customers.select("customer_id", F.explode(F.try_element_at(by_segment, F.col("segment"))).alias("item")).select("customer_id", "item.*")
    customers = customers.withColumn("_salt", _salt())
    return customers.join(_salted(top), ["segment", "_salt"]).select("customer_id", "product_name", "als_score")


# ---------------------------------------------------------------------------
# scaling and hybrid blend
# ---------------------------------------------------------------------------
def min_max(df: DataFrame, col: str, out: str) -> DataFrame:
    """Min-max scale ``col`` over the whole frame; a constant column -> 0.
    The bounds are scalar subqueries (merged into one global aggregate)."""
    lo = df.select(F.min(col)).scalar()
    hi = df.select(F.max(col)).scalar()
    return df.withColumn(out, scaled(F.col(col), lo, hi))


def scaled(x: Column, lo: Column, hi: Column) -> Column:
    return F.coalesce((x - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0))


def merge_signals(als: DataFrame, cb: DataFrame) -> DataFrame:
    """Outer merge of the two candidate lists on (customer, product), one row
    per pair with the raw scores (NULL where a list lacks the pair)."""
    a = als.select("customer_id", "product_name", F.col("als_score").cast("double").alias("als_score"),
                   F.lit(None).cast("double").alias("cb_score"))
    c = cb.select("customer_id", "product_name", F.lit(None).cast("double").alias("als_score"),
                  F.col("cb_score").cast("double").alias("cb_score"))
    return (a.unionByName(c).repartition("customer_id")
            .groupBy("customer_id", "product_name")
            .agg(F.max("als_score").alias("als_score"), F.max("cb_score").alias("cb_score")))


#: Rates of so many pairs at most are looked up inside the row; more are joined with a salt.
MOST_RATES, RATE_SALTS = 400, 32


def _pair_key(segment: str) -> Column:
    """A (segment, product) pair as one string, NULL if a part is; the length keeps different pairs apart."""
    return F.concat(F.length(segment).cast("string"), F.lit(":"), F.col(segment), F.col("product_name"))


def _salt() -> Column:
    return F.pmod(F.xxhash64("customer_id"), F.lit(RATE_SALTS)).cast("int")


def _salted(few: DataFrame) -> DataFrame:
    return few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(RATE_SALTS - 1))))


def with_rates(rows: DataFrame, affinity: DataFrame, pairs: int | None, segment: str = "segment") -> DataFrame:
    """``rows`` with the ``affinity_rate`` of their (segment, product), NULL where there is none; one row of ``affinity``
    a pair, ``pairs`` of them if their number is known.

    A few segments hold all customers, so a join on the pair would send a third of the rows to one task.  A table of
    proven size is one map in a scalar subquery, read inside the row; else each rate goes to ``RATE_SALTS`` places."""
    rates = affinity.select(F.col("segment").alias(segment), "product_name", F.col("conversion_rate").alias("affinity_rate"))
    if pairs is not None and pairs <= MOST_RATES:
        known = rates.select(_pair_key(segment).alias("key"), "affinity_rate").where(F.col("key").isNotNull())
        by_pair = known.select(F.map_from_entries(F.collect_list(F.struct("key", "affinity_rate")))).scalar()
        return rows.withColumn("affinity_rate", F.try_element_at(by_pair, _pair_key(segment)))
    return rows.withColumn("_salt", _salt()).join(_salted(rates), [segment, "product_name", "_salt"], "left").drop("_salt")


def attach_context(merged: DataFrame, features: DataFrame, affinity: DataFrame, pairs: int | None = None) -> DataFrame:
    """Customer segment and ownership flags (left join on customer_id), then
    the (segment, product) conversion rate, default 0.0."""
    ctx = features.select("customer_id", "segment", *C.FLAG_COLUMNS)
    owned = None
    for name, flag in zip(C.PRODUCT_NAMES, C.FLAG_COLUMNS):
        cond = (F.col("product_name") == name) & (F.col(flag) == 1)
        owned = F.when(cond, F.lit(True)) if owned is None else owned.when(cond, F.lit(True))
    joined = merged.join(ctx, "customer_id", "left")
    return (with_rates(joined, affinity, pairs)
            .withColumn("affinity_score", F.coalesce(F.col("affinity_rate"), F.lit(0.0)))
            .withColumn("is_owned", owned.otherwise(F.lit(False)))
            .drop(*C.FLAG_COLUMNS))


def normalise(ctx: DataFrame) -> DataFrame:
    """ALS and CB scaled over their recommended rows, affinity over all merged
    rows (one aggregate pass); missing signals are 0 after scaling."""
    # one scalar subquery (a single global aggregate, run once and reused)
    # holding all six bounds
    cols = ("als_score", "cb_score", "affinity_score")
    stats = ctx.select(F.struct(*[F.min(c).alias(f"{c}_lo") for c in cols],
                                *[F.max(c).alias(f"{c}_hi") for c in cols])).scalar()
    bounds = {c: (stats.getField(f"{c}_lo"), stats.getField(f"{c}_hi")) for c in cols}
    out = ctx
    for src in ("als_score", "cb_score"):
        lo, hi = bounds[src]
        out = out.withColumn(f"{src}_norm", F.when(F.col(src).isNull(), F.lit(0.0))
                             .otherwise(scaled(F.col(src), lo, hi)))
    lo, hi = bounds["affinity_score"]
    return out.withColumn("affinity_score_norm", scaled(F.col("affinity_score"), lo, hi))


def blend(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "hybrid_score",
        F.lit(C.ALS_WEIGHT) * F.col("als_score_norm")
        + F.lit(C.CB_WEIGHT) * F.col("cb_score_norm")
        + F.lit(C.AFFINITY_WEIGHT) * F.col("affinity_score_norm"))


def hybrid_scores(als: DataFrame, cb: DataFrame, features: DataFrame, affinity: DataFrame, pairs: int | None = None) -> DataFrame:
    """Every candidate (ALS u CB rows) with normalised signals, blend and
    ownership flag -- before the owned filter.  Not cached: the bounds
    subquery and the scoring pass share the candidate exchange in one plan,
    and a cached relation would hide its partitioning from the top-k.
    ``pairs`` is the number of rows of ``affinity``, if known."""
    return blend(normalise(attach_context(merge_signals(als, cb), features, affinity, pairs)))


PUBLISHED = ["customer_id", "product_name", "als_score_norm", "cb_score_norm", "segment",
             "affinity_score", "affinity_score_norm", "hybrid_score"]


def top_k(scored: DataFrame, score: str, k: int = C.TOP_K, name: str = "product_name") -> DataFrame:
    """Per-customer top-k by score desc (score rounded to 10 dp), then name."""
    w = Window.partitionBy("customer_id").orderBy(F.round(F.col(score), SCORE_KEY_DP).desc(), F.col(name))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hybrid_recommendations(als: DataFrame, cb: DataFrame, features: DataFrame, affinity: DataFrame,
                           k: int = C.TOP_K, pairs: int | None = None) -> DataFrame:
    """Final recs: drop owned products, keep the top k per customer."""
    scored = hybrid_scores(als, cb, features, affinity, pairs)
    return top_k(scored.where(~F.col("is_owned")), "hybrid_score", k).select(*PUBLISHED, "rank")


# ---------------------------------------------------------------------------
# collaborative filtering (implicit ALS)
# ---------------------------------------------------------------------------
def dense_index(df: DataFrame, key: str, out: str = "user_id") -> DataFrame:
    """Dense 0-based ids in ``key`` order without a single-partition window.

    Keys are range-partitioned and sorted; each partition's row offset is the
    running total of the partition sizes before it (one row per partition, a
    size bound set by configuration, so it is broadcast).  The ranged keys are
    checkpointed first so both passes see the same partitioning.  Callers write
    the result once (``Models.customer_index``).  Ids are 32-bit, as the
    library's ALS takes no larger ones: beyond 2^31 keys the cast fails.
    """
    ranged = (df.select(key).where(F.col(key).isNotNull()).distinct()
              .repartitionByRange(key).sortWithinPartitions(key)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mono", F.monotonically_increasing_id()))
    from nextbest.session import checkpoint_dir
    checkpoint_dir(ranged.sparkSession)
    ranged = ranged.checkpoint(eager=True)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    offsets = counts.withColumn(
        "_offset",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (ranged.join(F.broadcast(offsets.select("_pid", "_first", "_offset")), "_pid")
            .select(key, (F.col("_offset") + F.col("_mono") - F.col("_first")).cast("int").alias(out)))


def owned_pairs(matrix: DataFrame) -> DataFrame:
    """Wide 0/1 matrix -> long owned pairs with product id and item id."""
    long = (matrix.unpivot("customer_id", C.PRODUCT_NAMES, "product_name", "owned")
            .where(F.col("owned") == 1))
    labels = dims.small(dims.product_labels(matrix.sparkSession).select(
        "product_name", "product_id", F.col("product_ordinal").alias("item_id")))
    return long.join(labels, "product_name").select("customer_id", "product_id", "product_name", "item_id")


def interactions(matrix: DataFrame, customer_index: DataFrame) -> DataFrame:
    """Wide 0/1 matrix -> long owned pairs with dense user/item ids, rating 1."""
    return (owned_pairs(matrix).join(customer_index, "customer_id")
            .select("customer_id", "product_id", "product_name", "user_id", "item_id",
                    F.lit(1.0).cast("float").alias("rating")))


def split_flag(seed: int = C.ALS_SEED, train_percent: int = C.TRAIN_PERCENT) -> Column:
    """Stable train/test assignment from a hash of the pair, independent of
    partitioning (unlike ``randomSplit``)."""
    h = F.md5(F.concat_ws("|", F.col("customer_id"), F.col("product_id"), F.lit(str(seed))))
    bucket = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % 100
    return bucket < train_percent


def fit_als(train: DataFrame, user_blocks: int = 10, item_blocks: int = 10):
    """Implicit ALS of the library.  The blocks seed the factors, so their
    numbers are parameters with fixed defaults and do not follow the cluster."""
    from pyspark.ml.recommendation import ALS

    from nextbest.session import checkpoint_dir
    checkpoint_dir(train.sparkSession)  # ALS cuts its lineage every 10 iterations
    als = ALS(rank=C.ALS_RANK, maxIter=C.ALS_MAX_ITER, regParam=C.ALS_REG_PARAM, implicitPrefs=True,
              userCol="user_id", itemCol="item_id", ratingCol="rating", coldStartStrategy="drop",
              seed=C.ALS_SEED, nonnegative=False, numUserBlocks=user_blocks, numItemBlocks=item_blocks)
    return als.fit(train)


def decode_recommendations(recs: DataFrame, customer_index: DataFrame) -> DataFrame:
    """ALS (user_id, [(item_id, rating)]) -> (customer_id, product_name, als_score 4 dp)."""
    items = dims.small(dims.product_index(recs.sparkSession))
    return (recs.select("user_id", F.posexplode("recommendations").alias("pos", "r"))
            .select("user_id", (F.col("pos") + 1).alias("rank"), F.col("r.item_id").alias("item_id"), F.col("r.rating").alias("rating"))
            .join(items, "item_id")
            .join(customer_index, "user_id")
            .select("customer_id", "product_name", round_half_up(F.col("rating").cast("double"), 4).alias("als_score"), "rank"))


#: Item factors up to this many numbers go into the plan as literals.
MOST_FACTORS = 4096


def item_factors(model) -> dict[int, list[float]] | None:
    """The factors of every item, or None where they are more numbers than ``MOST_FACTORS``."""
    room = MOST_FACTORS // model.rank
    rows = model.itemFactors.limit(room + 1).collect()
    return None if len(rows) > room else {r["id"]: list(r["features"]) for r in sorted(rows, key=lambda r: r["id"])}


def _vector(values) -> Column:
    return F.array(*[F.lit(float(v)).cast("float") for v in values])


def _dot(one: Column, two: Column, kind: str = "float") -> Column:
    return F.aggregate(F.zip_with(one, two, lambda x, y: x.cast(kind) * y.cast(kind)), F.lit(0.0).cast(kind), lambda total, x: total + x)


def als_top_items(model, k: int = C.TOP_K) -> DataFrame:
    """(user_id, recommendations): the k best items of every user, as the library's ``recommendForAllUsers`` gives them.

    With few items their factors are literals: a user's scores are computed inside its row, so users are neither
    shuffled nor paired with blocks of items.  Ties go to the smaller item.  Beyond ``MOST_FACTORS`` the library does it."""
    factors = item_factors(model)
    if factors is None:
        return model.recommendForAllUsers(k)
    scores = F.array(*[F.struct(_dot(F.col("features"), _vector(f)).alias("rating"), F.lit(-i).alias("behind")) for i, f in factors.items()])
    best = F.slice(F.sort_array(scores, asc=False), 1, k)
    return model.userFactors.select(F.col("id").alias("user_id"), F.transform(
        best, lambda s: F.struct((-s["behind"]).cast("int").alias("item_id"), s["rating"].alias("rating"))).alias("recommendations"))


def als_residuals(model, train: DataFrame, reg: float = C.ALS_REG_PARAM, alpha: float = 1.0) -> DataFrame:
    """(user_id, residual): how far each user's factors are from solving the normal equations of the implicit model.

    For a user with the items ``O`` of rating r and all item factors Y, the last half-step of the fit solves
    (Y'Y + sum over O of c y y' + reg |O| I) x = sum over O of (1 + c) y with c = alpha |r|.  The residual is the largest
    component of the difference of both sides.  One aggregate by user gathers its ratings, at most one an item."""
    factors = item_factors(model)
    if factors is None:
        raise ValueError("the check needs the item factors as literals")
    rank = model.rank
    gram = [[sum(f[a] * f[b] for f in factors.values()) for b in range(rank)] for a in range(rank)]
    by_item = F.create_map(*[x for i, f in factors.items() for x in (F.lit(i), F.array(*[F.lit(float(v)) for v in f]))])
    owned = train.where("rating > 0").groupBy("user_id").agg(F.collect_list(F.struct("item_id", F.col("rating").cast("double").alias("rating"))).alias("owned"))
    rows = owned.join(model.userFactors.select(F.col("id").alias("user_id"), F.col("features").cast("array<double>").alias("x")), "user_id")
    rows = rows.withColumn("owned", F.transform("owned", lambda o: F.struct((o["rating"] * alpha).alias("c"), F.element_at(by_item, o["item_id"]).alias("y"))))
    rows = rows.withColumn("owned", F.transform("owned", lambda o: F.struct((o["c"] * _dot(o["y"], F.col("x"), "double") - (1 + o["c"])).alias("weight"), o["y"].alias("y"))))
    def own_part(a: int) -> Column:
        return F.aggregate("owned", F.lit(0.0), lambda total, o: total + o["weight"] * o["y"][a])

    parts = []
    for a in range(rank):
        own = own_part(a)
        whole = _dot(F.array(*[F.lit(float(v)) for v in gram[a]]), F.col("x"), "double")
        parts.append(F.abs(whole + own + F.lit(float(reg)) * F.size("owned") * F.col("x")[a]))
    return rows.select("user_id", F.array_max(F.array(*parts)).alias("residual"))


def als_recommendations(matrix: DataFrame, customer_index: DataFrame, k: int = C.TOP_K,
                        user_blocks: int = 10, item_blocks: int = 10, ranked: bool = False) -> DataFrame:
    """Implicit ALS over owned pairs (train split), top k per trained user, with its ``rank`` if asked for.
    Owned products are not excluded here (the hybrid step does that)."""
    pairs = interactions(matrix, customer_index)
    train = pairs.where(split_flag()).select("user_id", "item_id", "rating").persist(StorageLevel.MEMORY_AND_DISK)
    model = fit_als(train, user_blocks, item_blocks)
    train.unpersist()
    recs = decode_recommendations(als_top_items(model, k), customer_index)
    return recs if ranked else recs.drop("rank")
