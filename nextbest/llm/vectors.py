"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Equal vectors form one class.  Class representatives are scaled to length 1 and
quantised to int8 with a scale of their own; x = s q + e, and the length of e is kept.
For two of them |x.y - s_x s_y q_x.q_y| <= |s_x q_x| |e_y| + |e_x|, so a tile product of
the integers (exact in float32, as its sums stay below 2^24) tells which pairs
certainly reach the threshold, which certainly do not, and which few have to be
computed again in double precision.

Representatives lie in tiles of ``tile`` vectors around pivots (a bounded
sample); two tiles whose angle less their radii exceeds the threshold's angle
are never multiplied, and are not sent to each other where their pivots tell.
The pairs of tiles are dealt as squares of some tiles by some tiles, a square
one task's work, so a tile travels once for a side of a square, as the
components it came with.  A pair of tiles hands back a number of links for each
vector and a spanning forest of the links, never the pairs themselves.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; so do vectors of different lengths.  Rows with a
null id come back with a null component and ``kept`` true, and are not counted
by others.  Repeated rows are equal vectors and link.  Only the id and the
vector are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nextbest.llm.common import components, written

TILE = 4096
#: Vectors that tiles gather around, at most; they decide which products can be skipped, never the result.
MOST_PIVOTS = 1024
#: Bytes of vectors on one side of a square of tile pairs, at most (one tile always), and sides that are aimed at.
SIDE_BYTES, SIDES = 32 << 20, 4
_ROWS = 512
_EXACT = 1 << 16


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale and length of the rest for rows of length 1."""
    scale = np.maximum(np.abs(unit).max(axis=1), 1e-30) / 127.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(unit - q * scale[:, None], axis=1)


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of a, j of b) with a cosine of at least ``threshold``, by blocks of rows of a; i < j if ``same``.

    a, b: rows of length 1 in double precision."""
    qa, sa, ea = quantised(a)
    qb, sb, eb = quantised(b)
    la, lb = np.linalg.norm(qa * sa[:, None], axis=1), np.linalg.norm(qb * sb[:, None], axis=1)
    columns = max(1, (1 << 24) // (127 * 127))  # integer sums this long are exact in float32
    fb = qb.astype(np.float32)
    for at in range(0, len(a), _ROWS):
        rows = slice(at, min(at + _ROWS, len(a)))
        product = np.zeros((rows.stop - at, len(b)))
        for c in range(0, a.shape[1], columns):
            product += qa[rows, c : c + columns].astype(np.float32) @ fb[:, c : c + columns].T
        product *= sa[rows, None] * sb[None, :]
        bound = la[rows, None] * eb[None, :] + ea[rows, None] + 1e-9
        i, j = np.nonzero(product + bound >= threshold)
        if same:
            keep = i + at < j
            i, j = i[keep], j[keep]
        sure = product[i, j] - bound[i, j] >= threshold
        unsure = np.flatnonzero(~sure)
        for k in range(0, len(unsure), _EXACT):
            part = unsure[k : k + _EXACT]
            sure[part] = np.einsum("ij,ij->i", a[i[part] + at], b[j[part]]) >= threshold
        yield i[sure] + at, j[sure]


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else the squares of tiny or huge components are lost
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pack(frame: pd.DataFrame) -> np.ndarray:
    return _units(np.stack(frame["embedding"].to_numpy())) if len(frame) else np.zeros((0, 1))


def _products(threshold: float, side: int, component: str):
    angle = math.acos(min(1.0, threshold)) + 1e-6

    def block(key: tuple[int, int], rows: list) -> Iterator[pd.DataFrame]:
        tiles = []
        for row in rows:
            ids = np.frombuffer(row.ids, dtype=np.int64)
            unit = _units(np.frombuffer(row.vectors, dtype=component).reshape(len(ids), -1))
            tiles.append((row.tile, ids, np.frombuffer(row.counts, dtype=np.int64), unit, np.asarray(row.middle), row.radius))
        for one in tiles:
            for two in tiles:
                if (one[0] // side, two[0] // side) == key and one[0] <= two[0]:
                    if one is two or math.acos(float(np.clip(one[4] @ two[4], -1, 1))) - one[5] - two[5] <= angle:
                        yield _linked(one[:4], two[:4], threshold, one is two)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = None, []  # the tiles of one block of pairs: at most two sides of the square
        for frame in frames:
            for row in frame.itertuples(index=False):
                if (row.i, row.j) != held:
                    yield from block(held, rows)
                    held, rows = (row.i, row.j), []
                rows.append(row)
        yield from block(held, rows)

    return run


def _linked(one, two, threshold: float, same: bool) -> pd.DataFrame:
    (_, ids_a, n_a, a), (_, ids_b, n_b, b) = one, two
    more_a, more_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    shift = 0 if same else len(ids_a)

    def counted():
        for i, j in tile_links(a, b, threshold, same):
            more_a[:] += np.bincount(i, n_b[j], minlength=len(ids_a)).astype(np.int64)
            more_b[:] += np.bincount(j, n_a[i], minlength=len(ids_b)).astype(np.int64)
            yield i, j + shift

    label = _labels(len(ids_a) + (0 if same else len(ids_b)), counted())
    ids = ids_a if same else np.concatenate([ids_a, ids_b])
    links = more_a + more_b if same else np.concatenate([more_a, more_b])
    some = links > 0
    return pd.DataFrame({"rep": ids[some], "links": links[some], "root": ids[label][some]})


def _labels(n: int, links) -> np.ndarray:
    """A component label for each of n nodes; each block of links is used once and let go."""
    label = np.arange(n)
    for i, j in links:
        while len(i):
            one, two = label[i], label[j]
            differ = one != two
            i, j, one, two = i[differ], j[differ], one[differ], two[differ]
            if not len(i):
                break
            np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
            while (label != label[label]).any():
                label = label[label]
    return label


def _pivots(reps: DataFrame, n: int) -> np.ndarray:
    """Unit vectors that tiles gather around: those with the smallest hash, at most ``MOST_PIVOTS``."""
    some = reps.orderBy(F.xxhash64("rep")).limit(n).select("embedding").toPandas()
    return _pack(some)


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors``."""
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    fine = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    keyed = written(base.withColumn("key", F.when(fine, F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: (x + F.lit(0.0)).cast("string"))), 256))), "vectors")
    reps = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    reps = written(reps, "vector-classes")
    sizes = [(r["d"], r["c"]) for r in reps.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("c")).collect()]
    kind = vectors.schema[vector_col].dataType.simpleString()
    component = "float32" if kind == "array<float>" else "float64"  # what holds the components exactly
    parts = [_links(reps.where(F.size("embedding") == d), c, d, threshold, tile, component) for d, c in sorted(sizes)]
    if parts:
        links = parts[0]
        for p in parts[1:]:
            links = links.unionByName(p)
        links = written(links, "vector-links")
        counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
        named = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vector-components")
        classes = reps.select("key", "rep", "n").join(counts, "rep", "left").join(named.withColumnRenamed("node", "rep"), "rep", "left")
    else:
        classes = reps.select("key", "rep", "n", F.lit(None).cast("long").alias("links"), F.lit(None).cast("long").alias("component"))
    classes = classes.select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rows = keyed.select("vec_id", "key").join(classes, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                       F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links(reps: DataFrame, n: int, width: int, threshold: float, tile: int, component: str) -> DataFrame:
    """(rep, links, root): numbers of links and forest edges of all pairs of tiles of one vector length."""
    spark = reps.sparkSession
    tiles = -(-n // tile)
    pivots = _pivots(reps, min(MOST_PIVOTS, tiles))
    known = spark.sparkContext.broadcast(pivots)

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                cosine = _pack(frame) @ known.value.T
                yield pd.DataFrame({"rep": frame["rep"], "n": frame["n"], "embedding": frame["embedding"], "cell": cosine.argmax(axis=1), "cosine": cosine.max(axis=1)})

    celled = written(reps.select("rep", "n", "embedding").mapInPandas(nearest, "rep long, n long, embedding array<double>, cell long, cosine double"), "vector-cells")
    # a row for each pivot
    cells = sorted((r["cell"], -(-r["c"] // tile), r["far"]) for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("c"), F.min("cosine").alias("far")).collect())
    if not cells:
        return spark.createDataFrame([], "rep long, links long, root long")
    number = np.array([c for c, _, _ in cells])
    last = np.cumsum([parts for _, parts, _ in cells])
    first, total = np.concatenate([[0], last[:-1]]), int(last[-1])
    side = max(1, min(SIDE_BYTES // (tile * width * 8), -(-total // SIDES)))
    radius = np.arccos(np.clip([far for _, _, far in cells], -1, 1))
    angle = math.acos(min(1.0, threshold)) + 1e-6
    apart = np.arccos(np.clip(pivots[number] @ pivots[number].T, -1, 1)) - radius[:, None] - radius[None, :]
    near = spark.sparkContext.broadcast((number, first // side, (last - 1) // side, apart <= angle))  # rows and columns for the pivots
    plan = spark.createDataFrame([(int(c), int(f), int(parts)) for (c, parts, _), f in zip(cells, first, strict=True)], "cell long, first long, parts long")
    placed = celled.join(F.broadcast(plan), "cell").withColumn("tile", F.col("first") + F.pmod(F.xxhash64("rep", F.lit(5)), F.col("parts")))

    def bundle(key, frame: pd.DataFrame) -> pd.DataFrame:
        """A tile, its middle and radius, and the stretches of tiles that may hold partners of its vectors."""
        unit = _pack(frame)
        middle = unit.mean(axis=0)
        middle = middle / max(np.linalg.norm(middle), 1e-30)
        number, low, high, met = near.value
        row = int(np.searchsorted(number, frame["cell"].iloc[0]))
        sides = np.unique(np.concatenate([[int(key[0]) // side], *[np.arange(low[c], high[c] + 1) for c in np.flatnonzero(met[row])]]))
        return pd.DataFrame({"tile": [int(key[0])], "ids": [frame["rep"].to_numpy(np.int64).tobytes()], "counts": [frame["n"].to_numpy(np.int64).tobytes()],
                             "vectors": [np.stack(frame["embedding"].to_numpy()).astype(component).tobytes()], "middle": [middle.tolist()],
                             "radius": [float(np.arccos(np.clip((unit @ middle).min(), -1, 1)))], "sides": [sides.tolist()]})

    bundles = written(placed.groupBy("tile").applyInPandas(
        bundle, "tile long, ids binary, counts binary, vectors binary, middle array<double>, radius double, sides array<long>"), "vector-tiles")
    # pairs of tiles are dealt as squares: a tile goes once to each stretch of tiles, not to each tile
    own = F.expr(f"tile div {side}")
    work = bundles.select("tile", "ids", "counts", "vectors", "middle", "radius", F.explode("sides").alias("other"))
    work = work.withColumn("i", F.least(own, "other")).withColumn("j", F.greatest(own, "other")).drop("other")
    squares = -(-total // side)
    number_of = max(1, min(squares * (squares + 1) // 2, 4 * spark.sparkContext.defaultParallelism + total))
    dealt = work.repartition(number_of, "i", "j").sortWithinPartitions("i", "j", "tile")
    return dealt.mapInPandas(_products(threshold, side, component), "rep long, links long, root long")
