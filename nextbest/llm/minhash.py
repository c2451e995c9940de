"""MinHash near-duplicates by a signature-coordinate inverted join.

Documents with the same shingle set form one class; only one representative
of a class goes on.  A representative is posted under each (coordinate,
value) pair of its signature of ``COORDINATES`` minima.  Two sets with a
similarity of ``percent`` / 100 agree in at least ``MATCHES`` coordinates,
but for a chance of about 2e-6 at the threshold itself, far less above it.
So they agree in one of the ``COORDINATES - MATCHES + 1`` coordinates that a
document has ordered by rarity (its prefix): only these short lists are
merged.  The long lists are skipped; the remaining coordinates of a candidate
pair are compared directly, and pairs below ``MATCHES`` go.  What is left is
confirmed on the full shingle sets.

Lists are never expanded into all pairs.  First each list's members are paired
with the list's smallest member, and each document is confirmed against its best
such partner.  Then only lists whose members still lie in several components are
open.  Lists that share members form a family.  In a family, the members outside
its largest component are compared with all others, in blocks of bounded size
inside a task: collisions are counted on the signatures, and what has a partner
above the threshold comes again with its text to be confirmed, best partner
first, until it has joined the other's component.  Only links that join two
components leave a block, never the pairs compared.

Defined results: null or empty texts and texts without words have
``n_shingles`` 0 and link with nothing.  Rows without an id cannot be named in
a group: they come back with a null ``component_id`` and ``kept`` true.
Repeated rows are equal texts; each row comes back.  Rows that share an id but
not the text count as texts of one document.  Columns other than the id and
the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nextbest.llm.common import components, id_and_text, slices, texts_of, written
from nextbest.llm.shingles import mix, overlap, shingle_sets

COORDINATES = 64
MATCHES = 32
_BLOCK = 4096
_SLICE = 1 << 18  # a batch's arrays take some sixty times its text

_rng = np.random.default_rng(8)
_ODD = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each coordinate's hash over a set, as unsigned 32-bit values."""
    least = np.full(COORDINATES, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(hashes), _BLOCK):
        block = (hashes[i : i + _BLOCK, None] ^ _FLIP[None, :]) * _ODD[None, :]
        np.minimum(least, block.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()),
                     ("sig", pa.list_(pa.int32()))])


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", _SLICE):
                sets = shingle_sets(texts_of(batch.column("text")), words)
                sizes = [len(s) for s in sets]
                fp1 = [int(mix(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                fp2 = [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                signs = np.concatenate([signature(s) for s in sets]).view(np.int32)
                lists = pa.ListArray.from_arrays(np.arange(0, len(signs) + 1, COORDINATES, dtype=np.int32), pa.array(signs))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), lists],
                    schema=_SIGNED)
    return run


def signed(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, fp1, fp2, sig): set size, set fingerprint and signature of whole texts."""
    return docs.mapInArrow(_sign(words), "doc_id long, n_shingles long, fp1 long, fp2 long, sig array<int>")


def _matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = (np.asarray(batch.column(c).flatten()).reshape(-1, COORDINATES) for c in ("sig_a", "sig_b"))
        hits = (one == two).sum(axis=1)
        keep = np.flatnonzero(hits >= MATCHES)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep)), pa.array(hits[keep], pa.int32())],
            names=["a", "b", "hits"])


def _confirm(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, np.zeros(0, np.uint64)
        for whole in batches:
            for batch in slices(whole, "text_b", _SLICE):
                a = batch.column("a").to_pylist()
                yes = []
                for i, other in enumerate(shingle_sets(texts_of(batch.column("text_b")), words)):
                    if a[i] != last:
                        last, one = a[i], shingle_sets(texts_of(batch.column("text_a").slice(i, 1)), words)[0]
                    both = overlap(one, other)
                    yes.append(100 * both >= percent * (len(one) + len(other) - both))
                mask = pa.array(yes, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])
    return run


def _agreeing(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b, hits) whose sizes allow the threshold and whose signatures agree often enough."""
    one = reps.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sig").alias("sig_a"))
    two = reps.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sig").alias("sig_b"))
    sized = pairs.join(two, "b").join(one, "a").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "sig_a", "sig_b").mapInArrow(_matching, "a long, b long, hits int")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    joined = pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(_confirm(words, percent), "a long, b long")


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The complete groups of frames that are sorted by ``keys``."""
    rest: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        values = frame[keys].to_numpy()
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        if rest and (rest[-1][keys].to_numpy()[-1] != values[0]).any():
            yield pd.concat(rest) if len(rest) > 1 else rest[0]
            rest = []
        for at, end in zip([0, *cuts], [*cuts, len(frame)], strict=True):
            if rest and at:
                yield pd.concat(rest) if len(rest) > 1 else rest[0]
                rest = []
            rest.append(frame.iloc[at:end])
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


_PAIR = ["family", "i", "j"]


def _sides(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the members outside the largest component, and of those they are compared with."""
    block = group["block"].to_numpy()
    return np.flatnonzero(block == group["i"].iloc[0]), np.flatnonzero(block == group["j"].iloc[0])


def _partners(group: pd.DataFrame, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each member of the first block: the members of the second one in another component that agree often enough,
    and in how many coordinates."""
    left, right = _sides(group)
    sigs = np.stack(group["sig"].to_numpy())
    size, component = group["n_shingles"].to_numpy(), group["component"].to_numpy()
    theirs, sizes, components_ = sigs[right], size[right], component[right]
    for x in left:
        hits = (theirs == sigs[x]).sum(axis=1)
        ok = np.flatnonzero((hits >= MATCHES) & (components_ != component[x])
                            & (100 * np.minimum(sizes, size[x]) >= percent * np.maximum(sizes, size[x])))
        if len(ok):
            yield int(x), right[ok], hits[ok]


def _near_members(percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(frames, _PAIR):
            found = [np.append(others, x) for x, others, _ in _partners(group, percent)]
            if found:
                yield pd.DataFrame({"rep": group["rep"].to_numpy()[np.unique(np.concatenate(found))]})
    return run


def _joining_links(words: int, percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(frames, _PAIR):
            rep, component = group["rep"].to_numpy(), group["component"].to_numpy()
            texts = group["text"].tolist()
            sets: dict[int, np.ndarray] = {}
            root = {c: c for c in component.tolist()}

            def find(c):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            def shingles(x):
                if x not in sets:
                    sets[x] = shingle_sets([(texts[x] or "").encode()], words)[0]
                return sets[x]

            links = []
            for x, others, hits in _partners(group, percent):
                for y in others[np.argsort(-hits, kind="stable")].tolist():
                    if find(component[x]) == find(component[y]):
                        continue
                    one, two = shingles(x), shingles(y)
                    both = overlap(one, two)
                    if 100 * both >= percent * (len(one) + len(two) - both):
                        links.append((rep[x], rep[y]))
                        root[find(component[x])] = find(component[y])
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])
    return run


#: A block of a family holds about so many members, with so many shingles in all.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 2_000_000


def _open_links(prefix: DataFrame, labels: DataFrame, reps: DataFrame, base: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between members of lists that still lie in several components; enough of them to join all that are linked."""
    placed = prefix.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = written(placed, "minhash-placed")
    spans = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("rep").alias("head"))
    open_lists = written(placed.join(spans.where("low <> high").select("key", "head"), "key").select("head", "rep", "component"), "minhash-open")
    families = components(open_lists.where("head <> rep").select(F.col("head").alias("a"), F.col("rep").alias("b")), "minhash-families")
    members = families.select(F.col("node").alias("rep"), F.col("component").alias("family")).join(
        open_lists.select("rep", "component").distinct(), "rep").join(reps, "rep")
    members = written(members, "minhash-members")

    parts = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    whole = parts.groupBy("family").agg(F.max(F.struct("n", "component", "w")).alias("m"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    whole = whole.select("family", F.col("m.component").alias("main"), F.struct((F.col("n") - F.col("m.n")).alias("n"), (F.col("w") - F.col("m.w")).alias("w")).alias("rest"), "m")
    def of(part: str):
        return F.ceil(F.greatest(F.col(f"{part}.n") / BLOCK_MEMBERS, F.col(f"{part}.w") / BLOCK_SHINGLES)).cast("int")
    whole = whole.select("family", "main", of("rest").alias("outer"), of("m").alias("inner"))
    placed = members.join(whole, "family").withColumn("block", F.when(
        F.col("component") == F.col("main"), F.col("outer") + F.pmod(F.xxhash64("rep"), F.col("inner"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("outer"))).cast("int"))
    with_ = F.sequence(F.lit(0), F.when(F.col("block") < F.col("outer"), F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1)
    pairs = F.transform(with_, lambda t: F.struct(F.least("block", t).alias("i"), F.greatest("block", t).alias("j")))
    work = placed.withColumn("x", F.explode(pairs)).select("family", "x.i", "x.j", "block", "rep", "component", "n_shingles", "sig")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(*_PAIR).sortWithinPartitions(*_PAIR)

    near = written(dealt(work).mapInPandas(_near_members(percent), "rep long").distinct(), "minhash-near")
    texts = base.select(F.col("doc_id").alias("rep"), "text").join(near, "rep", "left_semi")
    return dealt(work.join(texts, "rep")).mapInPandas(_joining_links(words, percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of ``docs``."""
    base = id_and_text(docs, id_col, text_col)
    sets = written(signed(base, words), "minhash-sets")
    named = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(named.groupBy("fp1", "fp2", "n_shingles").agg(F.min(F.struct("doc_id", "sig")).alias("x")).select(
        "fp1", "fp2", "n_shingles", F.col("x.doc_id").alias("rep"), F.col("x.sig").alias("sig")), "minhash-classes")
    reps = classes.select("rep", "n_shingles", "sig")

    postings = reps.select("rep", F.posexplode("sig").alias("coordinate", "value")).select(
        "rep", F.shiftleft(F.col("coordinate").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    listed = postings.join(shared, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("members", "key"))).alias("lists"))
    # coordinates that no other document has come first in the order of rarity
    room = F.lit(COORDINATES - MATCHES + 1) - (F.lit(COORDINATES) - F.size("lists"))
    prefix = listed.where(room > 0).select("rep", F.explode(F.slice("lists", F.lit(1), room)).alias("x")).select("rep", F.col("x.key").alias("key"))
    prefix = written(prefix, "minhash-prefix")

    heads = prefix.groupBy("key").agg(F.min("rep").alias("a"))
    stars = prefix.join(heads, "key").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    near = written(_agreeing(stars, reps, percent), "minhash-stars")
    best = near.groupBy("b").agg(F.max_by("a", F.struct("hits", -F.col("a"))).alias("a")).select("a", "b")
    first = written(_confirmed(best, _texts_of_pairs(base, best), words, percent), "minhash-links")

    labels = components(first, "minhash-first")
    second = written(_open_links(prefix, labels, reps, base, words, percent), "minhash-links")

    final = components(first.unionByName(second), "minhash-final")
    named_classes = classes.select("fp1", "fp2", "n_shingles", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "fp1", "fp2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    rows = sets.drop("sig").join(named_classes, ["fp1", "fp2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _texts_of_pairs(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts that the pairs name."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return texts.join(ids, "doc_id", "left_semi")
