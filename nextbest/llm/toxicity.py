"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a run of letters, digits and non-ASCII bytes, A-Z folded.  Its
subwords are its character n-grams of 3 to 5 bytes, boundary marks included, and
the word itself; each falls into one of ``BUCKETS`` embeddings.  A word is the
mean of its subwords, a text ``SCALE`` times the mean of its words, and a linear softmax over
that gives the two classes.  A misspelling that was never seen shares most of its
n-grams with the word it stands for.

Embeddings and softmax are trained together by gradient descent on at most
``MOST_LABELLED`` labelled documents of the table (those with the smallest hash of the id),
in one task: tasks turn their texts into bags of distinct words, one task learns from these bags, and
only the model (``BUCKETS`` x ``DIMENSIONS`` numbers) reaches the driver.  The class score is linear in the averaged embeddings, so
scoring needs one number for each bucket; whole texts are scored where they lie,
with prefix sums instead of a loop over words.  A very long text adds its distinct words to that task, some 30 bytes each.

Defined results: a null or empty text, or one without words, gets the score of
the bias alone; without labels of both classes every score is (all but) 0.  Rows with
null or repeated ids come back one for one; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nextbest.llm.common import id_and_text, slices, texts_of, written
from nextbest.llm.shingles import LOWER, mix, powers, shingle_sets

BUCKETS_LOG2 = 17
BUCKETS = 1 << BUCKETS_LOG2
GRAMS = (3, 4, 5)
DIMENSIONS = 8
MOST_LABELLED = 12_000
LEAST_TEXTS = 2
CLASS_WEIGHT = 1.5
STEPS = 60
RATE = 1.0
#: Shares of the largest first gradient by which embeddings are shortened, and steps without gain to wait.
SPARSITY = (0.3, 0.15, 0.08)
PATIENCE = 12
SCALE = 30.0
#: MinHash coordinates by which near copies are left out of the training rows, and how many of them agree in one.
COORDINATES, MATCHES = 32, 20
_SLICE = 1 << 17

_FOLD = LOWER.copy()
for _c in range(128):
    if not chr(_c).isalnum():
        _FOLD[_c] = 0x20
_VALUE = np.random.default_rng(6).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Model:
    embeddings: np.ndarray  # buckets x dimensions
    softmax: np.ndarray  # 2 x dimensions
    bias: np.ndarray  # 2

    def margins(self) -> np.ndarray:
        """Of each bucket: what it adds to the difference of the two classes' scores."""
        return self.embeddings @ (self.softmax[1] - self.softmax[0])


@dataclass
class Words:
    """Words of many texts and the hashes of their subwords' bytes."""

    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray  # of each text, one more entry than texts
    sums: np.ndarray
    down: np.ndarray

    def grams(self, n: int) -> np.ndarray:
        """The bucket of the n bytes from each position."""
        size = len(self.sums) - n
        return self._bucket((self.sums[n:] - self.sums[:size]) * self.down[:size], n)

    def whole(self) -> np.ndarray:
        return self._bucket((self.sums[self.stop] - self.sums[self.start]) * self.down[self.start], 99)

    def keys(self) -> np.ndarray:
        return mix((self.sums[self.stop] - self.sums[self.start]) * self.down[self.start])

    @staticmethod
    def _bucket(hashes: np.ndarray, salt: int) -> np.ndarray:
        return (mix(hashes + np.uint64(salt)) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)


def words_of(texts: list[bytes]) -> Words:
    # behind the last word stands room for the longest n-gram from the mark before it
    data = _FOLD[np.frombuffer(b" " + b" ".join(texts) + b" " * (1 + max(GRAMS)), dtype=np.uint8)]
    edge = np.diff((data != 0x20).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return Words(start, stop, np.concatenate([[0], np.searchsorted(start, ends)]), sums, down)


def scores(texts: list[bytes], margins: np.ndarray, bias: float) -> np.ndarray:
    """The probability of class 1 for each text."""
    words = words_of(texts)
    total, number = margins[words.whole()], np.ones(len(words.start))
    for n in GRAMS:
        run = np.concatenate([[0.0], np.cumsum(margins[words.grams(n)])])
        # the word with its two boundary marks
        low, high = words.start - 1, words.stop + 2 - n
        some = high > low
        total = total + np.where(some, run[np.maximum(high, low)] - run[low], 0.0)
        number = number + np.where(some, high - low, 0)
    each = np.concatenate([[0.0], np.cumsum(total / number)])
    count = np.diff(words.first)
    mean = (each[words.first[1:]] - each[words.first[:-1]]) / np.maximum(count, 1)
    return 1.0 / (1.0 + np.exp(-np.clip(SCALE * mean + bias, -500, 500)))


def train(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 1) -> Model:
    """A model from whole texts."""
    return learn(bags_of(texts), labels, steps, seed)


def learn(bags: Bags, labels: np.ndarray, steps: int = STEPS, seed: int = 1) -> Model:
    """Embeddings and softmax, jointly by gradient descent on all rows; a step that raises the loss is halved, the next
    one after a good step is longer.  Each step shortens every embedding by the same amount, down to zero: what does not
    divide the classes clearly, as the words of single texts, stays at zero.  The amounts in ``SPARSITY`` are tried.

    One text of five is not learned from but tells when to stop: they also choose between the amounts.  Words in fewer texts than ``LEAST_TEXTS`` are not
    learned from.  A row of class 1 weighs ``CLASS_WEIGHT``
    rows."""
    rng = np.random.default_rng(seed)
    table = np.zeros((BUCKETS, DIMENSIONS), dtype=np.float32)  # what no text moves adds nothing
    softmax = rng.normal(0, DIMENSIONS**-0.5, (2, DIMENSIONS)).astype(np.float32)
    labels = np.asarray(labels, dtype=np.float64)
    if not len(labels) or labels.min() == labels.max():
        return Model(table, np.zeros_like(softmax), np.array([500.0, -500.0]))
    weight = np.where(labels > 0, CLASS_WEIGHT, 1.0) / len(labels)
    bias = np.log([(weight * (1 - labels)).sum(), (weight * labels).sum()]).astype(np.float32)
    learns = rng.random(len(labels)) >= 0.2
    (row, column, share), (word, bucket, part), n = bags.words, bags.subwords, bags.n  # texts x words, words x subwords
    share = SCALE * share
    occurs = np.bincount(bucket, minlength=BUCKETS) > 0
    used, bucket = np.flatnonzero(occurs), (np.cumsum(occurs, dtype=np.int32) - 1)[bucket]  # only buckets that occur move
    # a bucket's root mean square in a text, so that the descent sees frequent and rare subwords alike
    square = np.bincount(bucket, part * part * np.bincount(column, share * share, minlength=n)[word], minlength=len(used))
    size = np.sqrt(square / max(len(labels), 1)) + 1e-12
    part = part / size[bucket]
    moved = table[used]

    def forward(moved, softmax, bias):
        margin = moved @ (softmax[1] - softmax[0])
        by_word = np.bincount(word, part * margin[bucket], minlength=n)
        text = np.bincount(row, share * by_word[column], minlength=len(labels)) + bias[1] - bias[0]
        p = 1.0 / (1.0 + np.exp(-np.clip(text, -500, 500)))
        loss = weight * -np.log(np.maximum(np.where(labels > 0, p, 1 - p), 1e-9))
        return p, loss[learns].sum(), loss[~learns].sum()

    length = np.linalg.norm(softmax[1] - softmax[0])
    fitted = []
    for sparsity in SPARSITY:
        best = (np.inf, [moved, softmax, bias])
        values, penalty, active = [moved, softmax, bias], None, 1.0
        for refit in (False, True):
            rate, waited = RATE, 0
            if refit:  # what has stayed off zero is fitted again without the shortening
                penalty, active = 0.0, (np.abs(values[0]).max(axis=1, keepdims=True) > 0).astype(np.float32)
            p, now, aside = forward(*values)
            now += (penalty or 0.0) * float(np.linalg.norm(values[0], axis=1).sum())
            for _ in range(steps):
                off = np.where(learns, (p - labels) * weight, 0.0)
                back = np.bincount(column, share * off[row], minlength=n)
                back = np.bincount(bucket, part * back[word], minlength=len(used))
                penalty = sparsity * np.abs(back).max() * length if penalty is None else penalty
                mean = back @ values[0]
                grads = (np.outer(back, values[1][1] - values[1][0]) * active, np.stack([-mean, mean]), np.array([-off.sum(), off.sum()]))
                while rate > 1e-9:
                    table_, softmax_, bias_ = (v - rate * g for v, g in zip(values, grads, strict=True))
                    norms = np.linalg.norm(table_, axis=1, keepdims=True)
                    table_ *= np.maximum(0.0, 1 - rate * penalty / np.maximum(norms, 1e-12))
                    softmax_ *= length / max(np.linalg.norm(softmax_[1] - softmax_[0]), 1e-12)
                    trial = [x.astype(np.float32) for x in (table_, softmax_, bias_)]
                    p_new, after, aside = forward(*trial)
                    after += penalty * float(np.linalg.norm(trial[0], axis=1).sum())
                    if after < now:
                        break
                    rate /= 2
                else:
                    break
                values, p, now, rate = trial, p_new, after, rate * 1.5
                waited += 1
                if aside < best[0]:
                    best, waited = (aside, values), 0
                if waited > PATIENCE:
                    break
        fitted.append(best)
    # of models about as good, the one with the most subwords, for the sake of misspellings
    least = min(x[0] for x in fitted)
    moved, softmax, bias = [x[1] for x in fitted if x[0] <= 1.1 * least + 0.01 * weight[~learns].sum()][-1]
    table[used] = moved / size[:, None]
    return Model(table, softmax, bias)


def minima(hashes: np.ndarray) -> list[int]:
    """MinHash coordinates of a set of shingles; none of an empty one."""
    return [int(mix(hashes ^ np.uint64(k + 1)).min()) for k in range(COORDINATES)] if len(hashes) else []


def unlike(signatures: list) -> list[int]:
    """Texts to learn from, by their ``minima``: of near copies only the first, else a large group of copies would teach its
    own words as signs of its label.  A text goes if ``MATCHES`` of the ``COORDINATES`` agree with one text that stays: at a
    similarity of 0.75 with a chance of 0.96, at 0.5 of 0.11, at 0.3 of 1e-4."""
    kept = np.zeros((len(signatures), COORDINATES), dtype=np.uint64)
    keep: list[int] = []
    for i, least in enumerate(signatures):
        if not len(least):
            continue
        one = np.array(least, dtype=np.uint64)
        if not ((kept[: len(keep)] == one).sum(axis=1) >= MATCHES).any():
            kept[len(keep)] = one
            keep.append(i)
    return keep


@dataclass
class Bags:
    """Texts x common words and common words x subwords, as (row, column, weight) lists; the number of common words."""

    words: tuple[np.ndarray, np.ndarray, np.ndarray]
    subwords: tuple[np.ndarray, np.ndarray, np.ndarray]
    n: int


def counted(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Of each text: its distinct words' keys, their shares of its words, and the folded words."""
    for text in texts:
        words = words_of([text])
        key, first, count = np.unique(words.keys(), return_index=True, return_counts=True)
        data = _FOLD[np.frombuffer(b" " + text + b" ", dtype=np.uint8)].tobytes()
        yield key, (count / max(len(words.start), 1)).astype(np.float32), [data[a:b] for a, b in zip(words.start[first], words.stop[first], strict=True)]


def bags_of(texts: list[bytes]) -> Bags:
    rows, keys, shares, spelled = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)], {}
    for i, (key, share, words) in enumerate(counted(texts)):
        rows.append(np.full(len(key), i, np.int32))
        keys.append(key)
        shares.append(share)
        spelled.update(zip(key.tolist(), words, strict=True))
    keys = np.concatenate(keys)
    known, count = np.unique(keys, return_counts=True)
    known = known[count >= LEAST_TEXTS]
    use = np.isin(keys, known)
    return joined(np.concatenate(rows)[use], keys[use], np.concatenate(shares)[use], known, [spelled[k] for k in known.tolist()])


def joined(rows: np.ndarray, keys: np.ndarray, shares: np.ndarray, known: np.ndarray, spelled: list[bytes]) -> Bags:
    """Bags of the words ``known``, which are sorted by key."""
    words = words_of(spelled)
    low, high = words.start - 1, words.stop
    number = np.arange(len(low), dtype=np.int32)
    buckets, owners = [words.whole().astype(np.int32)], [number]
    for n in GRAMS:
        grams, count = words.grams(n).astype(np.int32), np.maximum(high + 2 - n - low, 0)
        owners.append(np.repeat(number, count))
        at = np.repeat(low - (np.cumsum(count) - count), count)
        at += np.arange(len(at))
        buckets.append(grams[at])
        del at
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    del owners, buckets
    weight = (1.0 / np.maximum(np.bincount(owner, minlength=len(low)), 1)).astype(np.float32)[owner]
    return Bags((rows, np.searchsorted(known, keys).astype(np.int32), shares), (owner, bucket, weight), len(known))


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id's text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


_BAGS = "doc_id long, toxic int, least array<long>, keys array<long>, shares array<float>, words array<string>"


def _bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", _SLICE):
            texts = texts_of(batch.column("text"))
            least = [np.array(minima(h), np.uint64).view(np.int64) for h in shingle_sets(texts)]
            keys, shares, words = zip(*counted(texts), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), pa.array(least, pa.list_(pa.int64())), pa.array([k.view(np.int64) for k in keys], pa.list_(pa.int64())),
                 pa.array(shares, pa.list_(pa.float32())), pa.array([[w.decode() for w in ws] for ws in words], pa.list_(pa.string()))],
                names=["doc_id", "toxic", "least", "keys", "shares", "words"])


def labelled_bags(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bags of words of the labelled rows of ``docs`` that are not held out, at most ``most_rows``; of repeated ids, one row."""
    rows = id_and_text(docs, id_col, text_col)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    some = marked.where(~held_out()).join(rows.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(
        F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(most_rows)
    one = rows.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return written(one.mapInArrow(_bag, _BAGS), "toxicity-bags")


def gathered(bags: pa.Table) -> tuple[Bags, np.ndarray]:
    """Bags of the common words and labels of the rows to learn from, in the order of their ids."""
    ids = np.asarray(bags.column("doc_id"))
    order = np.argsort(ids)
    least = [np.asarray(x.values).view(np.uint64) for x in bags.column("least").take(pa.array(order))]
    chosen = order[unlike(least)]
    toxic = np.asarray(bags.column("toxic"))[chosen]
    length = np.asarray(pc.list_value_length(bags.column("keys")))
    size = length[chosen]
    # where the words of the rows lie, in the rows' order: the lists themselves are not copied into that order
    place = np.repeat((np.cumsum(length) - length)[chosen] - (np.cumsum(size) - size), size)
    place += np.arange(len(place))
    keys, shares = (np.asarray(pc.list_flatten(bags.column(c)))[place] for c in ("keys", "shares"))
    keys = keys.view(np.uint64)
    known, first, count = np.unique(keys, return_index=True, return_counts=True)
    common = count >= LEAST_TEXTS
    spelled = pc.list_flatten(bags.column("words")).take(pa.array(place[first[common]])).cast(pa.binary()).to_pylist()
    known = known[common]
    del bags, least, first, count, common, place
    if len(known):
        at = np.searchsorted(known, keys)
        use = known[np.minimum(at, len(known) - 1, out=at)] == keys
        del at
    else:
        use = np.zeros(len(keys), bool)
    row, keys, shares = np.repeat(np.arange(len(size), dtype=np.int32), size)[use], keys[use], shares[use]
    return joined(row, keys, shares, known, spelled), toxic


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        bags = [pa.Table.from_batches(held)]
        held.clear()
        model = learn(*gathered(bags.pop()))
        parts = (model.embeddings.astype("<f4"), model.softmax.astype("<f4"), model.bias.astype("<f8"))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["embeddings", "softmax", "bias"])


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled rows that are not held out, at most ``most_rows``, learned in one task."""
    bags = labelled_bags(docs, labels, most_rows, id_col, text_col)
    got = bags.coalesce(1).mapInArrow(_learn, "embeddings binary, softmax binary, bias binary").first()
    if got is None:
        return learn(bags_of([]), np.zeros(0))
    return Model(np.frombuffer(got["embeddings"], "<f4").reshape(BUCKETS, DIMENSIONS), np.frombuffer(got["softmax"], "<f4").reshape(2, DIMENSIONS), np.frombuffer(got["bias"], "<f8"))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins, bias = model.value
        for whole in batches:
            for batch in slices(whole, "text", _SLICE):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(texts_of(batch.column("text")), margins, bias))], names=["doc_id", "score"])
    return run


def clean(docs: DataFrame, model: Model, text_col: str = "text", most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``most``."""
    numbers = docs.sparkSession.sparkContext.broadcast((model.margins(), float(model.bias[1] - model.bias[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins, bias = numbers.value
        for whole in batches:
            for batch in slices(whole, text_col, _SLICE):
                yield batch.filter(pa.array(scores(texts_of(batch.column(text_col)), margins, bias) < most))

    return docs.mapInArrow(run, docs.schema)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    numbers = docs.sparkSession.sparkContext.broadcast((model.margins(), float(model.bias[1] - model.bias[0])))
    return id_and_text(docs, id_col, text_col).mapInArrow(_score(numbers), "doc_id long, score double")
