"""Quality rules: statistics of whole texts as SQL expressions, and a learned decision list over them.

The list is learned by sequential covering.  From labelled statistics, one
rule at a time is grown: the threshold condition with the highest gain joins
the conjunction until it covers no good document of the growing part or the
gain ends.  Then the last conditions are pruned as long as the rule's worth on
the pruning part does not fall, and the rule is kept only if it is precise
enough there.  What it covers is taken out, and the next rule is grown.  All
counts come from Spark aggregates over the labelled rows; a few hundred counts
by feature and threshold reach the driver for each step.  The list is then an
ordered conditional expression that Spark evaluates in the scan.

Only DataFrame and SQL functions are used.

Defined results: a null or empty text has no words and fails the base rules; a
statistic that would divide by zero is 0; rows with null or repeated ids come
back one for one; without labelled rows of both classes the list is empty and
keeps all.  Only the id and the text are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nextbest.llm.common import written

_SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Labelled rows that the list is learned from, at most (those with the smallest hash of the id).
MOST_LABELLED = 20_000
THRESHOLDS = 16
MOST_RULES, MOST_CONDITIONS = 8, 3
LEAST_PRECISION, LEAST_COVERED = 0.9, 0.01


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def _without(text: str, characters: str) -> Column:
    """The text without some characters; replacing one after the other beats translate, which looks up each character."""
    out = F.col(text)
    for c in characters:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _repeated_words(hashes: Column, n: Column) -> Column:
    """Words inside 5-word windows that occur twice or more, from the windows' hashes.

    Sorted (hash, position) pairs bring equal windows together; the positions of
    those cover min(5, distance to the next) words each."""
    def of_sorted(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        same = F.filter(F.sequence(F.lit(0), last), lambda i: (
            ((i > 0) & (F.get(pairs, i - 1)["h"] == F.get(pairs, i)["h"])) | ((i < last) & (F.get(pairs, i + 1)["h"] == F.get(pairs, i)["h"]))))
        at = F.array_sort(F.transform(same, lambda i: F.get(pairs, i)["p"]))
        def covered(p: Column) -> Column:
            return F.aggregate(p, F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")), lambda acc, x: F.struct(
                (acc["sum"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("sum"), x.alias("last")))["sum"]
        return _let(at, covered)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, of_sorted))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct_words) of whole texts, as longs;
    with ``keep_row`` also ``row``, a struct of all columns of ``docs``."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_row else []))
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = ["row"] if keep_row else []
    trimmed = F.btrim(text, F.lit(_SPACE))
    # the words' hashes, twice referred to below, so that Catalyst keeps them as a column of their own
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.split(trimmed, "[ \\t-\\r]+"), lambda w: F.xxhash64(w)))
    rows = base.select("doc_id", *kept, text.alias("text"), words.alias("w"))
    n = F.size("w")

    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))),
                           lambda h, i: F.xxhash64(h, *[F.get(w, i + k) for k in range(1, WINDOW)]))

    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(_SPACE))) > 0)
    repeated = F.when(n < WINDOW, F.lit(0)).otherwise(_let(_let(F.col("w"), windows), lambda h: _repeated_words(h, n)))
    return rows.select(
        "doc_id", *kept, n.cast("long").alias("n_words"), F.length(_without("text", _SPACE)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without("text", SYMBOLS))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What conditions compare: ratios that do not depend on a text's length, and its logarithmic length."""
    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))

    return {"log_words": F.log1p(F.col("n_words").cast("double")), "word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "word_chars"),
            "repeats": share("n_repeat_words", "n_words"), "dup_lines": F.col("n_dup_lines").cast("double"), "distinct": share("n_distinct_words", "n_words")}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules, each a conjunction that rejects; what no rule covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def fired(self) -> Column:
        """Number of the first rule that covers a row, from 1; 0 if none does."""
        out = F.lit(0)
        for i, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(_all([c.column() for c in rule]), F.lit(i)).otherwise(out)
        return out

    def text(self) -> list[str]:
        return [" and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in rule) for rule in self.rules]


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def learn(labelled: DataFrame, most_rows: int = MOST_LABELLED) -> DecisionList:
    """A decision list from statistics with a column ``bad`` (1: to be rejected, 0: to be kept).

    Two of three rows (by hash) grow rules, the third prunes them.  With more than ``most_rows`` rows those with the
    smallest hash of the id are used."""
    names = list(features())
    bounded = labelled.where("bad IS NOT NULL").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(most_rows)
    rows = written(bounded.select((F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) != 0).alias("grow"), F.col("bad").cast("int").alias("bad"),
                                  *[c.alias(k) for k, c in features().items()]), "rules-labelled")
    grid = [i / THRESHOLDS for i in range(1, THRESHOLDS)] + [0.98, 0.995]
    cut = rows.agg(*[F.percentile_approx(k, grid, 10_000).alias(k) for k in names]).first()
    thresholds = {k: sorted(set(cut[k] or [])) for k in names}
    size = rows.count()
    if not any(thresholds.values()):
        return DecisionList(())
    # each row's bin of each feature: thresholds below its value
    bins = F.array(*[F.struct(F.lit(k).alias("feature"), sum((F.when(F.col(k) > t, 1).otherwise(0) for t in thresholds[k]), F.lit(0)).alias("bin")) for k in names])

    def where(conditions: list[Condition]) -> Column:
        return _all([F.col(c.feature) > c.threshold if c.above else F.col(c.feature) <= c.threshold for c in conditions])

    def counted(left: DataFrame, conditions: list[Condition]) -> dict[Condition, tuple[int, int]]:
        """Bad and good rows of the growing part that each further condition leaves."""
        table = left.where(F.col("grow") & where(conditions)).select("bad", F.explode(bins).alias("x")).groupBy("x.feature", "x.bin").agg(
            F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
        out = {}
        for k in names:
            own = {r["bin"]: (r["p"], r["n"]) for r in table if r["feature"] == k}
            for i, t in enumerate(thresholds[k]):
                low = [v for b, v in own.items() if b <= i]
                high = [v for b, v in own.items() if b > i]
                for above, side in ((False, low), (True, high)):
                    out[Condition(k, above, t)] = (sum(v[0] for v in side), sum(v[1] for v in side))
        return out

    def worth(left: DataFrame, rule: list[Condition]) -> list[tuple[int, int]]:
        """Bad and good rows of the pruning part that each prefix of the rule covers."""
        cols = [F.sum(F.when(where(rule[: i + 1]), x).otherwise(0)) for i in range(len(rule)) for x in (F.col("bad"), 1 - F.col("bad"))]
        got = [int(x or 0) for x in left.where(~F.col("grow")).agg(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()]
        return list(zip(got[::2], got[1::2], strict=True))

    found: list[tuple[Condition, ...]] = []
    left = rows
    for _ in range(MOST_RULES):
        rule: list[Condition] = []
        total = left.where("grow").agg(F.sum("bad"), F.sum(1 - F.col("bad"))).first()
        p, n = int(total[0] or 0), int(total[1] or 0)
        while p and n and len(rule) < MOST_CONDITIONS:
            def gain(pn: tuple[int, int], p=p, n=n) -> float:
                return pn[0] * (math.log2(pn[0] / (pn[0] + pn[1])) - math.log2(p / (p + n))) if pn[0] else 0.0
            options = counted(left, rule)
            best = max(options, key=lambda c: (gain(options[c]), c.feature, c.above, c.threshold))
            if gain(options[best]) <= 0:
                break
            rule.append(best)
            p, n = options[best]
        if not rule:
            break
        on_prune = worth(left, rule)
        score = [(a - b) / (a + b) if a + b else -1.0 for a, b in on_prune]
        keep = max(range(len(rule)), key=lambda i: (score[i], -i))
        a, b = on_prune[keep]
        if a + b == 0 or a < LEAST_PRECISION * (a + b) or a < LEAST_COVERED * size / 30:
            break
        found.append(tuple(rule[: keep + 1]))
        left = left.where(~where(list(found[-1])))
    return DecisionList(tuple(found))


def judged(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """``stats`` with base_failed, rule (number of the rule that rejects, else 0) and kept."""
    failed = base_failed()
    fired = rules.fired()
    return stats.withColumns({"base_failed": failed, "rule": fired, "kept": ~failed & (fired == 0)})


def labelled_statistics(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_LABELLED) -> DataFrame:
    """Statistics of the labelled documents (at most ``most_rows``, those with the smallest hash), ``bad`` from ``quality``.
    Labels without a document count for nothing."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").join(docs.select("doc_id"), "doc_id", "left_semi")
    some = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(most_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi")  # most_rows longs
    return statistics(chosen).join(F.broadcast(some), "doc_id").withColumn("bad", 1 - F.col("quality"))
