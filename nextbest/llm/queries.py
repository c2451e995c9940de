"""The queries ``opN_*``: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nextbest.llm import bpe, flat, licences, minhash, online, pack, periodic, phrases, quality, secrets, shard, toxicity, vectors
from nextbest.session import apply_tuning, scratch_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER, BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SEPARATOR = 49407  # the tokenizer's end-of-document id; its string in a text is ordinary text here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_tuning(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, file, ordinal, start) of every document, found in flat token files written from ``documents``."""
    target = scratch_path(spark, "flat-tokens")
    names = flat.write_flat(table(spark, sf_dir, "documents"), target, TOKENIZER, SEPARATOR)
    found = flat.named(flat.scan(spark, target, SEPARATOR), names)
    return found.select("doc_id", "n_tokens", F.regexp_extract("uri", "part-(\\d+)-", 1).cast("int").alias("file"), "ordinal", "start")


def op2_vector_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, n_links, component_id, kept)"""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)"""
    return pack.packed(table(spark, sf_dir, "documents"), TOKENIZER, with_ids=False)


def op4_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)"""
    return bpe.encode_decode(table(spark, sf_dir, "documents"), TOKENIZER, digests=True)


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, dir, header, cosine, declares, licence, declared_in); a document's directory is derived from its source, language and id."""
    docs = table(spark, sf_dir, "documents")
    leaf = F.concat_ws("/", "source", "lang", F.concat(F.lit("part"), F.pmod(F.col("doc_id"), F.lit(97)).cast("string")))
    directory = F.when(F.pmod("doc_id", F.lit(50)) == 0, F.col("source")).when(F.pmod("doc_id", F.lit(5)) == 0, F.concat_ws("/", "source", "lang")).otherwise(leaf)
    out = licences.licences(docs, directory)
    return out.select("doc_id", "dir", "header", F.round("cosine", 6).alias("cosine"), "declares", "licence", "declared_in")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted)"""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule)"""
    docs = table(spark, sf_dir, "documents")
    rules = quality.learn(quality.labelled_statistics(docs, table(spark, sf_dir, "labels")))
    return quality.judged(quality.statistics(docs), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op8_minhash_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept)"""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=75)


def op9_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard)"""
    rows = shard.balanced(table(spark, sf_dir, "documents"), shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)"""
    rows = secrets.scan(table(spark, sf_dir, "documents"))

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return rows.select("doc_id", *[of(k) for k in secrets.BASE], F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


def respliced(doc_id: int | None, n: int) -> np.ndarray | None:
    """One id in ten, by the checksum of its decimal digits, reads part of its words over and over from some word on."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g, i = h // 10, np.arange(n)
    a = g % n
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)"""
    rows = periodic.periodic_runs(table(spark, sf_dir, "documents"), reorder=respliced)
    rows = rows.withColumn("top", F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
                       F.expr("1000 * top.length div -top.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score)"""
    return phrases.collocations(table(spark, sf_dir, "documents"), least=30, top=2000, percent=80)


#: The phrases again, from the words of every piece and all their sequences.
OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS row,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(unnest(pieces), '[ \t]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT lang, k, w[i : i + k - 1] AS g FROM (
        SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) AS t(k) WHERE len(w) >= k)),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY lang, k, g HAVING count(*) >= 30),
c AS (SELECT f.lang, f.k, f.g, f.f AS a, x.f AS l, y.f AS r, cut, (2000000::HUGEINT * f.f) // (x.f + y.f) AS score
      FROM f, (VALUES (1), (2), (3)) AS t(cut), f AS x, f AS y
      WHERE cut < f.k AND x.lang = f.lang AND y.lang = f.lang AND x.g = f.g[1 : cut] AND y.g = f.g[cut + 1 : f.k]),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
s AS (SELECT lang, sub, max(f) AS f FROM (
        SELECT lang, f, g[i : i + m - 1] AS sub FROM f, (VALUES (2), (3)) AS t(m), (VALUES (1), (2), (3)) AS u(i) WHERE m < k AND i + m - 1 <= k)
      GROUP BY lang, sub),
z AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN s ON s.lang = b.lang AND s.sub = b.g WHERE s.f IS NULL OR 100 * s.f < 80 * a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT q.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM q JOIN n ON n.lang = q.lang WHERE rank <= 2000
"""


def op13_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)"""
    return online.packed(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, BYTE_RANKS, with_ids=False)


QUERIES = {f.__name__: f for f in (
    op1_separator_scan, op2_vector_near_duplicates, op3_vector_best_fit, op4_chunk_bpe, op5_licence_scan, op6_toxicity, op7_decision_list,
    op8_minhash_lists, op9_vector_shards, op10_secret_automaton, op11_periodic_runs, op12_phrase_index, op13_bounded_space_packing)}

ORACLES: dict[str, str] = {"op12_phrase_index": OP12_SQL}
