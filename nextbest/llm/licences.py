"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A text is a sequence of words, line ends included, and a bag holds distinct words
weighted by the inverse document frequency over all documents, of words outside
the templates too.  A window starts or ends at a word of a template and
has as many words as the template at least, unless it is made of whole lines, and
``WINDOW`` words or twice the template's at most: what stands around a header is not in its window.  A window
whose cosine with its template reaches ``least``, and which holds the words of the licence's name that the template
has (its version, or what an SPDX line names), is a licence header of its
document; where two licences fit nearly alike (``MARGIN``), it is none.  First each document's windows that can reach ``least`` are found, with
the least weight that a word can have for the words outside the templates; the
frequencies of these words are then joined and the windows scored.  A document
is a licence file and declares its licence for its directory if the bag of all its
words reaches ``least`` with a whole licence text (``licence_texts``, related
licences among them, so that each file goes to the text most like it), or if it mostly
consists of headers; a whole text goes before headers.  A document without a header inherits from the nearest directory
above it that has a declaration: distinct directories are joined with their
ancestors' declarations by path, then documents with their directory.

Defined results: null and empty texts have no header and can still inherit; a
null path lies at the root; equal scores go to the first template by name; rows
with null or repeated ids come back one for one; only the id, the text and the
path are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from pathlib import Path
from types import MappingProxyType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nextbest.llm.common import slices, texts_of, written

#: Usual header statements and the first words of licence files; the whole texts are in ``licence_texts``.
# fixed values: names and statements as licences and their authors give them
_GNU = {"GPL-2.0": ("General Public License", "2"), "GPL-3.0": ("General Public License", "3"), "LGPL-2.1": ("Lesser General Public License", "2.1"),
        "LGPL-3.0": ("Lesser General Public License", "3"), "AGPL-3.0": ("Affero General Public License", "3")}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_STATEMENTS = {
    "0BSD": (),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004"),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "BSD 2-Clause License"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "BSD 3-Clause License",
                     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "CC0-1.0": ("CC0 1.0 Universal",),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License, Version 1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, Version 2.0"),
    "GPL-3.0": ("GNU General Public License Version 3, 29 June 2007",),
    "ISC": ("Released under the ISC License.", "The ISC License",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    "MIT": ("Released under the MIT License.", "The MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    "MIT-0": (),
    "MPL-1.1": ("The contents of this file are subject to the Mozilla Public License Version 1.1",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Zlib": (),
}


def header_templates() -> dict[str, tuple[str, ...]]:
    """Header statements by licence, and its SPDX lines."""
    found = {name: list(texts) for name, texts in _STATEMENTS.items()}
    for name, (full, version) in _GNU.items():
        found.setdefault(name, []).extend((
            f"This work is licensed under the GNU {full}, version {version}.", f"GNU {full} Version {version}",
            f"under the terms of the GNU {full} as published by the Free Software Foundation; either version {version} of the License"))
    for kind, full in _CC.items():
        found[f"CC-{kind}-4.0"] = [f"Licensed under CC {kind} 4.0.", f"Creative Commons {full} 4.0 International"]
        found[f"CC-{kind}-3.0"] = [f"Licensed under CC {kind} 3.0.", f"Creative Commons {full} 3.0 Unported"]
    for name, texts in found.items():
        texts += [f"SPDX-License-Identifier: {name}{more}" for more in (("", "-only", "-or-later", "+") if name in _GNU else ("",))]
    return {name: tuple(texts) for name, texts in found.items()}


TEMPLATES = header_templates()
#: A window whose second licence is as near as this to the first is no header.
MARGIN = 0.02
LEAST = 0.75
FILE_SHARE = 0.3
WINDOW = 32
_DEALS = 16
_SLICE = 2 << 20
_TERMS = 200_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() or c == 10 else 32 for c in range(256))


def whole_texts() -> dict[str, tuple[str, ...]]:
    """Whole licence texts by name."""
    return {p.name.removesuffix(".txt"): (p.read_text(encoding="utf-8"),) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


_SPDX = re.compile(rb"SPDX-License-Identifier:[ \t]*\(?([a-z0-9.+-]+(?:[ \t]+(?:AND|OR)[ \t]+\(?[a-z0-9.+-]+\)?)*)", re.IGNORECASE)


def folded(text: bytes) -> bytes:
    """Letters A-Z in lower case, marks as blanks; what an SPDX line names is one word, several licences together too."""
    out = text.translate(_FOLD)
    if b"SPDX-" not in text and b"spdx-" not in text:
        return out
    parts, end = [], 0
    for found in _SPDX.finditer(text):
        a, b = found.span(1)
        parts += [out[end:a], b"&".join(text[a:b].lower().split())]
        end = b
    return b"".join(parts) + out[end:]


def _terms(text: str) -> frozenset[bytes]:
    return frozenset(folded(text.encode()).split())


def _needed(name: str, text: str) -> frozenset[bytes]:
    """The words of a template without which a window is not its licence: those of the licence's name, its version among
    them, and what an SPDX line names."""
    words = _terms(text)
    named = frozenset(name.encode().translate(_FOLD).split())
    return frozenset(w for w in words if w in named or (w[:1] == b"v" and w[1:] in named) or not w.isalnum())


def _frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): documents of a task with each word; the empty word counts all."""
    found: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], names=["term", "n"])

    for batch in batches:
        for text in texts_of(batch.column("text")):
            found.update({b"", *folded(text).split()})
            if len(found) > _TERMS:
                yield rows()
                found.clear()
    yield rows()


class Scorer:
    """Cosines of bags of words to the templates, from document frequencies."""

    def __init__(self, templates: dict[str, tuple[str, ...]], frequency: dict[bytes, int], documents: int, least: float):
        self.documents = documents
        texts = [(name, t) for name in sorted(templates) for t in templates[name]]
        self.bags = [(name, _terms(t)) for name, t in texts]
        self.square = {w: self.weight(frequency.get(w, 0)) for _, bag in self.bags for w in bag}
        self.unseen = self.weight(0)
        self.size = [sum(self.square[w] for w in sorted(bag)) for _, bag in self.bags]
        self.vocabulary = frozenset(self.square)
        self.least = least
        self.length = [len(folded(t.encode()).split()) for _, t in texts]
        self.needed = [_needed(name, t) for name, t in texts]
        self.anchors = [self._anchors(bag, size) for (_, bag), size in zip(self.bags, self.size, strict=True)]

    def weight(self, documents: int) -> float:
        """Squared weight of a word that so many documents have."""
        return (math.log((1 + self.documents) / (1 + documents)) + 1) ** 2

    def _anchors(self, bag: frozenset[bytes], size: float) -> frozenset[bytes]:
        """The rarest words, of which a window that reaches the threshold has one: all others together weigh too little."""
        rare, rest = [], size
        for w in sorted(bag, key=lambda w: (-self.square[w], w)):
            if rest < 0.999 * self.least**2 * size:
                break
            rare.append(w)
            rest -= self.square[w]
        return frozenset(rare)

    def best(self, words: Iterable[bytes], others: Mapping[bytes, float] = MappingProxyType({})) -> tuple[float, str] | None:
        """The best cosine of a bag and its template; ``others`` are squared weights of words outside the templates."""
        distinct = set(words)
        shared = self.vocabulary & distinct
        own = sum(map(self.square.__getitem__, shared))
        norm = own + sum(others.get(w, self.unseen) for w in distinct - shared)
        if own < self.least**2 * norm or not shared:  # no template can reach the threshold
            return None
        cosines = [(sum(self.square[w] for w in shared & bag) / math.sqrt(norm * size), name) for (name, bag), size in zip(self.bags, self.size, strict=True)]
        top = max(c for c, _ in cosines)
        return (top, min(n for c, n in cosines if c == top)) if top >= self.least else None

    def may_reach(self, distinct: set[bytes]) -> bool:
        """Whether a bag can reach the threshold, if words outside the templates have the least weight possible."""
        shared = self.vocabulary & distinct
        own = sum(map(self.square.__getitem__, shared))
        if own < 0.999 * self.least**2 * min(self.size, default=math.inf):
            return False
        norm = own + len(distinct) - len(shared)
        return any(sum(self.square[w] for w in shared & bag) >= 0.999 * self.least * math.sqrt(norm * size) for (_, bag), size in zip(self.bags, self.size, strict=True))

    def windows(self, tokens: list[bytes], breaks: set[int], others: Mapping[bytes, float] | None) -> Iterator[tuple[float, str, int, int, int]]:
        """(cosine, template, start, end, last end) of the best window from each start that reaches the threshold, and the end
        of the longest one; without ``others``, words outside the templates have the least weight possible."""
        distinct = self.vocabulary.intersection(tokens)
        for (name, bag), size, length, anchors, needed in zip(self.bags, self.size, self.length, self.anchors, self.needed, strict=True):
            if not needed <= distinct or sum(self.square[w] for w in bag & distinct) < 0.999 * self.least**2 * size:
                continue
            reach = max(WINDOW, 2 * length)
            after = -1  # windows from here and before have been scored
            for anchor in [i for i, w in enumerate(tokens) if w in anchors]:
                for start in range(max(after + 1, anchor - reach + 1), anchor + 1):
                    lines = start in breaks
                    if not lines and tokens[start] not in bag and (start + length > len(tokens) or tokens[start + length - 1] not in bag):
                        continue
                    seen: set[bytes] = set()
                    own = norm = top = 0.0
                    lacking = len(needed)
                    end = last = start
                    for i in range(start, min(start + reach, len(tokens))):
                        w = tokens[i]
                        ends = i + 1 - start == length or (lines and i + 1 - start < length and i + 1 in breaks)
                        if w not in seen:
                            seen.add(w)
                            lacking -= w in needed
                            square = self.square.get(w)
                            if square is None:
                                square = 1.0 if others is None else others.get(w, self.unseen)
                            norm += square
                            if w in bag:
                                own += square
                                ends = ends or i + 1 - start > length
                        if ends and not lacking:
                            cosine = round(own / math.sqrt(norm * size), 12)
                            if cosine >= self.least:
                                last = i + 1
                                if cosine > top:
                                    top, end = cosine, i + 1
                    if last > start:
                        yield top, name, start, end, last
                after = anchor

    def regions(self, text: bytes) -> list[bytes]:
        """The parts of a text, line ends included, in which all its windows lie that can reach the threshold."""
        tokens, breaks = _lines(b"\n" + text + b"\n")
        spans = _merged((start, last) for _, _, start, _, last in self.windows(tokens, breaks, None))
        return [b"".join((b"\n" if i in breaks else b" ") + tokens[i] for i in range(a, b)) + (b"\n" if b in breaks else b"") for a, b in spans]

    def headers(self, region: bytes, others: Mapping[bytes, float]) -> tuple[float, str | None, int]:
        """(best cosine, its template, words in windows that reach the threshold)."""
        found = list(self.windows(*_lines(region), others))
        # a window that two licences fit alike tells neither
        best = max(found, default=None)
        if best and any(x[1] != best[1] and x[0] > best[0] - MARGIN and x[2] < best[3] and best[2] < x[3] for x in found):
            return 0.0, None, 0
        top = max((x[0] for x in found), default=0.0)
        return top, min((x[1] for x in found if x[0] == top), default=None), sum(b - a for a, b in _merged((x[2], x[3]) for x in found))


def _lines(text: bytes) -> tuple[list[bytes], set[int]]:
    """The words of a folded text, and the places between words at which a line ends."""
    tokens: list[bytes] = []
    breaks = set()
    for k, line in enumerate(text.split(b"\n")):
        if k:
            breaks.add(len(tokens))
        tokens += line.split()
    return tokens, breaks


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = "doc_id long, dir string, total long, regions array<string>, words array<string>, others array<string>"
_ROWS = "doc_id long, dir string, header string, cosine double, file boolean"


def _find(scorers):
    """Of each document: the parts that its windows lie in, all its words if they may reach a whole text, and those words
    of both that are outside the templates or texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        headers, texts = scorers.value
        for whole in batches:
            for batch in slices(whole, "text", _SLICE):
                total, regions, words, others = [], [], [], []
                for text in texts_of(batch.column("text")):
                    plain = folded(text)
                    tokens = plain.split()
                    distinct = set(tokens)
                    parts = headers.regions(plain)
                    bag = distinct if texts.may_reach(distinct) else set()
                    total.append(len(tokens))
                    regions.append([p.decode() for p in parts])
                    words.append(sorted(w.decode() for w in bag))
                    others.append(sorted(w.decode() for w in ({w for p in parts for w in p.split()} - headers.vocabulary) | (bag - texts.vocabulary)))
                strings = [pa.array(x, pa.list_(pa.string())) for x in (regions, words, others)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("dir"), pa.array(total, pa.int64()), *strings],
                                                 names=["doc_id", "dir", "total", "regions", "words", "others"])
    return run


def _score(scorers, file_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        headers, texts = scorers.value
        for batch in batches:
            rows = []
            for regions, words, total, known in zip(*(batch.column(c).to_pylist() for c in ("regions", "words", "total", "known")), strict=True):
                others = {x["word"].encode(): headers.weight(x["n"]) for x in known or ()}
                if hit := texts.best([w.encode() for w in words], others):
                    rows.append((*hit, True))
                    continue
                parts = [headers.headers(r.encode(), others) for r in regions]
                top = max((p[0] for p in parts), default=0.0)
                name = min((p[1] for p in parts if p[0] == top and p[1]), default=None)
                rows.append((top, name, name is not None and sum(p[2] for p in parts) / total >= file_share))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("dir"), pa.array([r[1] for r in rows], pa.string()), pa.array([r[0] for r in rows], pa.float64()),
                 pa.array([r[2] for r in rows], pa.bool_())], names=["doc_id", "dir", "header", "cosine", "file"])
    return run


def _frequencies(base: DataFrame, words: Iterable[bytes]) -> tuple[DataFrame, dict[bytes, int], int]:
    """(term, n) of all words by their hash, written; those of ``words``; the number of documents."""
    spark = base.sparkSession
    table = written(base.select("text").mapInArrow(_frequency, "term string, n long").select(F.xxhash64("term").alias("term"), "n").groupBy("term").agg(
        F.sum("n").alias("n")), "licence-frequencies")
    asked = spark.createDataFrame([(w.decode(),) for w in sorted({b"", *words})], "word string").withColumn("term", F.xxhash64("word"))
    counts = {r["word"].encode(): r["n"] for r in table.join(F.broadcast(asked), "term").select("word", "n").collect()}  # a row for each word of the templates and texts
    return table, counts, counts.pop(b"", 0)


def _scored(found: DataFrame, frequencies: DataFrame, scorers, file_share: float) -> DataFrame:
    """(doc_id, dir, header, cosine, file) of all documents; those that may have a licence are joined with the frequencies of
    their other words."""
    some = (F.size("regions") > 0) | (F.size("words") > 0)
    asked = found.where(some).select("row", F.explode("others").alias("word")).withColumn("term", F.xxhash64("word"))
    known = asked.join(frequencies, "term").groupBy("row").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    scored = found.where(some).join(known, "row", "left").select("doc_id", "dir", "total", "regions", "words", "known").mapInArrow(_score(scorers, file_share), _ROWS)
    none = found.where(~some).select("doc_id", "dir", F.lit(None).cast("string").alias("header"), F.lit(0.0).alias("cosine"), F.lit(False).alias("file"))
    return scored.unionByName(none)


def licences(docs: DataFrame, directory: Column, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None,
             least: float = LEAST, file_share: float = FILE_SHARE, texts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(doc_id, dir, header, cosine, declares, licence, declared_in): own header, whether the document is a licence file,
    the licence that holds for it, and the directory it was inherited from (null for an own header)."""
    templates = templates or TEMPLATES
    texts = whole_texts() if texts is None else texts
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(directory, F.lit("")).alias("dir"))
    vocabulary = frozenset().union(*(_terms(t) for ts in (*templates.values(), *texts.values()) for t in ts))
    frequencies, counts, documents = _frequencies(base, vocabulary)
    scorers = spark.sparkContext.broadcast((Scorer(templates, counts, documents, least), Scorer(texts, counts, documents, least)))
    found = written(base.mapInArrow(_find(scorers), _FOUND).withColumn("row", F.monotonically_increasing_id()), "licence-windows")
    rows = written(_scored(found, frequencies, scorers, file_share), "licence-headers")

    files = rows.where("file")
    declared = files.groupBy("dir").agg(F.min(F.struct(-F.col("cosine"), F.col("header"))).alias("x")).select(
        F.col("dir").alias("declared_in"), F.col("x.header").alias("declared"))
    dirs = rows.select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("depth", "declared_in"))
    nearest = above.join(declared, "declared_in").groupBy("dir").agg(F.max_by(F.struct("declared", "declared_in"), "depth").alias("x")).select(
        "dir", F.col("x.declared").alias("declared"), F.col("x.declared_in").alias("declared_in"))
    own = F.col("header").isNotNull()
    # a directory may hold a third of all rows: its rows go to several tasks
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(_DEALS)).cast("int"))
    nearest = nearest.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(_DEALS - 1))))
    return rows.join(nearest, ["dir", "deal"], "left").select(
        "doc_id", "dir", "header", "cosine", F.col("file").alias("declares"),
        F.coalesce("header", "declared").alias("licence"), F.when(~own, F.col("declared_in")).alias("declared_in"))
