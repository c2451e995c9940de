"""Quality rules, toxicity, secrets and licences against plain Python and held-out rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import documents, empty, texts, words
from pyspark.sql import functions as F

from nextbest.llm import automaton, licences, quality, queries, secrets, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- quality rules -----------------------------------------------------------------------------------------------------
def plain_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, covered, seen, again = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(i, i + 5))
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered)


def test_statistics_against_plain_python(spark):
    rng = random.Random(2)
    some = ["a b c d e a b c d e", "x x x x x x x", "a\x0bb\x0cc\rd e", "é| #\n\né| #\n\n", "a b c d e f g a b c d e", "q " * 3000, None, "", "   x", "a\x00b c"]
    some += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    docs = documents(spark).unionByName(documents(spark, [(100 + k, t, None, None, None) for k, t in enumerate(some)]))
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.statistics(docs).collect())
    assert got == sorted((r.doc_id or -1, *plain_statistics(r.text)) for r in docs.collect())
    assert quality.statistics(empty(spark)).count() == 0


def labelled(spark, n=900):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(n):
        bad = i % 3 == 0
        text = " ".join(w + ("#" if bad and rng.random() < 0.3 else "") for w in words(rng.randint(20, 60), i))
        rows.append((i, text))
        marks.append((i, 1 - int(bad), 0))
    return texts(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_the_list_learns_what_divides_the_classes(spark):
    docs, labels = labelled(spark)
    rules = quality.learn(quality.labelled_statistics(docs, labels))
    assert rules.rules and any(c.feature == "symbols" for rule in rules.rules for c in rule)
    judged = quality.judged(quality.statistics(docs), rules).join(labels, "doc_id")
    right = judged.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.97
    # the emitted expression fires the first rule whose conditions all hold
    names = quality.features()
    for r in judged.select("rule", *[c.alias(k) for k, c in names.items()]).collect():
        holds = [all(r[c.feature] > c.threshold if c.above else r[c.feature] <= c.threshold for c in rule) for rule in rules.rules]
        assert r.rule == (holds.index(True) + 1 if any(holds) else 0)


def test_without_labels_all_is_kept(spark):
    docs, labels = labelled(spark, 30)
    for marks in (labels.where("false"), labels.where("quality = 1"), labels.withColumn("quality", F.lit(None).cast("int"))):
        rules = quality.learn(quality.labelled_statistics(docs, marks))
        assert rules.rules == ()
        assert quality.judged(quality.statistics(docs), rules).where("NOT kept").count() == 0
    base = {r.doc_id: r.base_failed for r in quality.judged(quality.statistics(documents(spark)), quality.DecisionList(())).collect()}
    assert base[1] and base[2] and base[4] and not base[9]


def test_only_sql_runs(spark):
    docs, _ = labelled(spark, 5)
    plan = quality.judged(quality.statistics(docs), quality.DecisionList(()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# -- toxicity ----------------------------------------------------------------------------------------------------------
def insulting(rng, clean):
    out = list(clean)
    for _ in range(max(1, len(out) // 15)):
        out.insert(rng.randrange(len(out) + 1), rng.choice(["moronic", "idiotic", "scumbag", "worthless", "pathetic"]))
    return out


def toxic_texts(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = words(rng.randint(20, 120), seed * 100_000 + i)
        rows.append((" ".join(insulting(rng, w) if i % 4 == 0 else w), int(i % 4 == 0)))
    return rows


def test_held_out_accuracy_and_misspellings():
    train, test = toxic_texts(1200, 1), toxic_texts(400, 2)
    model = toxicity.train([t.encode() for t, _ in train], np.array([y for _, y in train]))
    bias = float(model.bias[1] - model.bias[0])
    scores = toxicity.scores([t.encode() for t, _ in test], model.margins(), bias)
    assert ((scores >= 0.5) == np.array([y for _, y in test])).mean() > 0.95
    filler = " ".join(words(10, 9))
    known, odd, clean = toxicity.scores([f"{filler} idiotic".encode(), f"{filler} idiotiic".encode(), filler.encode()], model.margins(), bias)
    assert known >= odd > clean


def test_scores_are_the_model_s():
    """Prefix sums give the mean over words of the mean over subwords."""
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(size=(toxicity.BUCKETS, 4)), rng.normal(size=(2, 4)), np.array([0.1, -0.2]))
    margins = model.margins()
    some = [b"", b" .. ", b"One two", "é Straße!".encode(), b"a", b"one two " * 500]

    def bucket(data, salt):
        up, _ = toxicity.powers(len(data) + 1)
        h = (toxicity._VALUE[np.frombuffer(data, np.uint8)] * up[: len(data)]).sum(dtype=np.uint64)
        return int(toxicity.Words._bucket(np.array([h]), salt)[0])

    for text, got in zip(some, toxicity.scores(some, margins, -0.3), strict=True):
        folded = bytes(toxicity._FOLD[np.frombuffer(text, np.uint8)]) if text else b""
        means = []
        for w in folded.split(b" "):
            if w:
                padded = b" " + w + b" "
                parts = [bucket(w, 99)] + [bucket(padded[i : i + n], n) for n in toxicity.GRAMS for i in range(len(padded) - n + 1)]
                means.append(margins[parts].mean())
        mean = np.mean(means) if means else 0.0
        assert got == pytest.approx(1 / (1 + np.exp(-(toxicity.SCALE * mean - 0.3))), abs=1e-9)


def test_short_texts_score_anywhere_in_a_batch():
    """Every kind of text of 0 to 6 bytes, alone and last in a batch, scores as between longer texts."""
    rng = np.random.default_rng(4)
    margins = rng.normal(size=toxicity.BUCKETS)
    for text in (bytes(x) for n in range(7) for x in __import__("itertools").product(b"a ", repeat=n)):
        [alone] = toxicity.scores([text], margins, 0.1)
        assert toxicity.scores([b"some words", text], margins, 0.1)[1] == pytest.approx(alone)
        assert toxicity.scores([b"x", text, b"some more words"], margins, 0.1)[1] == pytest.approx(alone)
    assert len(toxicity.scores([], margins, 0.1)) == 0
    for texts_ in ([b"hello a"], [b"it is a"], [b""], [b"", b""]):
        assert len(toxicity.scores(texts_, margins, 0.1)) == len(texts_)


def test_a_table_without_labels_gives_a_model(spark):
    model = toxicity.fit(empty(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scored(texts(spark, [(1, "a"), (2, "")]), model).where("score < 1e-9").count() == 2


def test_toxicity_of_tables(spark):
    rows = toxic_texts(600, 5)
    docs = texts(spark, [(i, t) for i, (t, _) in enumerate(rows)])
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)] + [(None, 1, 1), (3, None, None), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.scored(docs, model).select("doc_id", toxicity.held_out().alias("h"), "score").collect()
    assert {r.doc_id for r in out if r.h} == {i for i in range(600) if __import__("zlib").crc32(str(i).encode()) % 5 == 0}
    right = np.mean([(r.score >= 0.5) == rows[r.doc_id][1] for r in out if r.h])
    assert right > 0.9
    odd = toxicity.scored(documents(spark), model).collect()
    assert len(odd) == documents(spark).count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.scored(empty(spark), model).count() == 0
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert max(r.score for r in toxicity.scored(docs, none).collect()) < 1e-100
    assert toxicity.clean(documents(spark), none).count() == documents(spark).count()


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows = toxic_texts(400, 6)
    docs = texts(spark, [(i, t) for i, (t, _) in enumerate(rows)])
    held = toxicity.held_out()
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.fit(docs, x) for x in (labels, flipped))
    assert (one.embeddings == two.embeddings).all() and (one.bias == two.bias).all()


def test_bags_of_tasks_are_those_of_the_texts(spark):
    rows = toxic_texts(300, 7) + [("", 0), ("É ß one idiotic", 1), ("idiotic one É", 1)]
    docs = texts(spark, [(i, t) for i, (t, _) in enumerate(rows)]).repartition(5)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    bags, marks = toxicity.gathered(toxicity.labelled_bags(docs, labels).toArrow())
    learned = [i for i in range(len(rows)) if __import__("zlib").crc32(str(i).encode()) % 5 and rows[i][0]]
    plain = toxicity.bags_of([rows[i][0].encode() for i in learned])
    assert bags.n == plain.n and marks.tolist() == [rows[i][1] for i in learned]
    for got, want in zip((*bags.words, *bags.subwords), (*plain.words, *plain.subwords), strict=True):
        assert (got == want).all()


def test_rare_insults_are_learned():
    """Each insult is in 3 of 2,000 texts, far under a share of 0.2 %, and shares no n-gram with the others."""
    rng = random.Random(12)
    insults = ["".join(rng.choice("klmnopqrstuvwxyz") for _ in range(9)) for _ in range(120)]
    rows = [(" ".join(words(rng.randint(15, 30), 500 + i)), 0) for i in range(1640)]
    rows += [(f"{' '.join(words(12, 9000 + i))} {insults[i % 120]} {insults[i % 120]}", 1) for i in range(360)]
    rng.shuffle(rows)
    model = toxicity.train([t.encode() for t, _ in rows], np.array([y for _, y in rows]))
    fresh = [f"{' '.join(words(12, 20_000 + i))} {w} {w}".encode() for i, w in enumerate(insults)]
    found = toxicity.scores(fresh, model.margins(), float(model.bias[1] - model.bias[0])) >= 0.5
    clean = toxicity.scores([" ".join(words(15, 30_000 + i)).encode() for i in range(200)], model.margins(), float(model.bias[1] - model.bias[0])) >= 0.5
    assert found.mean() > 0.9 and clean.mean() < 0.05


def test_only_near_copies_leave_the_training_rows(spark):
    passage = words(20, 40)  # half of each text
    own = [words(20, 600 + i) for i in range(60)]
    rows = [" ".join(passage + w) for w in own] + [" ".join(words(60, 900)) + f" tail{k}" for k in range(20)]
    docs = texts(spark, list(enumerate(rows)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(rows))], "doc_id long, toxic int")
    learned = [i for i in range(len(rows)) if __import__("zlib").crc32(str(i).encode()) % 5]
    _, marks = toxicity.gathered(toxicity.labelled_bags(docs, labels).toArrow())
    assert len(marks) == sum(i < 60 for i in learned) + 1


def test_labels_without_a_document_do_not_use_up_the_sample(spark):
    rows = toxic_texts(60, 8)
    docs = texts(spark, [(i, t) for i, (t, _) in enumerate(rows)])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(3000)], "doc_id long, toxic int")
    _, marks = toxicity.gathered(toxicity.labelled_bags(docs, labels, most_rows=60).toArrow())
    assert len(marks) == sum(__import__("zlib").crc32(str(i).encode()) % 5 > 0 for i in range(60))


# -- secrets -----------------------------------------------------------------------------------------------------------
def plain_spans(text):
    rows = []
    for r, (kind, prefix, tail, least, fold) in enumerate(secrets.RULES):
        rule = re.compile(f"(?a:{f'(?i:{prefix})' if fold else prefix}({tail}+))")
        for m in rule.finditer(text):
            if len(m[m.lastindex]) >= least:
                rows.append((m.start(), r, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(rows)]


def test_automaton_against_regular_expressions():
    rng = random.Random(5)
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", " ", "=", ":", '"', "'", "AKIA", "A1B2C3D4", "0123456789abcdef", "deadbeef", "ghp_", "xoxb-",
             "é", "\n", "x", "-", ".", "z" * 9, "   ", "_", "API_", "tok", "pass", "f" * 40]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["token=secret= abcdefgh1", "passpassword=abcdefgh", "a" * 100_000, ""]
    machine = secrets.automaton()
    for text, got in zip(some, secrets.exact_spans(machine, [t.encode() for t in some]), strict=True):
        assert got == plain_spans(text)


def test_the_automaton_is_minimal_and_small():
    machine = secrets.automaton()
    assert machine.table.nbytes < 1 << 20
    rows = machine.table.reshape(-1, machine.classes) // machine.classes
    key = np.column_stack([machine.ended, machine.idle])
    for _ in range(len(rows)):
        _, key2 = np.unique(np.column_stack([key, key[rows, 0] if key.ndim > 1 else key[rows]]), axis=0, return_inverse=True)
        key2 = key2.reshape(-1)
        if key.ndim == 1 and key2.max() == key.max():
            break
        key = key2
    assert key.max() + 1 == len(rows)


def test_unfit_rules_are_refused():
    with pytest.raises(ValueError):
        automaton.compile_rules((automaton.Rule("x", "a{3}", "[a-z]", 2),))
    with pytest.raises(ValueError):
        automaton.compile_rules((automaton.Rule("x", "é", "[a-z]", 2),))


def test_secrets_of_tables(spark):
    docs = documents(spark)
    got = sorted((r.doc_id or -1, [(s.kind, s.start, s.end) for s in r.spans]) for r in secrets.scan(docs).collect())
    assert got == sorted((r.doc_id or -1, plain_spans(r.text or "")) for r in docs.collect())
    marked = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert marked[11] == "[secret]\" and é [secret]" and marked[1] is None and marked[10] == "é ß 日本語 😀 ÀÉ x"
    assert secrets.redacted(docs).columns == docs.columns
    assert secrets.scan(empty(spark)).count() == 0 and secrets.redacted(empty(spark)).count() == 0


# -- licences ----------------------------------------------------------------------------------------------------------
def test_licences_and_inheritance(spark):
    body = " ".join(words(40, 1))
    rows = [(1, f"{body}\nReleased under the MIT License.", "a/b/c"), (2, body, "a/b/c"), (3, "Licensed under the Apache License, Version 2.0.", "a/b"),
            (4, body, "a/b/c/d"), (5, body, "a"), (6, "GNU General Public License Version 3, 29 June 2007\nThis work is licensed under the GNU General Public License, version 3.", ""),
            (7, None, "a/b/x"), (8, "", None), (9, body, "z"), (None, body, "a/b/c"), (10, "The MIT License", "a/b/c/d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string").selectExpr("*", "'x' AS dir", "'y' AS declared", "1 AS depth")
    got = {r.doc_id: (r.header, r.licence, r.declared_in, r.declares) for r in licences.licences(docs, F.col("path")).collect()}
    assert got == {
        1: ("MIT", "MIT", None, False), 2: (None, "Apache-2.0", "a/b", False), 3: ("Apache-2.0", "Apache-2.0", None, True),
        4: (None, "MIT", "a/b/c/d", False), 5: (None, "GPL-3.0", "", False), 6: ("GPL-3.0", "GPL-3.0", None, True), 7: (None, "Apache-2.0", "a/b", False),
        8: (None, "GPL-3.0", "", False), 9: (None, "GPL-3.0", "", False), None: (None, "Apache-2.0", "a/b", False), 10: ("MIT", "MIT", None, True)}
    assert licences.licences(docs.where("false"), F.col("path")).count() == 0


def test_cosines_against_plain_vectors():
    scorer = licences.Scorer(licences.TEMPLATES, {b"the": 90, b"license": 5}, 100, 0.0)
    rng = random.Random(1)
    vocabulary = sorted(scorer.vocabulary) + [b"other", b"words"]
    for _ in range(200):
        bag = {rng.choice(vocabulary) for _ in range(rng.randint(1, 12))}
        weight = {w: scorer.square.get(w, scorer.unseen) ** 0.5 for w in {*bag, *vocabulary}}
        best = max(sum(weight[w] ** 2 for w in bag & t) / (sum(weight[w] ** 2 for w in bag) * sum(weight[w] ** 2 for w in t)) ** 0.5 for _, t in scorer.bags)
        got = scorer.best(list(bag))
        assert (got[0] if got else 0.0) == pytest.approx(best, abs=1e-12)


SAID = {
    "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0", "// SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "SPDX-License-Identifier: LGPL-3.0": "LGPL-3.0",
    "# SPDX-License-Identifier: ISC": "ISC", "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause", "SPDX-License-Identifier: MIT": "MIT",
    "SPDX-License-Identifier: MIT OR Apache-2.0": None, "SPDX-License-Identifier: (GPL-2.0-only AND MIT)": None, "SPDX-License-Identifier: LicenseRef-own": None, "SPDX-License-Identifier:": None,
    "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0", "Licensed under CC BY-NC-ND 4.0": "CC-BY-NC-ND-4.0", "Licensed under CC BY 4.0": "CC-BY-4.0", "Licensed under CC BY 2.5": None,
    "Creative Commons Attribution 4.0 International": "CC-BY-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International": "CC-BY-ND-4.0",
    "the GNU General Public License, version 2": "GPL-2.0", "General Public License, version 2": "GPL-2.0", "GNU General Public License": None,
    "GNU Lesser General Public License, version 2.1": "LGPL-2.1", "GNU Lesser General Public License, version 3": "LGPL-3.0",
    "Licensed under the Apache License, Version 1.1.": None, "Released under the BSD License.": None, "Released under the ISC License.": "ISC", "BSD 2-Clause License": "BSD-2-Clause",
    "Eclipse Public License v1.0": "EPL-1.0", "Eclipse Public License 2.0": "EPL-2.0", "Eclipse Public License 3.1": None,
    "Redistribution and use in source and binary forms, with or without modification, are permitted": None,
}


@pytest.mark.parametrize("frequency", [{}, {b"the": 9990, b"license": 9000, b"under": 9500, b"licensed": 9000, b"public": 8000, b"spdx": 5000, b"identifier": 5000, b"mit": 3, b"nc": 9000, b"sa": 9000}])
@pytest.mark.parametrize("around", ["{}", "Copyright 2020 Foo Bar. {} one two three"])
def test_related_licences_are_told_apart(frequency, around):
    """Versions and variants get their own licence or none, whatever words are frequent."""
    scorer = licences.Scorer(licences.TEMPLATES, frequency, 10000, licences.LEAST)
    for text, want in SAID.items():
        found = [scorer.headers(r, {}) for r in scorer.regions(licences.folded(around.format(text).encode()))]
        got = max(found, default=(0.0, None, 0))[1]
        assert got == want or (frequency and got is None), text


def test_words_around_a_header_do_not_hide_it(spark):
    lines = {"Project released under the MIT License.": ("MIT", 1.0), "Copyright 2020 Foo Bar. Released under the MIT License.": ("MIT", 1.0),
             "This file is licensed under the Apache License, Version 2.0.": ("Apache-2.0", 1.0), "# Released under\n# the MIT License": ("MIT", 1.0),
             f"{' '.join(words(50, 3))} Licensed under CC BY-NC 4.0. {' '.join(words(50, 4))}": ("CC-BY-NC-4.0", 1.0),
             "Released under this license.": (None, 0.0)}
    for copies in (1, 20):  # equal proportions
        rows = [(t, "p") for t in [*lines, *[" ".join(words(30, 10 + k)) for k in range(40)]] for _ in range(copies)]
        got = {r.text: (r.header, round(r.cosine, 9)) for r in _with_text(spark, rows)}
        assert {t: got[t] for t in lines} == lines


def test_a_part_of_a_template_is_diluted_by_its_neighbours(spark):
    """Where nearly all documents say "the license", "MIT" alone in a sentence is no header; as a line of its own it is scored alone."""
    rows = [(f"the license {' '.join(words(20, k))}", "p") for k in range(40)] + [(f"{' '.join(words(9, 90))} at MIT {' '.join(words(9, 91))}", "p"), ("one two\nMIT License\nthree four", "p")]
    got = {r.text: r.header for r in _with_text(spark, rows)}
    assert got[rows[-2][0]] is None and got[rows[-1][0]] == "MIT"


def _with_text(spark, rows):
    docs = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(rows)], "doc_id long, text string, path string")
    return licences.licences(docs, F.col("path")).join(docs.select("doc_id", "text"), "doc_id").collect()


def test_other_words_weigh_by_their_frequency(spark):
    """A word inside a header lowers the cosine by its own document frequency."""
    lines = ["Released under the zebra MIT License.", "Released under the of MIT License."]
    rows = [(t, "p") for t in [*lines, *["of and"] * 38]]
    got = {r.text: r.cosine for r in _with_text(spark, rows)}
    n = Counter(w for t, _ in rows for w in {*re.findall(r"\w+", t.lower())})
    square = {w: (np.log(41 / (1 + n[w])) + 1) ** 2 for w in n}
    own = sum(square[w] for w in "released under the mit license".split())
    for t, w in zip(lines, ("zebra", "of"), strict=True):
        assert got[t] == pytest.approx((own / (own + square[w])) ** 0.5, abs=1e-9)


MIT_FILE = """Copyright (c) 2019 Jane Doe and the project's authors

Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""


def _below(name):
    return " ".join(words(5, sum(name.encode())))


def test_whole_licence_files_declare(spark):
    body = " ".join(words(200, 1))
    files = {"MIT": MIT_FILE} | {n: f"Copyright 2021 Foo Bar\n{t}" for n, (t,) in licences.whole_texts().items() if n != "MIT"}
    assert set(files) <= set(licences.TEMPLATES)
    rows = [x for n, t in files.items() for x in ((t, f"root/{n}"), (f"{body} {_below(n)}", f"root/{n}/src"))]
    rows += [(f"{body}\n{MIT_FILE[:200]}", "other"), (f"{body} child", "other/src")]
    got = {(r.dir, r.text): r for r in _with_text(spark, rows)}
    for n, t in files.items():
        own, below = got[f"root/{n}", t], got[f"root/{n}/src", f"{body} {_below(n)}"]
        assert (own.header, own.declares, own.licence, own.declared_in) == (n, True, n, None)
        assert (below.header, below.declares, below.licence, below.declared_in) == (None, False, n, f"root/{n}")
    assert not got["other", rows[-2][0]].declares and got["other/src", f"{body} child"].licence is None


def test_all_queries_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
