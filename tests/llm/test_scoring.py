import hashlib
import random
import textwrap
import zlib
from collections import Counter, defaultdict
from math import floor

import numpy as np
import pytest

from lexloom.llm import language, sketches
from lexloom.llm.language import gram_buckets, languages_of, letters, predict, train
from lexloom.llm.licenses import HINTS, MARKS, RULES, SENTENCES, license_scan
from lexloom.llm.mixing import OFFSET, mix, mixed_documents, n_words, source_targets
from lexloom.llm.quality import accepted, fit_quality, quality_scores
from lexloom.llm.text import WordHashes, text_shingles
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def quality_model(documents, spark, folder):
    folder = folder.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    return fit_quality(docs.filter("doc_id % 3 > 0"), labels), docs, labels


def test_quality_on_documents_that_were_not_learned(quality_model):
    model, docs, labels = quality_model
    scored = quality_scores(docs.filter("doc_id % 3 = 0"), model).join(labels, "doc_id").collect()
    assert len(scored) > 1000
    for kind, wanted in ((1, True), (0, False)):
        right = [row.kept == wanted for row in scored if row.quality == kind]
        assert len(right) > 150 and np.mean(right) >= 0.95
    assert all(0 <= row.score <= 1 and 0 <= row.text_score <= 1 and 0 <= row.metadata_score <= 1 for row in scored)


def test_quality_of_odd_rows(quality_model, odd_docs, no_docs, spark):
    model, _, labels = quality_model
    rows = quality_scores(odd_docs, model).collect()
    assert Counter(row.doc_id for row in rows) == Counter(row.doc_id for row in odd_docs.collect())
    assert all(row.kept == (row.score >= 0.5) for row in rows)
    kept = accepted(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(row.kept for row in rows)
    assert quality_scores(no_docs, model).count() == 0
    one_kind = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (1, 1, 1), (None, 1, 0), (7, None, 0), (99, 5, 0)], "doc_id long, quality int, toxic int")
    assert fit_quality(odd_docs, one_kind) is None and fit_quality(no_docs, labels) is None
    assert all(row.kept and row.score == 1 for row in quality_scores(odd_docs, None).collect())


def plain_targets(sizes, repeats=3):
    names = sorted((name for name in sizes if name is not None), key=lambda name: [ord(c) for c in name]) + [None] * (None in sizes)
    weight = {name: (1, 2, 3)[at % 3] for at, name in enumerate(names)}
    cut: dict = {}
    while True:
        rest = sum(sizes.values()) - sum(cut.values())
        open_weight = sum(weight[name] for name in names if name not in cut)
        target = cut | {name: rest * weight[name] / open_weight for name in names if name not in cut}
        over = [name for name in names if name not in cut and target[name] > repeats * sizes[name]]
        if not over:
            return target
        cut |= {name: repeats * sizes[name] for name in over}


def test_targets_by_hand(spark):
    sizes = {"b": 1000, "a": 10, "é": 5, "z": 40, "Z": 3, None: 7, "empty": 0}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    found = {row.source: row.target for row in source_targets(rows).collect()}
    assert found == pytest.approx(plain_targets(sizes))
    assert sum(found.values()) == pytest.approx(sum(sizes.values()))


def test_copies_by_hand(spark):
    chance = random.Random(5)
    rows = [(i, chance.choice(["a", "a", "a", "b", "c", None]), chance.choice([0, 1, 5, 5, 30, 200])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    found = {row.key0: row for row in mix(docs, [F.col("doc_id")], F.col("source"), F.col("size")).collect()}
    by = defaultdict(list)
    for doc_id, source, size in rows:
        by[source].append((size, hashlib.md5(str(doc_id).encode()).hexdigest(), doc_id))
    targets = plain_targets({source: sum(row[0] for row in own) for source, own in by.items()})
    for source, own in by.items():
        total, taken = sum(row[0] for row in own), 0
        rate = targets[source] / total
        for at, (size, _, doc_id) in enumerate(sorted(own), 1):
            assert found[doc_id].copies == floor(at * rate + OFFSET) - floor((at - 1) * rate + OFFSET)
            assert found[doc_id].copies <= 3 and found[doc_id].source_size == total
            taken += size * found[doc_id].copies
        assert abs(taken - targets[source]) <= 2 * 200


def test_mixing_of_odd_rows(odd_docs, no_docs):
    sizes = {row.doc_id: row.n for row in odd_docs.select("doc_id", n_words(F.col("text")).alias("n")).collect()}
    assert sizes[4] == sizes[5] == sizes[6] == 0 and sizes[7] == 2 and sizes[11] == 1
    made = mixed_documents(odd_docs)
    assert made.columns == odd_docs.columns
    chosen = mix(odd_docs, [F.col("doc_id")], F.col("source"), n_words(F.col("text")))
    assert made.count() == chosen.agg(F.sum("copies")).first()[0]
    assert sorted(map(str, made.collect())) == sorted(map(str, mixed_documents(odd_docs).collect()))
    assert mixed_documents(no_docs).count() == 0
    blank = odd_docs.filter("doc_id in (4, 5, 6)")
    assert mixed_documents(blank).count() == 0


def test_rules_and_sentences_fit():
    assert all(any(hint in words for hint in HINTS) for words in SENTENCES.values())
    assert len(set(MARKS.values())) == len(SENTENCES) and all(name in SENTENCES for _, _, names in RULES for name in names)


def test_license_notices(spark):
    apache = (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at\n  http://www.apache.org/licenses/LICENSE-2.0\n"
    )
    texts = {
        1: "Words.\nReleased under the MIT License.",
        2: "ALL  RIGHTS\treserved!\nOther words. Licensed under CC BY-NC 4.0.\n",
        3: apache,
        4: "We released under the MIT License.",
        5: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any "
        "later version.",
        6: None,
        7: "",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {row.doc_id: row for row in license_scan(docs).collect()}
    assert (found[1].licenses, found[1].kinds, found[1].n_known, found[1].first_sentence) == ("MIT", "permissive", 1, 1)
    assert found[2].licenses == "CC-BY-NC-4.0, all rights reserved" and found[2].identifiers == "all_rights / cc_by_nc_4"
    assert found[3].licenses == "Apache-2.0 notice" and found[3].n_known == 2
    assert found[5].licenses == "GPL-3.0-or-later notice" and found[5].kinds == "copyleft"
    for doc_id in (4, 6, 7):
        assert (found[doc_id].licenses, found[doc_id].n_known, found[doc_id].first_sentence) == ("", 0, None)


APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
CC_WORK = "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."


def test_license_notices_as_files_have_them(spark):
    """Notices in their licences' own wording, on long lines, wrapped, and wrapped behind comment signs."""
    notices = {
        "Apache-2.0 notice": (APACHE, 4), "MIT text": (MIT, 2), "GPL-3.0-or-later notice": (GPL3, 2), "LGPL-2.1-or-later notice": (LGPL, 3),
        "BSD text": (BSD, 3), "ISC text": (ISC, 1), "CC-BY-NC-SA-4.0": (CC_WORK, 1),
    }
    texts, wanted = {}, {}
    for name, (notice, n) in notices.items():
        wrapped = "\n".join(textwrap.fill(line, 72) for line in notice.split("\n"))
        for text in (notice, wrapped, *("\n".join(sign + line for line in wrapped.split("\n")) for sign in ("# ", " * ", "// ", "dnl "))):
            texts[len(texts)] = f"some code\n\n{text}\n\nmore code\n"
            wanted[len(wanted)] = (name, n)
    for tag, name in (("// SPDX-License-Identifier: MIT", "MIT"), ("/* SPDX-License-Identifier: GPL-2.0+ */", "GPL-2.0+")):
        texts[len(texts)] = f"{tag}\nint x;"
        wanted[len(wanted)] = (name, 1)
    texts[len(texts)] = MIT.replace("sublicense, and/or", "sublicense\n\nand/or").split("The above")[0]
    wanted[len(wanted)] = ("", 0)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {row.doc_id: (row.licenses, row.n_known) for row in license_scan(docs).collect()}
    assert found == wanted


def test_license_scan_of_odd_rows(odd_docs, no_docs):
    rows = license_scan(odd_docs).collect()
    assert Counter(row.doc_id for row in rows) == Counter(row.doc_id for row in odd_docs.collect())
    assert all(row.n_known == 0 and row.identifiers == "" for row in rows)
    assert license_scan(no_docs).count() == 0


def test_languages_by_plain_counting(documents):
    rows = documents.filter("lang is not null").select("doc_id", "lang", "text").collect()
    learned, asked = [row for row in rows if row.doc_id % 2], [row for row in rows if not row.doc_id % 2][:40]
    model = train(documents.filter("doc_id % 2 = 1").select("lang", "text"))
    assert model.languages == sorted({row.lang for row in learned})
    counts = {lang: Counter() for lang in model.languages}
    for row in learned:
        for codes in letters(row.text):
            counts[row.lang].update(gram_buckets(codes, model.bits).tolist())
    size = 1 << model.bits
    for row in asked:
        scores = {}
        for lang, own in counts.items():
            total, score = sum(own.values()) + 0.5 * size, np.log(sum(r.lang == lang for r in learned) / len(learned))
            for codes in letters(row.text):
                score += sum(np.log((own[bucket] + 0.5) / total) for bucket in gram_buckets(codes, model.bits).tolist())
            scores[lang] = score
        best = max(sorted(scores), key=scores.get)
        assert model.predict(row.text)[0] == best
        assert model.predict(row.text)[1] == pytest.approx(1 / sum(np.exp(s - scores[best]) for s in scores.values()), abs=1e-3)


def test_language_accuracy_on_held_out_documents(spark, folder):
    docs = spark.read.parquet(f"{folder.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = languages_of(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2) for row in rows)
    held = [row for row in rows if row.held_out and row.lang is not None]
    assert len(held) > 150 and np.mean([row.lang_pred == row.lang for row in held]) >= 0.97


def test_languages_of_odd_rows(odd_docs, no_docs, monkeypatch):
    rows = languages_of(odd_docs).collect()
    assert Counter(row.doc_id for row in rows) == Counter(row.doc_id for row in odd_docs.collect())
    by = {row.doc_id: row for row in rows}
    for doc_id in (4, 5, 6):
        assert (by[doc_id].lang_pred, by[doc_id].score) == ("und", 0.0)
    assert by[None].held_out is False and all(0 <= row.score <= 1 for row in rows)
    assert languages_of(no_docs).count() == 0
    unlearned = predict(odd_docs, train(no_docs)).collect()
    assert {row.lang_pred for row in unlearned} == {"und"}
    text = "Some words, ünd more " * 30
    whole = np.sort(np.concatenate([gram_buckets(codes, 12) for codes in letters(text)]))
    monkeypatch.setattr(language, "STRETCH", 100)
    assert len(np.concatenate([gram_buckets(codes, 12) for codes in letters(text)])) == pytest.approx(len(whole), rel=0.05)


def plain_shingles(text):
    words = text.encode().lower().split()
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_sketches_estimate_sets():
    chance, known = random.Random(3), WordHashes()
    for shared, own in ((900, 100), (300, 700), (0, 500), (20, 10), (50, 0)):
        both = [f"s{i}" for i in range(shared)]
        a, b = " ".join(both + [f"a{chance.random()}" for _ in range(own)]), " ".join(both + [f"b{chance.random()}" for _ in range(own)])
        x, y = plain_shingles(a), plain_shingles(b)
        p, q = (sketches.bottom(text_shingles(text.encode(), known)) for text in (a, b))
        assert sketches.resemblance(p, q) == pytest.approx(len(x & y) / len(x | y), abs=0.13)
        assert sketches.containment(p, q) == pytest.approx(len(x & y) / len(x), abs=0.2)
        assert sketches.distinct(sketches.merge([p, q])) == pytest.approx(len(x | y), rel=0.35)
        assert (sketches.decode(sketches.encode(p)) == p).all() and sketches.resemblance(p, p) == 1
    assert sketches.encode(np.zeros(0, np.uint64)) == "" and len(sketches.decode("")) == 0


def test_sketches_merge_in_tables_as_in_memory(spark):
    chance, known = random.Random(8), WordHashes()
    parts = [(i % 3, " ".join(str(chance.randrange(400)) for _ in range(300))) for i in range(12)] + [(7, ""), (8, "a b")]
    made = [(key, sketches.encode(sketches.bottom(text_shingles(text.encode(), known)))) for key, text in parts]
    found = {row.key: row.fingerprint for row in sketches.merged(spark.createDataFrame(made, "key int, fingerprint string"), "key").collect()}
    for key in {key for key, _ in made}:
        assert found[key] == sketches.encode(sketches.merge([sketches.decode(text) for at, text in made if at == key]))


def plain_edits(rows):
    rows = sorted(rows)
    for (doc_id, text), (_, other) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        yield doc_id, text, text[: len(text) - half] + other[:half], other


@pytest.mark.parametrize("range_bytes", [sketches.RANGE_BYTES, 20_000])
def test_edited_fingerprints_by_plain_sets(documents, range_bytes, monkeypatch):
    monkeypatch.setattr(sketches.with_next, "__defaults__", (range_bytes,))
    found = {row.doc_id: row for row in sketches.edited_fingerprints(documents).collect()}
    rows, known, alike = [(row.doc_id, row.text) for row in documents.collect()], WordHashes(), []
    assert len(found) == len(rows)
    for doc_id, text, edited, other in plain_edits(rows):
        row = found[doc_id]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for own, words in ((row.fingerprint, text), (row.edited_fingerprint, edited)):
            assert own == sketches.encode(sketches.bottom(text_shingles(words.encode(), known)))
        for near, words in ((row.near_edited, edited), (row.near_next, other)):
            x, y = plain_shingles(text), plain_shingles(words)
            alike.append(near - (len(x & y) / len(x | y) if x | y else 1))
    assert np.abs(alike).max() < 0.2 and np.std(alike) < 0.04


def test_fingerprints_of_odd_rows(odd_docs, no_docs):
    rows = sketches.edited_fingerprints(odd_docs).collect()
    assert Counter(row.doc_id for row in rows) == Counter(row.doc_id for row in odd_docs.collect())
    by = {row.doc_id: row for row in rows}
    assert by[4].fingerprint == by[5].fingerprint == by[6].fingerprint == "" and by[4].n_chars == 0
    assert by[1].fingerprint == by[2].fingerprint and by[7].fingerprint == by[8].fingerprint
    assert sketches.edited_fingerprints(no_docs).count() == 0
    alone = sketches.edited_fingerprints(odd_docs.filter("doc_id = 7")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1
    found = sketches.fingerprints(odd_docs).collect()
    assert len(found) == odd_docs.count() and next(row.n_distinct for row in found if row.doc_id == 7) == 1


def test_no_licence_rule_stands_behind_its_own_beginning(spark):
    from lexloom.llm.licenses import RULES, license_scan

    for at, (_, _, names) in enumerate(RULES):
        assert not any(names[: len(before)] == before for _, _, before in RULES[:at] if len(before) < len(names))
    notice = (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    )
    assert license_scan(spark.createDataFrame([(1, notice)], "doc_id long, text string")).first().licenses == "GPL-2.0-or-later notice"
