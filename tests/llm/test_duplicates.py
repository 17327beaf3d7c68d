import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm.cuts import LINE, SENTENCE, minimal_windows, parts, replaced
from lexloom.llm.graph import components
from lexloom.llm.line_runs import line_deduplicated
from lexloom.llm.minmax import near_duplicates
from lexloom.llm.multi_index import fit_index, near_vectors, unit_rows
from lexloom.llm.sentence_spans import passages_removed


def roots(nodes, links):
    parent = {node: node for node in nodes}

    def root(node):
        while parent[node] != node:
            node = parent[node]
        return node

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {node: root(node) for node in nodes}


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    nodes = {node for link in links for node in link} - {300}
    assert {row.id: row.component for row in found.collect()} == roots(nodes, [link for link in links if link != (300, 300)])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(texts):
    sets = {doc_id: shingle_set(text) for doc_id, text in texts.items()}
    ids = sorted(sets)
    links = [
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    return sets, roots(ids, links)


def test_edited_copies_of_one_text_by_brute_force(spark):
    """A group in which many pairs lie on either side of the limit, with chains over others and exact copies."""
    chance = random.Random(1)
    words, texts = [f"w{i}" for i in range(160)], {}
    for doc_id in range(90):
        own = list(words)
        for _ in range(chance.choice([0, 1, 2, 3, 4, 6, 9])):
            own[chance.randrange(160)] = f"x{doc_id}_{chance.randrange(1000)}"
        texts[doc_id] = " ".join(own)
    texts |= {100 + i: texts[i] for i in range(10)} | {200: None, 201: "", 202: "a B", 203: "A b", 204: "a"}
    sets, named = brute(texts)
    rows = near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {row.doc_id: (row.n_shingles, row.component_id, row.kept) for row in rows} == {
        doc_id: (len(sets[doc_id]), named[doc_id], named[doc_id] == doc_id) for doc_id in texts
    }


def test_odd_rows_of_near_duplicates(odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    named = defaultdict(set)
    for row in rows:
        named[row.doc_id].add((row.component_id, row.kept))
    assert named[1] == {(1, True)} and named[2] == {(1, False)} and named[3] == {(1, False)} and named[8] == {(7, False)}
    assert named[4] == {(4, True)} and named[12] == {(12, True)} and (None, True) in named[None]
    assert near_duplicates(no_docs).count() == 0


def plain_cut(texts, end, least_words, least_parts, lowered):
    """Every window of parts, of any length, that stands earlier too loses its parts."""
    cut = {key: parts((text or "").encode(), end) for key, text in texts.items()}
    seen, gone = set(), defaultdict(set)
    for key in sorted(texts):
        bodies = [b" ".join((part.lower() if lowered else part).split()) for part in cut[key]]
        filled = [at for at, body in enumerate(bodies) if body]
        for start in range(len(filled)):
            for stop in range(start + least_parts, len(filled) + 1):
                body = tuple(bodies[at] for at in filled[start:stop])
                if sum(len(one.split()) for one in body) < least_words:
                    continue
                if body in seen:
                    gone[key].update(filled[start:stop])
                seen.add(body)
    return {key: b"".join(part for at, part in enumerate(cut[key]) if at not in gone[key]).decode() for key in texts}


@pytest.mark.parametrize("least_words,least_parts", [(1, 1), (7, 1), (5, 2), (12, 3), (1, 2)])
def test_minimal_windows_cover_what_all_windows_cover(least_words, least_parts):
    chance = random.Random(least_words)
    for _ in range(200):
        words = [chance.randint(1, 6) for _ in range(chance.randint(0, 12))]
        low, high = sorted((chance.randint(0, len(words)), chance.randint(0, len(words))))
        wide = high - low >= least_parts and sum(words[low:high]) >= least_words
        covered = {
            at for start, length in minimal_windows(words, least_words, least_parts) if low <= start and start + length <= high
            for at in range(start, start + length)
        }
        assert covered == (set(range(low, high)) if wide else set())


def shuffled_texts(unit, end, seed):
    chance = random.Random(seed)
    pool = [unit.format(" ".join(f"u{i}w{j}" for j in range(chance.randint(1, 6)))) for i in range(12)]
    return {doc_id: end.join(chance.choice(pool) for _ in range(chance.randint(0, 14))) for doc_id in range(40)}


def test_line_runs_by_brute_force(spark):
    texts = shuffled_texts("{}", "\n", 3)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {row.doc_id: row.text for row in line_deduplicated(docs, least_words=9).select("row.doc_id", "text").collect()}
    assert found == plain_cut(texts, LINE, 9, 1, False)


def test_short_lines_that_repeat_go(spark):
    """Later copies of runs of three words or more go, also where nothing beside them repeats; shorter ones stay."""
    texts = {
        1: "one\nSubscribe to news\ntwo",
        2: "three\nSubscribe  to news\nfour\nSee also\nfive",
        3: "Subscribe to news\nSee also\nsix\nseven\neight",
        4: "nine\nseven\neight\nten\nsix\nseven\neight\neleven",
        5: "第一章 \n请订阅我们的新闻\n甲",
        6: "请订阅我们的新闻\n第一章\n乙",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {row.doc_id: row.text for row in line_deduplicated(docs).select("row.doc_id", "text").collect()}
    assert found == {
        1: texts[1],
        2: "three\nfour\nSee also\nfive",
        3: "See also\nsix\nseven\neight",
        4: "nine\nseven\neight\nten\neleven",
        5: texts[5],
        6: "第一章\n乙",
    }


def test_sentence_spans_by_brute_force(spark):
    texts = shuffled_texts("{}.", " ", 4)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    cut = passages_removed(docs, least_sentences=2, least_words=7)
    assert {row.doc_id: row.text for row in cut.select("row.doc_id", "text").collect()} == plain_cut(texts, SENTENCE, 7, 2, True)


@pytest.mark.parametrize("operator", [line_deduplicated, passages_removed])
def test_odd_rows_of_cuts(spark, odd_docs, no_docs, operator):
    cut = operator(odd_docs)
    rows = cut.collect()
    assert len(rows) == odd_docs.count()
    by = defaultdict(list)
    for row in rows:
        by[row.row.doc_id].append(row)
    assert [row.text for row in by[4]] == [None] and [row.text for row in by[5]] == [""] and [row.text for row in by[6]] == [" \n\t "]
    assert len(by[2]) == 2 and by[2][0].text == by[2][1].text
    left = replaced(cut, odd_docs, "text", "n_chars")
    assert left.columns == odd_docs.columns
    assert all(row.n_chars == (None if row.text is None else len(row.text)) for row in left.collect())
    assert operator(no_docs).count() == 0


def test_second_copy_of_a_passage_goes(spark):
    passage = "The first sentence of it has quite some words here. The second one has even more words than that. A third ends it."
    docs = spark.createDataFrame([(1, f"Before it. {passage} After."), (2, f"{passage} Other end."), (3, "Nothing alike.")], "doc_id long, text string")
    cut = {row.doc_id: row.text for row in passages_removed(docs).select("row.doc_id", "text").collect()}
    assert cut == {1: f"Before it. {passage} After.", 2: "Other end.", 3: "Nothing alike."}


def test_long_sentences_and_sentences_without_spaces(spark):
    """One long sentence between other neighbours, a passage in mid-sentence, a line without end marks, and Chinese prose."""
    first, second = (" ".join(f"{name}{i}" for i in range(n)) for name, n in (("a", 28), ("b", 30)))
    prose = "春天来了花园里的花都开了孩子们在草地上奔跑老人坐在长椅上晒太阳一切都很安静美好。"
    texts = {
        1: f"One here. {second}. Two there.",
        2: f"Three words go before {first}. {second}. Four.",
        3: f"Other words before {first}. {second}. Five.",
        4: f"Six\n{first}\nseven",
        5: f"Eight\n{first}\nnine",
        6: f"今天很好。{prose}我们回家。",
        7: f"昨天下雨。{prose}他们没来。",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    cut = {row.doc_id: row.text for row in passages_removed(docs).select("row.doc_id", "text").collect()}
    assert cut == {
        1: texts[1],
        2: f"Three words go before {first}. Four.",
        3: f"Other words before {first}. Five.",
        4: texts[4],
        5: "Eight\nnine",
        6: texts[6],
        7: "昨天下雨。他们没来。",
    }


def vector_links(rows):
    links = []
    for n, (a, x, label) in enumerate(rows):
        for b, y, other in rows[n + 1 :]:
            if label is not None and label == other and x is not None and y is not None and len(x) == len(y):
                x, y = np.array(x, float), np.array(y, float)
                if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any():
                    if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                        links.append((a, b))
    return links


def test_vectors_by_brute_force(spark):
    random_state = np.random.default_rng(2)
    centres = random_state.standard_normal((30, 16))
    rows = []
    for vec_id in range(600):
        vector = centres[vec_id % 30] + random_state.standard_normal(16) * random_state.choice([0.1, 0.2, 0.3])
        rows.append((vec_id, [float(v) for v in vector], vec_id % 3 if vec_id % 50 else None))
    rows += [(1000 + i, rows[1][1], 1) for i in range(20)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0, None], 1), (2004, [], 1)]
    rows += [(2005, [1e-200] * 16, 1), (2006, [1e200] * 16, 1), (2007, [float("inf")] * 16, 1), (2008, [1.0] * 3, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    usable = [(i, None if v is None or None in v else v, label) for i, v, label in rows]
    usable = [(i, [x * 1e200 for x in v] if i == 2005 else [x / 1e200 for x in v] if i == 2006 else v, label) for i, v, label in usable]
    links = vector_links(usable)
    named = roots([row[0] for row in rows], links)
    counts = defaultdict(int)
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    found = near_vectors(frame, block=64).collect()
    assert {row.vec_id: (row.n_links, row.component_id, row.kept) for row in found} == {
        i: (counts[i], named[i], named[i] == i) for i, _, _ in rows
    }
    assert near_vectors(frame.limit(0)).count() == 0


def test_index_recall():
    random_state = np.random.default_rng(4)
    sample = unit_rows(random_state.standard_normal((4000, 64)))
    index = fit_index(sample, 4000, 0.93, recall=0.95)
    noise = random_state.standard_normal(sample.shape)
    noise -= (noise * sample).sum(axis=1, keepdims=True) * sample
    partners = unit_rows(0.93 * sample + (1 - 0.93**2) ** 0.5 * unit_rows(noise))
    cells, own = index.cells(partners), index.cells(sample)
    found = [b in there or a in back for a, b, there, back in zip(own, cells, index.traverse(sample), index.traverse(partners), strict=True)]
    assert np.mean(found) >= 0.93
    assert np.mean([len(there) for there in index.traverse(sample)]) < 0.5 * len(index.codes[0]) * len(index.codes[1])


def test_vectors_with_repeats_null_ids_and_clashing_columns(spark):
    """Repeated rows are rows of their own; rows without an id or label link with nothing; columns of any name."""
    near = [1.0, 0.2, 0.0]
    rows = [(1, near, 0), (1, near, 0), (2, [1.0, 0.25, 0.0], 0), (None, near, 0), (None, None, 0), (3, near, None), (4, near, 1)]
    rows += [(5, [0.0, 0.0, 0.0], 0), (6, [1.0, None, 0.0], 0), (7, [1.0, float("nan"), 0.0], 0), (8, [], 0), (9, [1.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    names = ["id", "label_", "dim", "digest", "vector", "cell", "visits", "copies", "n", "to", "own", "member_blocks", "component_id", "kept"]
    frame = frame.select("*", *(F.lit("x").alias(name) for name in names))
    found = sorted((tuple(row) for row in near_vectors(frame).collect()), key=str)
    linked = [(1, 2, 1, True)] * 2 + [(2, 2, 1, False)]
    alone = [(at, 0, at, True) for at in (3, 4, 5, 6, 7, 8, 9)] + [(None, 0, None, True)] * 2
    assert found == sorted(linked + alone, key=str)
