import random
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import pytest
from test_duplicates import brute, plain_cut, shingle_set
from test_packing import check_places
from test_scoring import plain_targets

from lexloom.llm.cuts import LINE
from lexloom.llm.line_runs import LEAST_WORDS
from lexloom.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="session")
def stages(spark, folder):
    """What each stage is given and returns."""
    docs, made = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        found = stage(spark, docs, folder).cache()
        made[name] = docs, found
        docs = found
    return made


def texts(docs):
    return {row.doc_id: row.text for row in docs.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(stages):
    for name, (docs, made) in list(stages.items())[:-1]:
        assert made.columns == docs.columns, name


def test_quality_stage_keeps_documents_as_they_are(stages, spark, folder):
    docs, made = stages["quality classifier"]
    before, after = texts(docs), texts(made)
    assert 0.7 * len(before) < len(after) < len(before) and all(before[doc_id] == text for doc_id, text in after.items())
    labels = {row.doc_id: row.quality for row in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = [quality for doc_id, quality in labels.items() if doc_id in after]
    assert kept.count(0) <= 0.1 * len(kept)


def test_line_stage_by_brute_force(stages):
    docs, made = stages["line dedup"]
    before, after = texts(docs), texts(made)
    wanted = plain_cut(before, LINE, LEAST_WORDS, 1, False)
    assert after == {doc_id: text for doc_id, text in wanted.items() if text.strip() or text == before[doc_id]}
    assert all(row.n_chars == len(row.text) for row in made.collect())


def test_near_stage_by_brute_force(stages):
    docs, made = stages["near dedup"]
    before, after = texts(docs), texts(made)
    _, named = brute(before)
    assert after == {doc_id: text for doc_id, text in before.items() if named[doc_id] == doc_id}


def test_near_stage_links_from_four_fifths(spark, folder):
    """Brute force at 0.8, over pairs from below 0.8 to above 0.85."""
    chance = random.Random(5)
    texts = {}
    for group in range(12):
        words = [f"g{group}w{i}" for i in range(124)]
        texts[2 * group] = " ".join(words)
        for at in chance.sample(range(2, 120, 6), 2 + group % 3):
            words[at] = f"x{group}_{at}"
        texts[2 * group + 1] = " ".join(words)
    sets = {doc_id: shingle_set(text) for doc_id, text in texts.items()}
    shares = {b: len(sets[b - 1] & sets[b]) / len(sets[b - 1] | sets[b]) for b in range(1, 24, 2)}
    assert any(share < 0.8 for share in shares.values()) and any(0.8 <= share < 0.85 for share in shares.values())
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    made = pipeline.near_dedup(spark, docs, folder)
    assert {row.doc_id for row in made.collect()} == set(texts) - {b for b, share in shares.items() if share >= 0.8}


def test_mixing_stage_comes_near_its_targets(stages):
    docs, made = stages["source mixing"]
    rows = docs.collect()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for row in rows:
        n = len(row.text.encode().split())
        sizes[row.source] += n
        largest[row.source] = max(largest[row.source], n)
    copies = Counter(row.doc_id for row in made.collect())
    for row in rows:
        taken[row.source] += copies[row.doc_id] * len(row.text.encode().split())
        assert copies[row.doc_id] <= 3
    for source, target in plain_targets(sizes).items():
        assert abs(taken[source] - target) <= 2 * largest[source]


def test_packing_stage_packs_every_copy(stages):
    docs, made = stages["best-fit packing"]
    rows = made.collect()
    check_places(rows)
    assert Counter(row.doc_id for row in rows if row.piece == 0) == Counter(row.doc_id for row in docs.collect())


def test_run_gives_the_rows_of_the_stages(stages, spark, folder):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    wanted = Counter(map(tuple, stages["best-fit packing"][1].select(*columns).collect()))
    assert Counter(map(tuple, pipeline.run(spark, folder).select(*columns).collect())) == wanted


def test_stages_take_odd_rows(spark, odd_docs, no_docs, folder):
    for docs in (odd_docs, no_docs):
        for _, stage in pipeline.STAGES[:-1]:
            made = stage(spark, docs, folder)
            assert made.columns == docs.columns and made.count() <= 3 * docs.count()


def test_thirteen_operators_are_registered():
    assert sorted(int(name.split("_")[0][2:]) for name in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert [name for name, _ in pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "source mixing", "best-fit packing"]
