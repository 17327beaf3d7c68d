import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import search
from lexloom.operators.embed import TokenHashEmbedder, embed, sparse_text, vector_error

DIM = 16


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = rng.integers(-3, 4, size=(400, DIM)).astype(float)
    rows[50:180] = rows[7]  # A third of all rows are copies of one.
    rows[200] = 0.0
    queries = np.vstack([rows[:30], np.zeros((1, DIM))])
    vectors = spark.createDataFrame([(f"v{i:03d}", r.tolist()) for i, r in enumerate(rows)], "id string, vector array<double>")
    asked = spark.createDataFrame([(f"q{i}", r.tolist()) for i, r in enumerate(queries)], "query_id string, vector array<double>")
    return rows, queries, vectors.repartition(5), asked


def brute_force(rows, queries, k):
    found = set()
    for q, query in enumerate(queries):
        scored = []
        for i, row in enumerate(rows):
            size = np.sqrt(row @ row) * np.sqrt(query @ query)
            if size > 0:
                scored.append((-np.floor((1 + row @ query / size) * 1e6 + 0.5) / 1e6, f"v{i:03d}"))
        found |= {(f"q{q}", rank, i, round(-s, 6)) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return found


def collected(frame):
    return {(r.query_id, r["rank"], r.id, round(r.score, 6)) for r in frame.collect()}


def test_top_k_with_ties_copies_and_zero_vectors(data):
    rows, queries, vectors, asked = data
    assert collected(search.top_k(vectors, asked, DIM, 10)) == brute_force(rows, queries, 10)


def test_more_queries_than_are_sent_are_joined_with_groups_of_vectors(data, monkeypatch):
    """One job for any number of blocks, small ones here, and no block of queries in the driver."""
    rows, queries, vectors, asked = data
    monkeypatch.setattr(search, "block_rows", lambda dim: 9)
    for limit, join in ((7 * 8 * DIM, "SortMergeJoin"), (1 << 20, "BroadcastHashJoin")):
        found = search.top_k(vectors, asked, DIM, 4, block_bytes=limit)
        assert join in found._jdf.queryExecution().toString()
        assert collected(found) == brute_force(rows, queries, 4)


def test_a_cell_holds_a_bounded_number_of_queries_and_vectors(data, monkeypatch):
    """More blocks on either side give more tasks, not larger ones."""
    rows, queries, vectors, asked = data
    monkeypatch.setattr(search, "block_rows", lambda dim: 3)
    seen = []
    scored = search.scored_blocks
    monkeypatch.setattr(search, "scored_blocks", lambda pairs, *rest: seen.append(pairs) or scored(pairs, *rest))
    assert collected(search.top_k(vectors, asked, DIM, 4, block_bytes=0)) == brute_force(rows, queries, 4)
    cells = [len(ids) for ids in seen[0].groupBy("cell").agg(F.collect_set("query_block").alias("q")).toPandas()["q"]]
    assert len(cells) > 4 and seen[0].rdd.getNumPartitions() >= len(cells)


def test_queries_that_a_task_cannot_hold_are_not_sent(data, monkeypatch):
    """Each would be told of its best hits again for every block of vectors."""
    rows, queries, vectors, asked = data
    monkeypatch.setattr(search, "block_rows", lambda dim: 9)
    monkeypatch.setattr(search, "QUERIES_HELD", 2)
    found = search.top_k(vectors, asked, DIM, 4)
    assert "SortMergeJoin" in found._jdf.queryExecution().toString()
    assert collected(found) == brute_force(rows, queries, 4)


def test_no_file_holds_more_blocks_than_a_reader_can(data, monkeypatch):
    """A reader of wide rows holds those of a file at once, so that files of all of a task's blocks grow with the input."""
    rows, queries, vectors, asked = data
    monkeypatch.setattr(search, "block_rows", lambda dim: 3)
    monkeypatch.setattr(search, "BLOCKS_PER_FILE", 4)
    stored, write = {}, search.written
    monkeypatch.setattr(search, "written", lambda df, name, *rest: stored.setdefault(name, write(df, name, *rest)))
    assert collected(search.top_k(vectors.coalesce(1), asked.coalesce(1), DIM, 4, block_bytes=1)) == brute_force(rows, queries, 4)
    for name, least in (("blocks", 100), ("queries", 10)):
        per_file = [r["count"] for r in stored[name].groupBy(F.input_file_name()).count().collect()]
        assert sum(per_file) >= least and max(per_file) <= 4


def test_blocks_are_stored_in_the_fewest_bytes_that_hold_them():
    for values, size in (([[1.0, 255.0]], 1), ([[0.5, -3.0]], 4), ([[0.1, 1.0]], 8), ([[256.0, 1e300]], 8)):
        matrix = np.array(values)
        raw = search.narrow(matrix).tobytes()
        assert len(raw) == 2 * size and (search.matrix_of_block(raw, 1, 2) == matrix).all()


def test_fewer_rows_than_k(data):
    rows, queries, vectors, asked = data
    few = vectors.filter("id < 'v003'")
    assert collected(search.top_k(few, asked, DIM, 10)) == brute_force(rows[:3], queries, 10)


def test_vectors_that_cannot_be_indexed_are_passed_over(spark, data):
    rows, queries, vectors, asked = data
    bad = [[1.0] * (DIM - 1), [1.0] * (DIM + 1), None, [None] + [1.0] * (DIM - 1), [float("nan")] * DIM, [float("inf")] * DIM]
    added = spark.createDataFrame([(f"a{i}", v) for i, v in enumerate(bad)], "id string, vector array<double>")
    ill_asked = added.withColumnRenamed("id", "query_id")
    found = search.top_k(vectors.unionByName(added).coalesce(2), asked.unionByName(ill_asked), DIM, 10)
    assert collected(found) == brute_force(rows, queries, 10)


def test_an_id_that_repeats_is_one_query_in_any_number_of_blocks(data):
    rows, queries, vectors, asked = data
    again = asked.unionByName(asked.withColumn("vector", F.reverse("vector"))).unionByName(asked)
    once = collected(search.top_k(vectors, again, DIM, 3))
    assert len(once) == 3 * (len(queries) - 1)  # The zero vector finds nothing.
    assert collected(search.top_k(vectors, again, DIM, 3, block_bytes=8 * DIM * 4)) == once


def test_nothing_to_search_or_ask(data):
    _, _, vectors, asked = data
    assert search.top_k(vectors.limit(0), asked, DIM).count() == 0
    assert search.top_k(vectors, asked.limit(0), DIM).count() == 0


def test_single_query_is_the_same(data):
    rows, queries, vectors, _ = data
    found = search.nearest(vectors, F.lit(queries[2].tolist()), 10).collect()
    expected = sorted((rank, i, s) for q, rank, i, s in brute_force(rows, queries[2:3], 10))
    assert [(r.id, round(r.score, 6)) for r in found] == [(i, s) for _, i, s in expected]


def test_single_query_passes_over_bad_vectors(spark):
    vectors = [[1.0, 0.0], [float("nan"), 1.0], [None, 1.0], [1.0], [0.0, 0.0], [float("inf"), 0.0], None]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id int, vector array<double>")
    assert [(r.id, r.score) for r in search.nearest(frame, F.lit([2.0, 0.0]), 10).collect()] == [(0, 2.0)]


def test_token_hash_embedding(spark):
    texts = spark.createDataFrame([("a", "The the, THE 42"), ("b", ""), ("c", "é -")], "id string, text string")
    rows = {r.id: r for r in embed(texts, "id", "text", TokenHashEmbedder(64)).collect()}
    assert sum(rows["a"].vector) == 4 and max(rows["a"].vector) == 3 and len(rows["a"].vector) == 64
    assert sum(rows["b"].vector) == 0 and sum(rows["c"].vector) == 0


def test_vector_errors(spark):
    vectors = [[1.0, 2.0], [1.0], [0.0, 0.0], [float("nan"), 1.0], [None, 1.0], None]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "i int, v array<double>")
    codes = [r[0] for r in frame.orderBy("i").select(vector_error(F.col("v"), 2)).collect()]
    assert codes == [None, "wrong_dimension", "zero_vector", "bad_element", "bad_element", "no_vector"]


def test_sparse_text(spark):
    frame = spark.createDataFrame([([0.0, 2.0, 0.0, 1.0],)], "v array<double>")
    assert frame.select(sparse_text(F.col("v"))).first()[0] == "1:2 3:1"


def test_vectors_are_judged_as_whole_arrays(spark):
    """Without a lambda, which Spark would interpret for every element."""
    nan, inf = float("nan"), float("inf")
    cases = [(None, "no_vector"), ([1.0], "wrong_dimension"), ([nan, 0.0], "bad_element"), ([None, 1.0], "bad_element"), ([None, nan], "bad_element"),
             ([0.0, -0.0], "zero_vector"), ([-1.0, 0.0], None), ([0.0, 1e-300], None), ([inf, -inf], None)]
    rows = spark.createDataFrame([(at, vector) for at, (vector, _) in enumerate(cases)], "at int, vector array<double>")
    for kind in ("array<double>", "array<float>"):
        found = rows.filter("at <> 7").select("at", vector_error(F.col("vector").cast(kind), 2).alias("code"))
        assert {row.at: row.code for row in found.collect()} == {at: code for at, (_, code) in enumerate(cases) if at != 7}
    empty = spark.createDataFrame([([],)], "vector array<double>").select(vector_error(F.col("vector"), 0))
    assert empty.first()[0] == "zero_vector"
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


def counted(rng, rows, dim):
    """Bags of words: some with large counts, some long, some the same."""
    made = rng.poisson(0.05, size=(rows, dim)).astype(float)
    made[::7] += rng.poisson(2.0, size=(len(made[::7]), dim))
    made[3, :4], made[4, 5], made[rows // 2 :: 5] = 300.0, 70_000.0, made[1]
    return made


def test_counts_are_stored_without_their_zeros():
    rng = np.random.default_rng(5)
    sparse = (rng.random((40, 300)) < 0.03) * rng.integers(1, 400, size=(40, 300)).astype(float)
    sparse[:, 7] = 1.0
    raw = search.stored(sparse)
    assert len(raw) < sparse.size / 5 and (search.matrix_of_block(raw, 40, 300) == sparse).all()
    for other in (sparse * 0.5, -sparse, sparse * 1000, sparse + 1, np.eye(2, 200_000)[:, ::-1]):
        assert (search.matrix_of_block(search.stored(other), *other.shape) == other).all()


@pytest.mark.parametrize("rows", (4, 9, 200))
def test_counts_are_scored_as_whole_matrices_are(rows):
    rng = np.random.default_rng(rows)
    for k in (1, 10):
        vectors, queries = counted(rng, rows + 5, 128), counted(rng, 70, 128)
        vectors[4, 5] = queries[4, 5] = 60_000.0
        vectors, queries = vectors[vectors.any(axis=1)], queries[queries.any(axis=1)]
        ids, whole = np.array([f"v{i * 37 % len(vectors):03d}" for i in range(len(vectors))]), search.Best(len(queries), k)
        whole.add(ids, search.score_block(vectors, search.row_norms(vectors), queries, search.row_norms(queries)))
        sums = search.Queries(np.arange(len(queries)).astype(str), search.pressed(np.hstack([queries, np.zeros((len(queries), 900))])), 1028, k)
        for part in (slice(0, rows // 2), slice(rows // 2, None)):
            block = search.Vectors(ids[part], search.pressed(np.hstack([vectors[part], np.zeros((len(vectors[part]), 900))])), 1028)
            assert block.parts
            sums.meet(block)
        found = [sorted(zip(best.query.tolist(), best.ids.tolist(), best.score.tolist(), strict=True)) for best in (whole, sums.best)]
        assert found[0] == found[1]


def test_bags_of_words_move_in_few_blocks_and_to_few_cells(spark, monkeypatch):
    """What is moved grows with the blocks of one side times the groups of the other; blocks were of 256 vectors of 1,024."""
    texts = [(f"{i}", f"{i} statute {i % 41} of {i % 97} and {i % 13}") for i in range(1500)]
    vectors = embed(spark.createDataFrame(texts, "id string, text string").coalesce(1), "id", "text", TokenHashEmbedder())
    asked = vectors.withColumnRenamed("id", "query_id").filter("query_id % 3 = 0")
    stored, write = {}, search.written
    monkeypatch.setattr(search, "written", lambda df, name, *rest: stored.setdefault(name, write(df, name, *rest)))
    sent = collected(search.top_k(vectors, asked, 1024))
    dealt = collected(search.top_k(vectors, asked, 1024, block_bytes=0))
    assert len(sent) == 5000 and dealt == sent
    assert stored["blocks"].count() == 1


def test_a_task_is_told_of_the_queries_once(data, monkeypatch):
    """They came with every block of vectors, so that most of what a task read was queries."""
    rows, queries, vectors, asked = data
    monkeypatch.setattr(search, "block_rows", lambda dim: 9)
    seen, scored = [], search.scored_blocks
    monkeypatch.setattr(search, "scored_blocks", lambda pairs, *rest: seen.append(pairs) or scored(pairs, *rest))
    assert collected(search.top_k(vectors, asked, DIM, 4)) == brute_force(rows, queries, 4)
    told = seen[0].select((F.col("block") % search.FIRST).alias("at"), "query_block").collect()
    assert {row.at == 0 for row in told if row.query_block is not None} == {True}
    assert len([row for row in told if row.query_block is None]) >= 30
