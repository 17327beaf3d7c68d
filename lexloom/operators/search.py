"""Cosine nearest neighbours of many queries, block by block.

Queries and vectors are packed into blocks, a matrix in one row of a table each. A task scores a block of queries against a
block of vectors as one matrix product and keeps the k best per query; what is left is merged by query. When all the
queries are few enough for a task to hold, their blocks are sent to where the vectors lie, and no vector moves. When they are many, the blocks of
both are dealt to groups of bounded size, and each pair of groups is a cell: a task's work, whatever their number. All
cells are one job. Nothing passes through the driver's Python.

Each group of vectors is moved once for each group of queries, and the other way round, and each task tells of the k best of
all its queries. So blocks hold as many rows as their bytes allow, counts are stored without their zeros, and there are no
more groups than bound a task or than keep all cores at work: the rows that are moved would grow with the product otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.counts import Asked, parts_of, pressed, spread_out, unpressed, wanted
from lexloom.functions.vectors import cosine_score, row_norms, score_block
from lexloom.operators.embed import Embedder, embed
from lexloom.params import TOP_K
from lexloom.session import ship_package, written

# All queries together may be sent to the vectors up to this size.
BLOCK_BYTES = 64 * 1024 * 1024
# A block is one row, closed at so many bytes or vectors; a step scores at most so many pairs at once.
ROW_BYTES, LEAST_ROWS, MOST_ROWS = 512 * 1024, 256, 4096
PAIRS_PER_STEP = 2_000_000
# Blocks in a group, of vectors and of queries, and full blocks of queries whose best hits a task holds at a time.
VECTOR_BLOCKS, QUERY_BLOCKS, QUERIES_HELD = 128, 64, 64
# Tasks that vectors are scanned by where queries are sent to them, and cells at least, for each core.
TASKS_PER_CORE, CELLS_PER_CORE = 3, 2
# Partitions for each cell, so that few of them get more than one by their hashes.
PARTITIONS_PER_CELL = 3
# Blocks in a stored file, which a reader holds all at once.
BLOCKS_PER_FILE = 32
MERGE_SHARES = 16
# Hits that a task merges.
HITS_PER_TASK = 1_000_000
# Numbers of blocks for each task, whose first block has the first of them.
FIRST = 1 << 32
HITS = pa.schema([("query_id", pa.string()), ("id", pa.string()), ("score", pa.float64())])
BLOCK = "block long, ids array<string>, matrix binary"
# What the numbers of a block are stored as.
KINDS = (np.uint8, np.float32, np.float64)

Matrix = Callable[[pa.RecordBatch], np.ndarray]


class Best:
    """The k best rows seen so far for each query: highest score first, then smallest id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.floor = np.full(queries, -np.inf)
        self.last = np.full(queries, "")
        self.query = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0)
        self.ids = np.zeros(0, dtype="U1")

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        floor = self.floor
        if scores.shape[1] > self.k and np.isneginf(floor).any():
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        query, row = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        self.add_some(query, ids[row], scores[query, row])

    def add_some(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Hits one by one, in any order; those below a query's k best are passed over."""
        # A row that only equals a full query's last score must come before its last id; copies mostly end here.
        better = (score > self.floor[query]) | ((score == self.floor[query]) & (ids < self.last[query]))
        query, ids, score = query[better], ids[better], score[better]
        if not len(query):
            return
        # Only the queries that get better are put in order again.
        changed = np.zeros(len(self.floor), bool)
        changed[query] = True
        again = changed[self.query]
        same = self.query[~again], self.score[~again], self.ids[~again]
        all_query = np.concatenate([self.query[again], query])
        all_score = np.concatenate([self.score[again], score])
        all_ids = np.concatenate([self.ids[again], ids])
        order = np.lexsort((all_ids, -all_score, all_query))
        all_query, all_score, all_ids = all_query[order], all_score[order], all_ids[order]
        starts = np.flatnonzero(np.r_[True, all_query[1:] != all_query[:-1]])
        rank = np.arange(len(all_query)) - np.repeat(starts, np.diff(np.r_[starts, len(all_query)]))
        keep = rank < self.k
        full = rank == self.k - 1
        self.floor[all_query[full]] = all_score[full]
        self.last = self.last.astype(np.promote_types(self.last.dtype, all_ids.dtype), copy=False)
        self.last[all_query[full]] = all_ids[full]
        self.query = np.concatenate([same[0], all_query[keep]])
        self.score = np.concatenate([same[1], all_score[keep]])
        self.ids = np.concatenate([same[2], all_ids[keep]])


def usable(norms: np.ndarray) -> np.ndarray:
    """Vectors with a direction: not all zeros, and every element a finite number."""
    return np.isfinite(norms) & (norms > 0)


def of_dimension(rows: DataFrame, key: str, dim: int) -> DataFrame:
    """Key and vector of the rows whose vector has the right length; the others are for the quarantine."""
    vectors = rows.select(F.col(key).cast("string"), F.col("vector").cast("array<double>"))
    return vectors.filter(F.size("vector") == dim)


def dense(vectors: pa.Array) -> np.ndarray:
    """Equal-length vectors as one matrix, without going through Python objects."""
    if not len(vectors):
        return np.zeros((0, 0))
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(vectors), -1)


def block_rows(dim: int) -> int:
    """Vectors in a block at most, whatever few bytes they take."""
    return MOST_ROWS


def packed(rows: DataFrame, matrix_of: Matrix, size: int) -> DataFrame:
    """(block, ids, matrix): the rows (id, ...) of each task in blocks of so many vectors at most, without those of no direction."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * FIRST
        ids, parts, taken = [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, LEAST_ROWS):
                part = batch.slice(start, LEAST_ROWS)
                matrix = matrix_of(part)
                fit = usable(row_norms(matrix)) if len(matrix) else np.zeros(0, bool)
                if not fit.any():
                    continue
                ids += np.array(part.column("id").to_pylist(), object)[fit].tolist()
                parts.append(narrow(matrix[fit]))
                taken += len(stored(parts[-1]))
                while len(ids) >= size:
                    held = np.concatenate(parts)
                    yield as_block(number, ids[:size], held[:size])
                    number, ids, parts, taken = number + 1, ids[size:], [held[size:]], 0
                if taken >= ROW_BYTES:
                    yield as_block(number, ids, np.concatenate(parts))
                    number, ids, parts, taken = number + 1, [], [], 0
        if ids:
            yield as_block(number, ids, np.concatenate(parts))

    return rows.mapInArrow(run, BLOCK)


def as_block(number: int, ids: list[str], matrix: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([number]), pa.array([ids], pa.list_(pa.string())), pa.array([stored(matrix)], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "matrix"])


def narrow(matrix: np.ndarray) -> np.ndarray:
    """The same numbers in the fewest bytes of these kinds that hold them all exactly."""
    for kind in KINDS[:-1]:
        with np.errstate(all="ignore"):
            made = matrix.astype(kind)
        if (made == matrix).all():
            return np.ascontiguousarray(made)
    return np.ascontiguousarray(matrix, np.float64)


def stored(matrix: np.ndarray) -> bytes:
    """A block's numbers: of counts only those that are not zero, where that is shorter than any kind of all of them."""
    return pressed(matrix) or narrow(matrix).tobytes()


def is_counts(raw: bytes, rows: int, dim: int) -> bool:
    return len(raw) < rows * dim


def matrix_of_block(raw: bytes, rows: int, dim: int) -> np.ndarray:
    """Told by the length of the bytes which kind the numbers are of."""
    if is_counts(raw, rows, dim):
        return spread_out(unpressed(raw, dim), rows, dim)
    kind = next(kind for kind in KINDS if len(raw) == rows * dim * np.dtype(kind).itemsize)
    return np.frombuffer(raw, kind).reshape(rows, dim).astype(np.float64)


class Queries:
    """A block of queries with the best hits that it has had so far."""

    def __init__(self, ids: np.ndarray, raw: bytes, dim: int, k: int):
        self.ids, self.best, self._raw, self._dim = ids, Best(len(ids), k), raw, dim
        self._asked = Asked(unpressed(raw, dim), len(ids)) if is_counts(raw, len(ids), dim) else None

    def meet(self, vectors: Vectors) -> None:
        if self._asked and vectors.parts:
            for part in vectors.parts:
                query, row, score = wanted(self._asked, part, self.best.floor, self.best.k)
                self.best.add_some(query, vectors.ids[row], score)
            return
        queries = matrix_of_block(self._raw, len(self.ids), self._dim)
        norms, matrix, sizes = row_norms(queries), vectors.matrix, row_norms(vectors.matrix)
        step = max(1, PAIRS_PER_STEP // len(queries))
        for start in range(0, len(sizes), step):
            part = slice(start, start + step)
            self.best.add(vectors.ids[part], score_block(matrix[part], sizes[part], queries, norms))

    def hits(self) -> pa.RecordBatch:
        best = self.best
        columns = [self.ids[best.query].tolist() if len(best.query) else [], best.ids.tolist(), best.score]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, HITS, strict=True)], schema=HITS)


class Vectors:
    """A block of vectors, as counts where it is stored so."""

    def __init__(self, ids: np.ndarray, raw: bytes, dim: int):
        self.ids, self._raw, self._dim = ids, raw, dim
        self.parts = parts_of(unpressed(raw, dim), len(ids), dim) if is_counts(raw, len(ids), dim) else []

    @cached_property
    def matrix(self) -> np.ndarray:
        return matrix_of_block(self._raw, len(self.ids), self._dim)


def scored_blocks(pairs: DataFrame, dim: int, k: int) -> DataFrame:
    """The k best hits per query of each task, from rows that hold a block of queries and one of vectors.

    A block of vectors without one of queries is for all those that its task was told of before. More queries than a task holds must come in the order of their blocks, or their hits are told again and again.
    """
    most = QUERIES_HELD * block_rows(dim)
    ship_package(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, Queries] = {}
        last, vectors = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                number, block = batch.column("query_block")[at].as_py(), batch.column("block")[at].as_py()
                if block != last:
                    ids = np.array(batch.column("ids")[at].as_py(), dtype=str)
                    last, vectors = block, Vectors(ids, batch.column("matrix")[at].as_py(), dim)
                if number is None:
                    for each in asked.values():
                        each.meet(vectors)
                    continue
                if number not in asked:
                    ids = np.array(batch.column("query_ids")[at].as_py(), dtype=str)
                    if sum(len(each.ids) for each in asked.values()) + len(ids) > most:
                        for each in asked.values():
                            yield each.hits()
                        asked = {}
                    asked[number] = Queries(ids, batch.column("query_matrix")[at].as_py(), dim, k)
                asked[number].meet(vectors)
        for each in asked.values():
            yield each.hits()

    return pairs.mapInArrow(run, "query_id string, id string, score double")


def ranked(hits: DataFrame, k: int, tasks: int | None = None) -> DataFrame:
    """The k best hits of each query, first within shares of the hits and then among what is left of those.

    The hits of a query grow with the number of scanning tasks, so they are not all brought to one task. Where there are
    many hits, they are merged by as many tasks as are asked for.
    """
    best = [F.desc("score"), F.col("id")]
    share = F.pmod(F.xxhash64("id"), F.lit(MERGE_SHARES))
    within = Window.partitionBy("query_id", "share").orderBy(*best)
    hits = hits.withColumn("share", share)
    hits = hits.repartition(tasks, "query_id", "share") if tasks else hits
    kept = hits.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= k)
    overall = Window.partitionBy("query_id").orderBy(*best)
    return kept.drop("share").withColumn("rank", F.row_number().over(overall)).filter(F.col("rank") <= k)


def of_queries(queries: DataFrame, dim: int) -> DataFrame:
    """One query for each id: of several vectors under one id, that of the least hash is asked for."""
    queries = of_dimension(queries, "query_id", dim)
    return queries.groupBy("query_id").agg(F.min_by("vector", F.xxhash64("vector")).alias("vector"))


def searched(rows: DataFrame, matrix_of: Matrix, queries: DataFrame, dim: int, k: int, block_bytes: int) -> DataFrame:
    """Exact hits of all queries among rows whose vectors `matrix_of` gives."""
    size, cores = block_rows(dim), rows.sparkSession.sparkContext.defaultParallelism
    asked = of_queries(queries, dim).withColumnRenamed("query_id", "id")
    asked = packed(asked, lambda part: dense(part.column("vector")), size)
    asked = written(asked.withColumn("n", F.size("ids")), "queries", BLOCKS_PER_FILE)
    names = [F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix")]
    counted = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.octet_length("matrix")), F.lit(0)))
    n, n_queries, n_bytes = counted.first()
    if n_bytes <= block_bytes and n_queries <= QUERIES_HELD * size:
        # Fewer tasks tell of fewer hits. Each task is told of the queries once, with its first block.
        blocks = packed(rows.coalesce(TASKS_PER_CORE * cores), matrix_of, size)
        sent = F.broadcast(asked.select(F.pmod("block", F.lit(1)).alias("group"), *names))
        pairs = blocks.withColumn("group", F.when(F.pmod("block", F.lit(FIRST)) == 0, F.lit(0))).join(sent, "group", "left")
        tasks = math.ceil(n_queries * k * TASKS_PER_CORE * cores / HITS_PER_TASK)
        return ranked(scored_blocks(pairs, dim, k), k, tasks if tasks > MERGE_SHARES else None)
    blocks = written(packed(rows, matrix_of, size).withColumn("n", F.size("ids")), "blocks", BLOCKS_PER_FILE)
    n_blocks, down = max(1, blocks.count()), max(1, math.ceil(n / QUERY_BLOCKS))
    across = max(math.ceil(n_blocks / VECTOR_BLOCKS), min(n_blocks, math.ceil(CELLS_PER_CORE * cores / down)))
    asked, blocks = in_groups(asked, down, "query_group"), in_groups(blocks, across, "vector_group")
    parts = PARTITIONS_PER_CELL * across * down
    cell = (F.col("query_group") * across + F.col("vector_group")).alias("cell")
    every = asked.withColumn("vector_group", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).select(cell, *names)
    grouped = blocks.withColumn("query_group", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).select(cell, "block", "ids", "matrix")
    # The tasks follow the cells, so that what a task sorts and holds is bounded.
    pairs = every.repartition(parts, "cell").hint("merge").join(grouped.repartition(parts, "cell"), "cell")
    return ranked(scored_blocks(pairs, dim, k), k, max(MERGE_SHARES, math.ceil(n_queries * k * across / HITS_PER_TASK)))


def in_groups(blocks: DataFrame, groups: int, name: str) -> DataFrame:
    """Blocks with a group each, told by a hash: groups are of about equal size."""
    return blocks.withColumn(name, F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))


def top_k(vectors: DataFrame, queries: DataFrame, dim: int, k: int = TOP_K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact: (query_id, rank, id, score) from (id, vector) and (query_id, vector)."""
    rows = of_dimension(vectors, "id", dim)
    return searched(rows, lambda part: dense(part.column("vector")), queries, dim, k, block_bytes)


def top_k_texts(
    texts: DataFrame, queries: DataFrame, embedder: Embedder, dim: int, k: int = TOP_K, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """As top_k over (id, body) rows, embedding them in the task that packs them."""
    rows = texts.select(F.col("id").cast("string"), "body")
    return searched(rows, lambda part: embedder(part.column("body").to_pylist()), queries, dim, k, block_bytes)


def nearest(vectors: DataFrame, query: Column, k: int = TOP_K) -> DataFrame:
    """Exact neighbours of a single query, as column arithmetic and a top-k sort."""
    scored = vectors.select(F.col("id"), cosine_score(F.col("vector"), query).alias("score"))
    return scored.filter(F.col("score").isNotNull()).orderBy(F.desc("score"), "id").limit(k)


def query_vectors(prompts: DataFrame, id_column: str, text_column: str, embedder: Embedder) -> DataFrame:
    return embed(prompts, id_column, text_column, embedder).withColumnRenamed("id", "query_id")
