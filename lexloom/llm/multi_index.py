"""Near-duplicate vectors by an inverted multi-index over vector halves."""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.graph import components
from lexloom.llm.text import lists, map_batches
from lexloom.session import ship_package, written

LINK_COSINE = 0.93
#: Vectors that the codebooks and the reach of the traversal are fitted on, at most; every vector is indexed.
SAMPLE, ROUNDS = 20_000, 12
#: Vectors per cell on average that the codebooks aim at, and codes per half at most.
PER_CELL, MOST_CODES = 48, 256
TARGET_RECALL = 0.999
#: Cell members and visiting vectors that meet in one block at most.
BLOCK = 2048


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def code_distances(half: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of half vectors to the codes of their half."""
    found = (half**2).sum(axis=1)[:, None] - 2 * half @ codes.T + (codes**2).sum(axis=1)[None, :]
    return np.maximum(found, 0.0)


def fit_codes(half: np.ndarray, n_codes: int, seed: int) -> np.ndarray:
    """k-means over the sample's half vectors."""
    random = np.random.default_rng(seed)
    codes = half[random.permutation(len(half))[:n_codes]].copy()
    for _ in range(ROUNDS):
        nearest = code_distances(half, codes).argmin(axis=1)
        sums = np.zeros_like(codes)
        np.add.at(sums, nearest, half)
        counts = np.bincount(nearest, minlength=len(codes))
        codes[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return codes


class MultiIndex:
    """Two codebooks, whose pairs of codes are the cells, and how far a traversal goes.

    The cells of a vector are visited in order of the sum of its halves' squared distances to their codes, from its own
    cell on, until that sum exceeds the least one by more than `reach`.
    """

    def __init__(self, dim: int, codes: tuple[np.ndarray, np.ndarray], reach: float):
        self.dim, self.codes, self.reach = dim, codes, reach

    def _distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.dim // 2
        return code_distances(unit[:, :cut], self.codes[0]), code_distances(unit[:, cut:], self.codes[1])

    def cells(self, unit: np.ndarray) -> np.ndarray:
        first, second = self._distances(unit)
        return first.argmin(axis=1) * len(self.codes[1]) + second.argmin(axis=1)

    def excess(self, unit: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """By how much a cell's sum of distances exceeds that of the vector's own cell."""
        first, second = self._distances(unit)
        rows, width = np.arange(len(unit)), len(self.codes[1])
        there = first[rows, cells // width] + second[rows, cells % width]
        return there - first.min(axis=1) - second.min(axis=1)

    def traverse(self, unit: np.ndarray) -> list[np.ndarray]:
        """The visited cells of each vector, nearest first: two ascending sequences, merged as far as the reach."""
        found = []
        for first, second in zip(*self._distances(unit), strict=True):
            u, v = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
            more_u, more_v = first[u] - first[u[0]], second[v] - second[v[0]]
            depth = np.searchsorted(more_v, self.reach - more_u, side="right")
            depth = depth[: np.searchsorted(more_u, self.reach, side="right")]
            rows = np.repeat(np.arange(len(depth)), depth)
            columns = np.arange(depth.sum()) - np.repeat(np.cumsum(depth) - depth, depth)
            order = np.argsort(more_u[rows] + more_v[columns], kind="stable")
            found.append((u[rows] * len(second) + v[columns])[order].astype(np.int32))
        return found


def fit_index(sample: np.ndarray, n_vectors: int, cosine: float, recall: float = TARGET_RECALL, seed: int = 5) -> MultiIndex:
    """Codebooks from a sample, sized by the number of vectors, and the reach that finds partners with the wanted recall.

    The reach is measured on made partners of the sample's vectors at exactly the least cosine, which are the hardest to
    find; a pair counts as found when either of the two visits the other's cell.
    """
    unit = unit_rows(sample)
    dim = unit.shape[1]
    cut = dim // 2
    n_codes = int(min(MOST_CODES, len(unit), max(1, round((n_vectors / PER_CELL) ** 0.5))))
    codes = fit_codes(unit[:, :cut], n_codes, seed), fit_codes(unit[:, cut:], n_codes, seed + 1)
    index = MultiIndex(dim, codes, 0.0)
    aside = np.random.default_rng(seed + 2).standard_normal(unit.shape)
    aside -= (aside * unit).sum(axis=1, keepdims=True) * unit
    lengths = np.linalg.norm(aside, axis=1, keepdims=True)
    partners = unit_rows(cosine * unit + (1 - cosine**2) ** 0.5 * np.divide(aside, lengths, out=np.zeros_like(aside), where=lengths > 0))
    needed = np.minimum(index.excess(unit, index.cells(partners)), index.excess(partners, index.cells(unit)))
    index.reach = float(np.quantile(needed, recall)) + 1e-9
    return index


def comparable(id_column: str, vector_column: str, label_column: str) -> Column:
    """Whether a row's vector can be compared at all."""
    vector = F.col(vector_column).cast("array<double>")
    bad = F.exists(vector, lambda value: value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")))
    named = F.col(id_column).isNotNull() & F.col(label_column).isNotNull()
    return named & F.coalesce(~bad & F.exists(vector, lambda value: value != 0), F.lit(False))


def usable_vectors(rows: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(id, label, dim, digest, vector) of the rows that can be compared."""
    picked = rows.filter(comparable(id_column, vector_column, label_column)).select(
        F.col(id_column).cast("long").alias("id"),
        F.col(label_column).cast("string").alias("label"),
        F.col(vector_column).cast("array<double>").alias("vector"),
    )

    def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = [np.asarray(one, np.float64) + 0.0 for one in batch.column("vector").to_pylist()]
        # Scaled to a largest component near 1, so that no square is lost or overflows; by powers of two, so exactly.
        scaled = [np.ldexp(one, -int(np.frexp(np.abs(one).max())[1])) for one in vectors]
        made = [
            pa.array([len(one) for one in scaled], pa.int32()),
            pa.array([hashlib.blake2b(one.tobytes(), digest_size=16).digest() for one in scaled], pa.binary()),
            lists(scaled, pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), *made], names=["id", "label", "dim", "digest", "vector"]
        )

    return map_batches(picked, digests, "id long, label string, dim int, digest binary, vector array<double>", 1024)


class Block:
    """Cell members against visiting vectors: links of each and the edges that connect what is linked."""

    def __init__(self, cosine: float):
        self.cosine = cosine

    def compare(self, visitors: pa.Table, members: pa.Table) -> pa.Table:
        empty = pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
        if not visitors.num_rows or not members.num_rows:
            return empty
        x, y = (unit_rows(np.array(side.column("vector").to_pylist())) for side in (visitors, members))
        x_id, y_id = visitors.column("id").to_numpy(), members.column("id").to_numpy()
        x_copies, y_copies = visitors.column("copies").to_numpy(), members.column("copies").to_numpy()
        near = (x @ y.T >= self.cosine) & (x_id[:, None] != y_id[None, :])
        at_x, at_y = np.nonzero(near)
        if not len(at_x):
            return empty
        # A member that doesn't visit the visitor's cell would never count the link itself.
        visited = [np.asarray(cells, np.int64) for cells in members.column("visits").to_pylist()]
        width = max(1, len(visited))
        pairs = np.concatenate([cells * width + row for row, cells in enumerate(visited)])
        x_cell = visitors.column("own").to_numpy().astype(np.int64)
        alone = ~np.isin(x_cell[at_x] * width + at_y, pairs)
        n_x = np.bincount(at_x, y_copies[at_y], len(x)).astype(np.int64)
        n_y = np.bincount(at_y[alone], x_copies[at_x[alone]], len(y)).astype(np.int64)
        ids = np.concatenate([x_id, y_id])
        least = _least_reached(ids, at_x, at_y + len(x))
        return pa.table({"id": ids, "n": np.concatenate([n_x, n_y]), "to": least})


def _least_reached(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least id that each entry reaches over the links within a block."""
    least = ids.copy()
    while True:
        before = least.copy()
        np.minimum.at(least, left, before[right])
        np.minimum.at(least, right, least[left])
        if (least == before).all():
            return least


def near_vectors(
    rows: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    cosine: float = LINK_COSINE,
    recall: float = TARGET_RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row, over links between vectors of one label.

    Equal vectors of a label are one class with a number of copies, and only classes are compared. Every class lies in
    the cell of its halves' nearest codes, and visits the cells that the traversal reaches; all that meet in a cell are
    compared in double precision. Cells and their visitors are cut into blocks of bounded size, so that no cell is one
    task's work. A block returns counts and, for what it found linked, the least id reached, not the pairs. A link seen
    from one side only is counted for both.

    Rows with a null label or id, and vectors that are null, empty, zero or hold null or non-finite components, have no
    links and are their own components. Vectors of different lengths are never linked. Repeated rows and ids are rows of
    their own. Other columns are not read.
    """
    spark = rows.sparkSession
    usable = written(usable_vectors(rows, id_column, vector_column, label_column), "vectors")
    classes = usable.groupBy("label", "dim", "digest").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")
    )
    classes = written(classes, "vector_classes")
    indexes = {}
    for dim, n in sorted((row[0], row[1]) for row in classes.groupBy("dim").count().collect()):
        share = min(1.0, SAMPLE / n)
        mark = F.pmod(F.xxhash64("digest"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
        sample = classes.filter((F.col("dim") == dim) & mark).orderBy("digest", "label").select("vector").limit(SAMPLE).toArrow()
        if sample.num_rows:
            flat = sample.column("vector").combine_chunks().flatten().to_numpy()
            indexes[dim] = fit_index(flat.reshape(-1, dim), n, cosine, recall)
    shared = spark.sparkContext.broadcast(indexes)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims = batch.column("dim").to_numpy()
        vectors = batch.column("vector").to_pylist()
        cells, visits = [0] * len(dims), [np.zeros(1, np.int32)] * len(dims)
        for dim in np.unique(dims):
            index, at = shared.value.get(int(dim)), np.flatnonzero(dims == dim)
            if index is None:
                continue
            unit = unit_rows(np.array([vectors[i] for i in at]))
            for i, cell, seen in zip(at, index.cells(unit), index.traverse(unit), strict=True):
                cells[i], visits[i] = int(cell), seen
        made = [pa.array(cells, pa.int32()), lists(visits, pa.int32())]
        names = ["label", "dim", "id", "copies", "vector"]
        return pa.RecordBatch.from_arrays([*(batch.column(name) for name in names), *made], names=[*names, "cell", "visits"])

    kinds = "label string, dim int, id long, copies long, vector array<double>, cell int, visits array<int>"
    placed = written(map_batches(classes, place, kinds, 1024), "cells")

    visitors = placed.select("label", "dim", "id", "copies", "vector", F.col("cell").alias("own"), F.explode("visits").alias("cell"))
    sizes = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("member_blocks"))
    callers = visitors.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("caller_blocks"))
    grid = written(sizes.join(callers, ["label", "dim", "cell"]), "cell_sizes")
    where = ["label", "dim", "cell"]
    members = _dealt(placed, grid, "member_blocks", "caller_blocks", ["id", "copies", "vector", "visits"])
    calls = _dealt(visitors, grid, "caller_blocks", "member_blocks", ["id", "copies", "vector", "own"])
    by = [*where, "member_block", "caller_block"]
    ship_package(spark)
    work = Block(cosine)

    def compare(visitors: pa.Table, members: pa.Table) -> pa.Table:
        return work.compare(visitors, members)

    both = calls.groupBy(*(F.col(f"caller_blocks_{name}") for name in by)).cogroup(members.groupBy(*(F.col(f"member_blocks_{name}") for name in by)))
    found = both.applyInArrow(compare, "id long, n long, to long")
    found = written(found, "found")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    linked = written(components(found.filter("to <> id").select(F.col("id").alias("a"), F.col("to").alias("b"))), "components")

    of_class = classes.select("label", "dim", "digest", "id", "copies").join(counts, "id", "left").join(linked, "id", "left")
    of_class = of_class.select(
        "label",
        "dim",
        "digest",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    found = usable.select("id", "label", "dim", "digest").join(written(of_class, "vector_classes"), ["label", "dim", "digest"])
    rest = rows.filter(~comparable(id_column, vector_column, label_column)).select(F.col(id_column).cast("long").alias("vec_id"))
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = found.select(F.col("id").alias("vec_id"), "n_links", "component_id").unionByName(rest)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _dealt(rows: DataFrame, grid: DataFrame, own: str, other: str, columns: list[str]) -> DataFrame:
    """Rows of cells dealt to the blocks of their side by a hash, once for every block of the other side."""
    block = {own: F.pmod(F.xxhash64("id"), F.col(own)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))}
    rows = rows.join(grid, ["label", "dim", "cell"])
    keys = [F.col(name).alias(f"{own}_{name}") for name in ("label", "dim", "cell")]
    blocks = [block[f"{side}_blocks"].alias(f"{own}_{side}_block") for side in ("member", "caller")]
    return rows.select(*keys, *blocks, *(F.col(name).alias(name) for name in columns))
