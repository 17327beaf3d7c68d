"""Token pieces packed into sequences by harmonic packing: length classes whose bins hold a fixed number of pieces.

Class k takes the lengths above 1/(k+1) and up to 1/k of a sequence, and a bin of it holds exactly k pieces, whatever they
are. A bin is padded by what its pieces are shorter than 1/k. Since documents may be cut, each is cut into lengths just
below such shares, by the plan that loses least; a cut counts as much as a few padded tokens.

Every task packs its own rows while it reads them: nothing is shuffled, and a task holds one unfinished bin per class.
What is left in these at its end is put in a row and cut into full sequences and powers of two, which are not padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.packing import default_tokenizer, word_tokens
from lexloom.llm.text import TEXT_ROWS, as_binary, lists
from lexloom.session import ship_package, written

SEQUENCE_LENGTH, END_ID = 2048, 1
#: A cut counts as much as so many tokens of padding.
CUT_COST = 1.0

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


@lru_cache(4)
def cut_plan(capacity: int, cut_cost: float = CUT_COST) -> tuple[tuple[int, ...], ...]:
    """For every length up to the capacity: the piece lengths, longest first, with the least padding and cuts.

    A piece of length s is one of capacity // s in its bin, so it is charged with that share of the bin less s.
    """
    sizes = np.arange(1, capacity + 1)
    padding = capacity / (capacity // sizes) - sizes + cut_cost
    least = np.zeros(capacity + 1)
    first = np.zeros(capacity + 1, np.int64)
    for length in range(1, capacity + 1):
        costs = padding[:length] + least[length - 1 :: -1][:length]
        best = int(np.argmin(costs))
        least[length], first[length] = costs[best], best + 1
    plans: list[tuple[int, ...]] = [()]
    for length in range(1, capacity + 1):
        cut = int(first[length])
        plans.append(tuple(sorted((cut, *plans[length - cut]), reverse=True)))
    return tuple(plans)


def powers_of_two(length: int, capacity: int) -> list[int]:
    """Full sequences and then falling powers of two that add up to the length."""
    parts = [capacity] * (length // capacity)
    rest = length % capacity
    return parts + [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


class HarmonicBins:
    """Fills the bins of all classes, one unfinished bin of each at a time."""

    def __init__(self, capacity: int, first_id: int, cut_cost: float = CUT_COST):
        self.capacity, self._next = capacity, first_id
        self._plans = cut_plan(capacity, cut_cost)
        self._open: dict[int, list[tuple]] = {}

    def _number(self) -> int:
        self._next += 1
        return self._next - 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        """Cuts a document and gives the pieces of the bins that this fills: (doc_id, start, ids, n_ids, sequence, offset)."""
        total, start = len(ids), 0
        full, rest = divmod(total, self.capacity)
        for length in (self.capacity,) * full + self._plans[rest]:
            piece = (doc_id, start, ids[start : start + length].copy(), total)
            start += length
            kind = self.capacity // length
            pieces = self._open.setdefault(kind, [])
            pieces.append(piece)
            if len(pieces) == kind:
                yield from self._placed(self._open.pop(kind))

    def _placed(self, pieces: list[tuple]) -> Iterator[tuple]:
        number, offset = self._number(), 0
        for piece in pieces:
            yield (*piece, number, offset)
            offset += len(piece[2])

    def rest(self) -> Iterator[tuple]:
        """The pieces of unfinished bins, one after another, cut where sequences of full or power-of-two length end."""
        left = [piece for kind in sorted(self._open) for piece in self._open[kind]]
        self._open = {}
        lengths = iter(powers_of_two(sum(len(piece[2]) for piece in left), self.capacity))
        number, offset, room = -1, 0, 0
        for doc_id, start, ids, total in left:
            while len(ids):
                if not room:
                    number, offset, room = self._number(), 0, next(lengths)
                cut = ids[:room]
                yield doc_id, start, cut, total, number, offset
                start, ids = start + len(cut), ids[len(cut) :]
                offset, room = offset + len(cut), room - len(cut)


def _as_batch(placed: list[tuple], with_ids: bool) -> pa.RecordBatch:
    doc_ids, starts, cuts, totals, numbers, offsets = zip(*placed, strict=True)
    cuts = [np.ascontiguousarray(cut, "<u4") for cut in cuts]
    values = [doc_ids, starts, list(map(len, cuts)), [zlib.crc32(cut) for cut in cuts], totals, numbers, offsets]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns = [pa.array(column, pa.int64()) for column in values]
    if with_ids:
        columns.append(lists(cuts, pa.int32()))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names=names)


def harmonic_pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    length: int = SEQUENCE_LENGTH,
    end_id: int = END_ID,
    with_ids: bool = True,
    cut_cost: float = CUT_COST,
    stored: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): the pieces of all texts with their places.

    A sequence is padded to `length` unless its tokens are a power of two in number, which `padding` adds up. Each id of a
    document (its text's and the end id) lies in exactly one piece. A null or empty text is the end id alone; repeated rows
    are packed each for itself; a null id stays null; no rows give no pieces; other columns are not read.

    A task that is repeated must get its rows in the same order, as from files. For rows that come out of a shuffle, set
    `stored`, which writes the ids and texts once and reads them from there.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), as_binary(F.col(text_column)).alias("text"))
    if stored:
        rows = written(rows, "unpacked")
    ship_package(rows.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = HarmonicBins(length, TaskContext.get().partitionId() << 40, cut_cost)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXT_ROWS):
                part = batch.slice(at, TEXT_ROWS)
                tokens = word_tokens(path)(part.column("text").to_pylist())
                placed = []
                for doc_id, found in zip(part.column("doc_id").to_pylist(), tokens, strict=True):
                    placed.extend(bins.add(doc_id, np.append(found, np.uint32(end_id))))
                if placed:
                    yield _as_batch(placed, with_ids)
        placed = list(bins.rest())
        if placed:
            yield _as_batch(placed, with_ids)

    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def padding(packed: DataFrame, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """One row: n_sequences, n_tokens and n_padding of packed pieces."""
    filled = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.bit_count("n") == 1
    added = F.when(power, 0).otherwise(length - F.col("n"))
    return filled.agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("n").alias("n_tokens"), F.sum(added).alias("n_padding"))
