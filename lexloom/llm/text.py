"""Words, shingles and Arrow helpers that the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import ship_package

SHINGLE_WORDS = 5
#: A word: a run of bytes other than the six ASCII white-space ones. bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
KNOWN_WORDS = 200_000
#: Texts are taken in batches of this many rows, since one text can be long.
TEXT_ROWS = 256

FOLD, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that any of their bits may be cut off."""
    values = (values ^ (values >> np.uint64(30))) * MIX_A
    values = (values ^ (values >> np.uint64(27))) * MIX_B
    return values ^ (values >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word seen lately; forgets all when full, so that its size stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def word_hashes(text: bytes | None, known: WordHashes) -> np.ndarray:
    """Hashes of the words of a UTF-8 text with A-Z lower-cased, in order."""
    words = (text or b"").lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of `width` words, ascending; fewer words make one run; no words make none."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    runs = np.full(len(hashes) - width + 1, width, np.uint64)
    for at in range(width):
        runs = runs * FOLD + hashes[at : at + len(runs)]
    return np.unique(mixed(runs))


def text_shingles(text: bytes | None, known: WordHashes, width: int = SHINGLE_WORDS) -> np.ndarray:
    return shingles(word_hashes(text, known), width)


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the longs Spark has."""
    return values.view(np.int64)


def as_binary(text: Column) -> Column:
    """Texts as UTF-8 bytes, which Python gets without decoding."""
    return text.cast("string").cast("binary")


def given_back(run: Callable) -> None:
    """Drops what a function object has learned in a task, and gives its memory back to the system.

    Workers outlive their tasks, and several kinds of tasks share an executor.
    """
    state = run.__getstate__() if hasattr(run, "__dict__") else None
    if isinstance(state, dict):
        run.__dict__.update(state)
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free:
        free(0)


def map_batches(rows: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, size: int = TEXT_ROWS) -> DataFrame:
    """Applies a function to short slices of Arrow batches; it may be an object with state of its own."""
    ship_package(rows.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                made = run(batch.slice(start, size))
                if made is not None and made.num_rows:
                    yield made
        given_back(run)

    return rows.mapInArrow(each, schema)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from one array per row."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(offsets, pa.array(flat, kind))


def row_key(id_column: str = "doc_id", text_column: str = "text") -> list[Column]:
    """Names a row by its id and text, for tables where an id may be null or repeated; rows alike in both are one."""
    return [F.col(id_column).alias("k_id"), F.xxhash64(text_column).alias("k_text")]

