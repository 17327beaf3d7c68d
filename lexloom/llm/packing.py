"""Token pieces packed into sequences by bounded-space online best fit."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.text import as_binary, lists, map_batches
from lexloom.session import ship_package

SEQUENCE_LENGTH, END_ID = 2048, 0
#: Bins open at a time in one packer, and documents dealt to one packer on average.
OPEN_BINS, DOCUMENTS_PER_PACKER = 2048, 65_536
KNOWN_WORDS, KNOWN_IDS = 800_000, 8_000_000
#: A run of letters that are one code point with and without capitals, and signs after it; no apostrophe, which can start a part.
PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\x9e\xa0-\xb6\xb8-\xbe])+)([!-&(-/:-@\[-`{-~]*)")

PIECE_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class Numbers(dict):
    """Numbers things in the order in which they are first asked for, and lists those that are new."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        self.new.append(word)
        return found


class WordTokens:
    """Token ids of whole texts, put together from the ids of their words.

    The tokenizer drops white space and no token or normalisation rule reaches over it, so a text's ids are its words'
    ids in order. It also parts letters from signs, so that a plain word with signs after it is the two in order, and has
    no capitals. Ids of words and of such parts seen lately are kept; when there are too many, all are forgotten.
    """

    def __init__(self, path: str, known_words: int = KNOWN_WORDS):
        self.known_words = known_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._parts: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self._at = Numbers()
        self._starts, self._lengths, self._ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _part(self, part: str) -> bytes:
        """Ids, as bytes, of a run of letters without capitals or of signs. For ASCII the model needs no preparation."""
        found = self._parts.get(part)
        if found is None:
            if part.isascii():
                ids = [token.id for token in self._model.tokenize(part)]
            else:
                ids = self._tokenizer.encode(part, add_special_tokens=False).ids
            found = self._parts[part] = array("I", ids).tobytes()
        return found

    def _word(self, word: bytes) -> bytes:
        plain = PLAIN.fullmatch(word)
        if not plain:
            return array("I", self._tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        letters = self._part(plain[1].decode().lower())
        return letters + self._part(plain[2].decode()) if plain[2] else letters

    def _learn(self, words: list[bytes]) -> None:
        if len(self._parts) > self.known_words:
            self._parts.clear()
        ids = list(map(self._word, words))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self._starts = np.concatenate([self._starts, len(self._ids) + np.cumsum(lengths) - lengths])
        self._lengths = np.concatenate([self._lengths, lengths])
        self._ids = np.concatenate([self._ids, np.frombuffer(b"".join(ids), np.uint32)])

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The ids of each text. Words that are new are learned together for a whole batch."""
        if len(self._at) > self.known_words or len(self._ids) > KNOWN_IDS:
            self._forget()
        words = [(text or b"").split() for text in texts]
        numbers = [np.fromiter(map(self._at.__getitem__, each), np.int64, len(each)) for each in words]
        if self._at.new:
            self._learn(self._at.new)
            self._at.new = []
        return [self._put_together(each) for each in numbers]

    def _put_together(self, at: np.ndarray) -> np.ndarray:
        lengths = self._lengths[at]
        ends = np.cumsum(lengths)
        places = np.repeat(self._starts[at] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self._ids[places]


@lru_cache(1)
def word_tokens(path: str, known_words: int = KNOWN_WORDS) -> WordTokens:
    """One for all tasks of a worker."""
    return WordTokens(path, known_words)


class Pieces:
    """Pieces of each text in a batch: its ids and the end id, cut only where they are longer than a sequence."""

    def __init__(self, tokenizer: str, length: int, end_id: int, with_ids: bool, known_words: int = KNOWN_WORDS):
        self.tokenizer, self.length, self.end_id, self.with_ids, self.known_words = tokenizer, length, end_id, with_ids, known_words

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, cuts = [], []
        tokens = word_tokens(self.tokenizer, self.known_words)(batch.column("text").to_pylist())
        for doc_id, found in zip(batch.column("doc_id").to_pylist(), tokens, strict=True):
            ids = np.append(found, np.uint32(self.end_id)).astype("<u4")
            for piece, start in enumerate(range(0, len(ids), self.length)):
                cut = ids[start : start + self.length]
                rows.append((doc_id, piece, start, len(cut), zlib.crc32(cut.tobytes())))
                cuts.append(cut)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if self.with_ids:
            columns.append(lists(cuts, pa.int32()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)


def token_pieces(
    docs: DataFrame,
    tokenizer: str | None = None,
    length: int = SEQUENCE_LENGTH,
    end_id: int = END_ID,
    with_ids: bool = True,
    id_column: str = "doc_id",
    text_column: str = "text",
    known_words: int = KNOWN_WORDS,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of every row's whole text.

    A null or empty text is the end id alone. Repeated rows give repeated pieces; a null id stays null. Other columns are
    not read. A worker keeps the ids of about `known_words` words, for speed alone.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), as_binary(F.col(text_column)).alias("text"))
    work = Pieces(tokenizer or default_tokenizer(), length, end_id, with_ids, known_words)
    return map_batches(rows, work, PIECE_COLUMNS + (", ids array<int>" if with_ids else ""))


class BestFit:
    """Places sizes online into bins of one capacity, of which at most `open_bins` are open.

    A bit set says which amounts of free space an open bin has; the lowest set bit from the size up is the best fit. When
    a new bin is needed and all are open, the fullest one, at the lowest set bit of all, closes.
    """

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self._free, self._bins = 0, [[] for _ in range(capacity + 1)]
        self._open = self.made = 0

    def _take(self, free: int) -> int:
        found = self._bins[free].pop()
        if not self._bins[free]:
            self._free ^= 1 << free
        self._open -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        """Number of the bin and the place in it."""
        fitting = self._free >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            found = self._take(free)
        else:
            if self._open == self.open_bins and size < self.capacity:
                self._take((self._free & -self._free).bit_length() - 1)
            free, found = self.capacity, self.made
            self.made += 1
        left = free - size
        if left:
            self._bins[left].append(found)
            self._free |= 1 << left
            self._open += 1
        return found, self.capacity - free


def best_fit(pieces: DataFrame, packers: int, capacity: int = SEQUENCE_LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pieces with sequence_id and offset: which sequence holds the piece, and from where on, without gaps.

    Pieces are dealt to packers by a hash of their id, and come to each in the order of another, which is as good as
    random order and the same whenever a task is repeated. Packers work alone, so their number must follow the number of
    rows, not of cores; each leaves some of its last bins partly filled. No pieces, no sequences.
    """
    ship_package(pieces.sparkSession)
    key = ["doc_id", "piece", "ids_crc32"]
    dealt = pieces.withColumn("_order", F.xxhash64(F.lit("order"), *key))
    dealt = dealt.repartition(packers, F.xxhash64(*key)).sortWithinPartitions("_order", *key)
    dealt = dealt.withColumn("_packer", F.spark_partition_id()).drop("_order")
    names = [name for name in dealt.columns if name != "_packer"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(capacity, open_bins)
        for batch in batches:
            placed = [bins.place(size) for size in batch.column("length").to_pylist()]
            packer = batch.column("_packer").to_pylist()
            made = [
                pa.array([(at << 40) + number for at, (number, _) in zip(packer, placed, strict=True)], pa.int64()),
                pa.array([offset for _, offset in placed], pa.int64()),
            ]
            columns = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in dealt.schema if field.name in names)
    return dealt.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def packers_for(rows: int, documents_per_packer: int = DOCUMENTS_PER_PACKER) -> int:
    return max(1, -(-rows // documents_per_packer))


def pack(docs: DataFrame, with_ids: bool = True, **options) -> DataFrame:
    """The pieces of all texts with their places, as token_pieces and best_fit give them."""
    return best_fit(token_pieces(docs, with_ids=with_ids, **options), packers_for(docs.count()))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, input_ids): the packed sequences themselves. A group is one sequence, so it is bounded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.flatten(F.transform(parts, lambda part: part["ids"])).alias("input_ids")
    )
