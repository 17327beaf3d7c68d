"""Alignment of two tokenizers' tokens over the same texts, and how often each pair of ids is linked.

A text's tokens under both are laid over its bytes. Where both have a token that ends, and the next token of both is marked
with a space, the document is cut into windows of token ids. Most windows come again and again, so a window is aligned once
and remembered under its ids. No token of either reaches over a single space, so the ids of a whole text are those of the
parts between its single spaces, which are windows or several of them; what is known of a part is remembered too.

Texts are read twice. The first pass counts the links of id pairs, added up within each task; the second gives each document
its figures. In between the most frequent pairs, at most HEAD_PAIRS of them, are sent to all tasks; links of other pairs are
joined to their counts by pair.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.packing import Numbers
from lexloom.llm.text import TEXT_ROWS, as_binary, lists
from lexloom.session import ship_package, written

#: Pairs whose counts every task holds, 13 bytes each. Pairs beyond them are joined.
HEAD_PAIRS = 1_000_000
#: When so many parts of texts or links in their windows are known, all are forgotten.
KNOWN_PARTS, KNOWN_IDS = 500_000, 8_000_000
#: A token id of B in a window's key has this bit.
OF_B = np.uint32(1 << 31)

PAIR = "pair long, n long"
FIGURES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
REST = ", row long, rest array<long>, rest_times array<long>"

#: A space that is not the first of several and has no white space after it: neither tokenizer's tokens reach over such a cut.
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
#: Where every single space is such a cut or begins all the white space that it stands in, nothing of this is found.
SPACE_BEFORE = re.compile(r"[^\S ] ")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself where it is visible, else one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in set(visible)]
    return {chr(byte): byte for byte in visible} | {chr(0x100 + at): byte for at, byte in enumerate(hidden)}


class Vocabulary:
    """The bytes of each token, their number, and whether they begin with a space."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lengths = np.array([len(token) for token in tokens], np.int64)
        self.spaced = np.array([token.startswith(b" ") for token in tokens])

    def joined(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[at] for at in ids])


class ByteTokens:
    """Byte-level BPE. Letters up to U+024F go through the faster library, whose ranks are the vocabulary's ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        letters, special = byte_letters(), {token["id"] for token in told["added_tokens"]}
        tokens = [b""] * self._tokenizer.get_vocab_size()
        for token, at in told["model"]["vocab"].items():
            tokens[at] = token.encode() if at in special else bytes(letters[letter] for letter in token)
        self.vocabulary = Vocabulary(tokens)
        ranks = {token: at for at, token in enumerate(tokens) if at not in special}
        self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, parts: list[str]) -> list[list[int]]:
        fast, slow = self._fast.encode_ordinary, self._tokenizer.encode
        return [
            fast(" " + part) if part.isascii() or max(part) < "ɐ" else slow(" " + part, add_special_tokens=False).ids
            for part in parts
        ]


class PieceTokens:
    """Sentence pieces, which put a space before each text by themselves."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(at) for at in range(self._model.vocab_size())]
        self.vocabulary = Vocabulary(
            [
                bytes([int(piece[3:5], 16)]) if self._model.is_byte(at) else piece.replace("▁", " ").encode()
                for at, piece in enumerate(pieces)
            ]
        )

    def __call__(self, parts: list[str]) -> list[list[int]]:
        return self._model.encode(parts, num_threads=1)


def flat(values: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    return np.fromiter(chain.from_iterable(values), np.uint32, int(lengths.sum())), lengths


class Signs(dict):
    """How a token id is written in a list of groups: twice the id, one more at the end of its group's A or B tokens."""

    def __missing__(self, code: int) -> str:
        of_b, at = code >> 20, code & (1 << 20) - 1
        sign = (";" if of_b else "|") if at & 1 else ","
        made = self[code] = f"{at >> 1}{sign}"
        return made


class Tokenizers:
    """Both tokenizers; loaded once in a worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b, self.signs = ByteTokens(path_a), PieceTokens(path_b), Signs()

    def __call__(self, parts: list[str]) -> tuple[np.ndarray, list[list[int]], list[list[int]]]:
        """(good, ids, ids) of texts: whether both give a space and the text back byte by byte; nothing where they don't."""
        of_a, of_b = self.a(parts), self.b(parts)
        raw = [(" " + part).encode() for part in parts]
        a, b = self.a.vocabulary.joined, self.b.vocabulary.joined
        good = [b(y) == part == a(x) for x, y, part in zip(of_a, of_b, raw, strict=True)]
        for at, same in enumerate(good):
            if not same:
                of_a[at], of_b[at] = [], []
        return np.array(good, bool), of_a, of_b


def text_parts(text: bytes | None) -> list[str]:
    """A text cut at spaces that no token reaches over; nothing of one that is null, empty or not UTF-8."""
    try:
        whole = (text or b"").decode()
    except UnicodeDecodeError:
        return []
    if not whole:
        return []
    parts = whole.split(" ")
    return CUT.split(whole) if "" in parts or SPACE_BEFORE.search(whole) else parts


class Windows(Numbers):
    """Windows known by their token ids: the links of each as pair numbers, and its groups as text where these are wanted."""

    def __init__(self, width: int, with_texts: bool):
        super().__init__()
        self.width, self.with_texts = width, with_texts
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new, self.texts, self.n_ids = [], [], 0
        self._pairs, self._n_pairs = [], []

    def add(self, pairs: np.ndarray, n_pairs: np.ndarray, texts: list[str]) -> None:
        self._pairs.append(pairs)
        self._n_pairs.append(n_pairs)
        self.texts += texts
        self.n_ids += len(pairs)
        self.new = []

    def pairs(self) -> np.ndarray:
        self._pairs = [np.concatenate([np.zeros(0, np.int64), *self._pairs])]
        return self._pairs[0]

    def n_pairs(self) -> np.ndarray:
        self._n_pairs = [np.concatenate([np.zeros(0, np.int64), *self._n_pairs])]
        return self._n_pairs[0]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of several ranges, one range after another."""
    return np.repeat(starts - starts_of(lengths), lengths) + np.arange(lengths.sum())


class Laid:
    """Texts laid out in windows: which window stands where, and which windows are each text's."""

    def __init__(self, tokenizers: Tokenizers, windows: Windows, of_a: list[list[int]], of_b: list[list[int]]):
        self.a, self.n_a = flat(of_a)
        self.b, self.n_b = flat(of_b)
        a, b, until = self.a, self.b, np.concatenate([[0], np.cumsum(self.n_a)])
        vocabulary_a, vocabulary_b = tokenizers.a.vocabulary, tokenizers.b.vocabulary
        self.ends_a, self.ends_b = np.cumsum(vocabulary_a.lengths[a]), np.cumsum(vocabulary_b.lengths[b])
        size = int(self.ends_a[-1]) + 1 if len(a) else 1
        self.in_a, self.in_b = np.zeros(size, bool), np.zeros(size, bool)
        self.in_a[self.ends_a], self.in_b[self.ends_b] = True, True
        shared_a, shared_b = np.flatnonzero(self.in_b[self.ends_a]), np.flatnonzero(self.in_a[self.ends_b])
        # The next token of each shared end; behind the last one any will do, since a text's end is an anchor anyway.
        next_a, next_b = np.append(a, a[:1])[shared_a + 1], np.append(b, b[:1])[shared_b + 1]
        last = np.zeros(len(a) + 1, bool)
        last[until] = True
        anchors = last[shared_a + 1] | vocabulary_a.spaced[next_a] & vocabulary_b.spaced[next_b]
        self.until_a, self.until_b = shared_a[anchors] + 1, shared_b[anchors] + 1
        self.n_groups = np.diff(np.searchsorted(shared_a, until))
        self.n_windows = np.diff(np.searchsorted(self.until_a, until, side="right"))
        self.signs, known = tokenizers.signs, len(windows)
        self.windows = self._numbers(windows)
        self._learn(windows, known)

    def _numbers(self, windows: Windows) -> np.ndarray:
        """The ids of each window's A and B tokens in a row, as its key."""
        per_a, per_b = np.diff(self.until_a, prepend=0), np.diff(self.until_b, prepend=0)
        row = np.empty(len(self.a) + len(self.b), np.uint32)
        row[np.arange(len(self.a)) + np.repeat(self.until_b - per_b, per_a)] = self.a
        row[np.arange(len(self.b)) + np.repeat(self.until_a, per_b)] = self.b | OF_B
        raw, bounds = row.tobytes(), (4 * np.concatenate([[0], self.until_a + self.until_b])).tolist()
        keys = [raw[start:end] for start, end in zip(bounds, bounds[1:], strict=False)]
        return np.fromiter(map(windows.__getitem__, keys), np.int64, len(keys))

    def _learn(self, windows: Windows, known: int) -> None:
        """Aligns the windows that are new, each where it stands first.

        Between two neighbouring ends of any tokens lies one link, that of the A and the B token which cover these bytes.
        """
        fresh = np.flatnonzero(self.windows >= known)
        if not len(fresh):
            return
        _, first = np.unique(self.windows[fresh], return_index=True)
        first = fresh[first]
        ends = np.flatnonzero(self.in_a | self.in_b)
        until = self.ends_a[self.until_a - 1]
        since = np.concatenate([[0], until[:-1]])
        start, end = (np.searchsorted(ends, at[first], side="right") for at in (since, until))
        places = ends[ranges(start, end - start)]
        at_a, at_b = np.searchsorted(self.ends_a, places), np.searchsorted(self.ends_b, places)
        pairs = self.a[at_a].astype(np.int64) * windows.width + self.b[at_b]
        closing = places[self.in_a[places] & self.in_b[places]]
        texts = self._texts(first, closing) if windows.with_texts else []
        windows.add(pairs, end - start, texts)

    def _texts(self, first: np.ndarray, closing: np.ndarray) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each window: its tokens group by group, each written with the sign behind it."""
        sides, words, n_words = [], [], np.zeros(len(first), np.int64)
        for ids, ends, until in ((self.a, self.ends_a, self.until_a), (self.b, self.ends_b, self.until_b)):
            since = np.concatenate([[0], until[:-1]])[first]
            lengths = until[first] - since
            at = ranges(since, lengths)
            group = np.searchsorted(closing, ends[at])
            last = np.append(group[1:] != group[:-1], True)
            n_words += lengths
            sides.append(group)
            words.append((len(words) << 20) + 2 * ids[at].astype(np.int64) + last)
        per_a, per_b = (np.bincount(group, minlength=len(closing)) for group in sides)
        row = np.empty(len(words[0]) + len(words[1]), np.int64)
        row[np.arange(len(words[0])) + starts_of(per_b)[sides[0]]] = words[0]
        row[np.arange(len(words[1])) + np.cumsum(per_a)[sides[1]]] = words[1]
        written_out = list(map(self.signs.__getitem__, row.tolist()))
        bounds = np.cumsum(n_words).tolist()
        return ["".join(written_out[x:y])[:-1] for x, y in zip([0, *bounds], bounds, strict=False)]


class Parts:
    """What is known of parts of texts: how many tokens and groups they have, and their windows."""

    def __init__(self, tokenizers: Tokenizers, with_texts: bool):
        self.tokenizers = tokenizers
        self.windows = Windows(len(tokenizers.b.vocabulary.tokens), with_texts)
        self.forget()

    def forget(self) -> None:
        self.windows.forget()
        self._at = Numbers()
        self._good, self._held = np.zeros(0, bool), np.zeros(0, np.int64)
        self._n = np.zeros((4, 0), np.int64)

    def full(self) -> bool:
        return len(self._at) > KNOWN_PARTS or self.windows.n_ids > KNOWN_IDS

    def learn(self, parts: list[str]) -> None:
        good, of_a, of_b = self.tokenizers(parts)
        laid = Laid(self.tokenizers, self.windows, of_a, of_b)
        self._good, self._held = np.concatenate([self._good, good]), np.concatenate([self._held, laid.windows])
        self._n = np.concatenate([self._n, np.stack([laid.n_a, laid.n_b, laid.n_groups, laid.n_windows])], axis=1)
        self._starts = starts_of(self._n[3])

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups as rows; all windows one after another; where each text's windows begin and end)."""
        numbers = []
        for text in texts:
            parts = text_parts(text)
            numbers.append(np.fromiter(map(self._at.__getitem__, parts), np.int64, len(parts)))
        if self._at.new:
            self.learn(self._at.new)
            self._at.new = []
        numbers = [each if self._good[each].all() else each[:0] for each in numbers]
        at = np.concatenate([np.zeros(0, np.int64), *numbers])
        bounds = np.cumsum([0, *map(len, numbers)])
        n = self._n[:, at]
        sums = np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(n, axis=1)], axis=1)[:, bounds]
        windows = self._held[ranges(self._starts[at], n[3])] if len(at) else at
        return np.diff(sums[:3], axis=1), windows, sums[3]


@lru_cache(1)
def tokenizers_of(path_a: str, path_b: str) -> Tokenizers:
    """One for all tasks of a worker."""
    return Tokenizers(path_a, path_b)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


@lru_cache(1)
def counted_parts(path_a: str, path_b: str) -> Parts:
    """One for all counting tasks of a worker."""
    return Parts(tokenizers_of(path_a, path_b), with_texts=False)


def pair_sums(windows: Windows, times: np.ndarray) -> pa.RecordBatch:
    """How often each pair was linked in windows that stood so many times."""
    lengths = windows.n_pairs()[: len(times)]
    seen = np.flatnonzero(times)
    pairs = windows.pairs()[ranges(starts_of(lengths)[seen], lengths[seen])]
    n = np.repeat(times[seen], lengths[seen])
    order = np.argsort(pairs, kind="stable")
    pairs, n = pairs[order], n[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    sums = np.add.reduceat(n, first) if len(first) else n
    return pa.RecordBatch.from_arrays([pa.array(pairs[first]), pa.array(sums, pa.int64())], names=["pair", "n"])


def count_links(path_a: str, path_b: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of each pair, added up in the task before they leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, times = counted_parts(path_a, path_b), np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXT_ROWS):
                _, windows, _ = parts(batch.slice(at, TEXT_ROWS).column("text").to_pylist())
                seen = np.bincount(windows, minlength=len(times))
                seen[: len(times)] += times
                times = seen
                if parts.full():
                    yield pair_sums(parts.windows, times)
                    parts.forget()
                    times = np.zeros(0, np.int64)
        if len(times):
            yield pair_sums(parts.windows, times)

    return run


class Head:
    """Counts of the most frequent pairs, in the order of their numbers."""

    def __init__(self, table: pa.Table):
        pairs = table.column("pair").to_numpy()
        order = np.argsort(pairs)
        self.pairs, self.n = pairs[order], table.column("n").to_numpy()[order]
        self.best = table.column("best").to_numpy()[order].astype(bool)

    def __call__(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, is the highest, is known) of each pair."""
        if not len(self.pairs):
            return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        known = self.pairs[at] == pairs
        return np.where(known, self.n[at], 0), (known & self.best[at]).astype(np.int64), known


class Scored:
    """Sums over the links of each known window, and the pairs whose counts are not at hand."""

    def __init__(self, parts: Parts, head: Head):
        self.parts, self.windows, self._head = parts, parts.windows, head
        self.forget()

    def forget(self) -> None:
        self.parts.forget()
        self.links, self.counts, self.best, self.n_rest = (np.zeros(0, np.int64) for _ in range(4))
        self.rest: dict[int, list[int]] = {}

    def learn(self) -> None:
        """Scores the windows that are new since the last call."""
        lengths = self.windows.n_pairs()
        known = len(self.links)
        if len(lengths) == known:
            return
        pairs = self.windows.pairs()[int(self.links.sum()) :]
        lengths = lengths[known:]
        n, best, at_hand = self._head(pairs)
        starts = starts_of(lengths)
        counts, best, n_rest = (np.add.reduceat(each, starts) for each in (n, best, (~at_hand).astype(np.int64)))
        for at in np.flatnonzero(n_rest).tolist():
            found = slice(int(starts[at]), int(starts[at] + lengths[at]))
            self.rest[known + at] = pairs[found][~at_hand[found]].tolist()
        self.links, self.counts = np.concatenate([self.links, lengths]), np.concatenate([self.counts, counts])
        self.best, self.n_rest = np.concatenate([self.best, best]), np.concatenate([self.n_rest, n_rest])


@lru_cache(1)
def known_scores(head_id: str) -> list[Scored]:
    """Holds the scores of a worker's windows under one head, once they are made."""
    return []


def rest_of(windows: np.ndarray, bounds: np.ndarray, scored: Scored) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Pairs of each text that the head does not have, and how often each is linked in it."""
    pairs, times = [], []
    lacking = scored.n_rest[windows] > 0
    for start, end in zip(bounds, bounds[1:], strict=False):
        here = windows[start:end][lacking[start:end]].tolist()
        found = np.array([pair for at in here for pair in scored.rest[at]], np.int64)
        found, n = np.unique(found, return_counts=True)
        pairs.append(found)
        times.append(n.astype(np.int64))
    return pairs, times


def per_text(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    sums = np.concatenate([[0], np.cumsum(values)])
    return pa.array(np.diff(sums[bounds]), pa.int64())


def figures(
    path_a: str, path_b: str, shared_head: Broadcast, head_id: str, with_groups: bool
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The figures of each text, as far as the head has its pairs, and the pairs that it does not have."""
    names = [*FIGURE_NAMES, "row", "rest", "rest_times", *(["groups"] if with_groups else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted_parts.cache_clear()
        held, row = known_scores(head_id), TaskContext.get().partitionId() << 40
        if not held:
            held.append(Scored(Parts(tokenizers_of(path_a, path_b), True), shared_head.value))
        scored = held[0]
        for batch in batches:
            for at in range(0, batch.num_rows, TEXT_ROWS):
                part = batch.slice(at, TEXT_ROWS)
                counts, windows, bounds = scored.parts(part.column("text").to_pylist())
                scored.learn()
                texts, numbers = scored.windows.texts, windows.tolist()
                groups = [";".join([texts[w] for w in numbers[x:y]]) for x, y in zip(bounds, bounds[1:], strict=False)]
                rest, times = rest_of(windows, bounds, scored)
                columns = [
                    part.column("doc_id"),
                    *(pa.array(each, pa.int64()) for each in counts),
                    *(per_text(values[windows], bounds) for values in (scored.links, scored.best, scored.counts)),
                    pa.array([hashlib.sha256(text.encode()).hexdigest() if text else "" for text in groups], pa.string()),
                    pa.array(np.arange(row, row + part.num_rows)),
                    lists(rest, pa.int64()),
                    lists(times, pa.int64()),
                    *([pa.array(groups, pa.string())] if with_groups else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                row += part.num_rows
                if scored.parts.full():
                    scored.forget()

    return run


FIGURE_NAMES = [field.split(" ")[0] for field in FIGURES.split(", ")]


def default_tokenizers() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def linked_pairs(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, text_column: str = "text") -> DataFrame:
    """(pair, a, b, n, best): how many links of all texts hold two ids linked, and whether none of b's pairs has more.

    A b has at most as many pairs as A has ids, so what is compared in one group is bounded.
    """
    path_a, path_b = path_a or default_tokenizers()[0], path_b or default_tokenizers()[1]
    ship_package(docs.sparkSession)
    width = len(PieceTokens(path_b).vocabulary.tokens)
    found = docs.select(as_binary(F.col(text_column)).alias("text")).mapInArrow(count_links(path_a, path_b), PAIR)
    pairs = found.groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = pairs.select("pair", F.expr(f"pair div {width}").alias("a"), (F.col("pair") % width).alias("b"), "n")
    most = F.max("n").over(Window.partitionBy("b"))
    return written(pairs.withColumn("best", F.col("n") == most), "pairs")


def head_of(pairs: DataFrame, most: int) -> tuple[int, pa.Table]:
    """The count from which on pairs are among the most frequent ones, at most so many, and these pairs.

    The count is a power of two, found from how many pairs have counts up to each.
    """
    sizes = pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("bits")).count().orderBy(F.desc("bits")).collect()
    held, least = 0, 64
    for size in sizes:
        held += size["count"]
        if held > most:
            break
        least = size["bits"]
    if least == 64:
        return 1 << 62, pairs.limit(0).select("pair", "n", "best").toArrow()
    return 1 << least, pairs.filter(F.col("n") >= (1 << least)).select("pair", "n", "best").toArrow()


def align(
    docs: DataFrame,
    path_a: str | None = None,
    path_b: str | None = None,
    head_pairs: int = HEAD_PAIRS,
    with_groups: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]): one row per row of docs.

    A is the byte-level tokenizer, which gets a space before the text, B the one of sentence pieces. A text that is null or
    empty, or that one of them does not give back byte by byte, has no tokens: zeros and an empty hash. Repeated rows
    count each for itself; a null id stays null; no rows give no rows; other columns are not read.
    """
    path_a, path_b = path_a or default_tokenizers()[0], path_b or default_tokenizers()[1]
    spark = docs.sparkSession
    pairs = linked_pairs(docs, path_a, path_b, text_column)
    least, head = head_of(pairs, head_pairs)
    shared = spark.sparkContext.broadcast(Head(head))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), as_binary(F.col(text_column)).alias("text"))
    schema = FIGURES + REST + (", groups string" if with_groups else "")
    made = written(rows.mapInArrow(figures(path_a, path_b, shared, uuid.uuid4().hex, with_groups), schema), "aligned")
    names = [*FIGURE_NAMES, *(["groups"] if with_groups else [])]
    lacking = made.filter(F.size("rest") > 0)
    links = lacking.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("link"))
    links = links.select("row", F.col("link.rest").alias("pair"), F.col("link.rest_times").alias("times"))
    rare = pairs.filter(F.col("n") < least).select("pair", "n", F.col("best").cast("long").alias("best"))
    sums = links.join(rare, "pair").groupBy("row").agg(
        F.sum(F.col("n") * F.col("times")).alias("more_sum"), F.sum(F.col("best") * F.col("times")).alias("more_best")
    )
    filled = (
        lacking.join(sums, "row")
        .withColumn("n_best", F.col("n_best") + F.col("more_best"))
        .withColumn("count_sum", F.col("count_sum") + F.col("more_sum"))
    )
    return made.filter(F.size("rest") == 0).select(*names).unionByName(filled.select(*names))
