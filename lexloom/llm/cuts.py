"""Cutting texts into parts, the least windows of parts that matter, and texts without some of their parts."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.text import TEXT_ROWS, row_key
from lexloom.session import ship_package

#: A line with its line end; a sentence with the white space after it, which full-width end marks (U+3002, U+FF01, U+FF1F)
#: do without. Both cover the whole text.
LINE = re.compile(rb"\n")
SENTENCE = re.compile(rb"[.!?][\x20\x09-\x0d]+|\n[\x20\x09-\x0d]*|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)[\x20\x09-\x0d]*")

#: Thai, Lao, Burmese, Khmer, kana and Chinese characters stand without spaces; about two of them make a word. The second
#: pattern has the bytes that begin them, so that most texts need no decoding.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
MAY_BE_UNSPACED = re.compile(rb"[\xe0\xe1\xe3-\xe9\xef\xf0]")


def parts(text: bytes | None, end: re.Pattern) -> list[bytes]:
    """The text cut after every match of `end`; joined they are the text."""
    cuts = [match.end() for match in end.finditer(text or b"")]
    bounds = [0, *cuts, len(text or b"")]
    return [text[a:b] for a, b in zip(bounds, bounds[1:], strict=False) if a < b]


def n_words(words: list[bytes]) -> int:
    """How many words a part has; characters that stand without spaces count in pairs."""
    extra = 0
    for word in words:
        if MAY_BE_UNSPACED.search(word):
            extra += max(0, (len(UNSPACED.findall(word.decode("utf-8", "replace"))) + 1) // 2 - 1)
    return len(words) + extra


def minimal_windows(words: list[int], least_words: int, least_parts: int) -> list[tuple[int, int]]:
    """(start, length) of the shortest windows from each start on and up to each end that have so many words and parts.

    Any longer window is covered by such windows inside it, so what holds for every part of the one is known from these.
    """
    sums = [0]
    for n in words:
        sums.append(sums[-1] + n)
    found: dict[tuple[int, int], None] = {}
    end = 0
    for start in range(len(words)):
        end = max(end, start + least_parts)
        while end <= len(words) and sums[end] - sums[start] < least_words:
            end += 1
        if end > len(words):
            break
        found[start, end - start] = None
    start = len(words)
    for end in range(len(words), 0, -1):
        start = min(start, end - least_parts)
        while start >= 0 and sums[end] - sums[start] < least_words:
            start -= 1
        if start < 0:
            break
        found[start, end - start] = None
    return list(found)


def without(docs: DataFrame, removed: DataFrame, end: re.Pattern, id_column: str, text_column: str) -> DataFrame:
    """(row, text, n_parts, n_removed): each row of docs, its text without the removed parts, and how many parts it had.

    removed has (k_id, k_text, start, length) of parts with words, counted from 0. A text that loses nothing stays as it
    is, null included. Rows with the same id and text lose the same parts.
    """
    ship_package(docs.sparkSession)
    spans = removed.groupBy(F.col("k_id").alias("of_id"), F.col("k_text").alias("of_text")).agg(
        F.collect_set(F.struct("start", "length")).alias("spans")
    )
    whole = F.struct(*(docs[name] for name in docs.columns)).alias("row")
    rows = docs.select(*row_key(id_column, text_column), whole)
    same = F.col("k_id").eqNullSafe(F.col("of_id")) & (F.col("k_text") == F.col("of_text"))
    rows = rows.join(spans, same, "left").select("row", "spans")

    @F.arrow_udf("text binary, n_parts long, n_removed long")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        parts = []
        for start in range(0, len(texts), TEXT_ROWS):
            rows = zip(texts.slice(start, TEXT_ROWS).to_pylist(), spans.slice(start, TEXT_ROWS).to_pylist(), strict=True)
            made = zip(*(_cut(text, gone, end) for text, gone in rows), strict=True)
            columns = [pa.array(column, kind) for column, kind in zip(made, (pa.binary(), pa.int64(), pa.int64()), strict=True)]
            parts.append(pa.StructArray.from_arrays(columns, names=["text", "n_parts", "n_removed"]))
        return pa.concat_arrays(parts) if parts else pa.nulls(0, pa.struct([("text", pa.binary()), ("n_parts", pa.int64()), ("n_removed", pa.int64())]))

    text = F.col("row").getField(text_column).cast("string")
    made = rows.select("row", "spans", cut(text.cast("binary"), F.col("spans")).alias("made"))
    return made.select(
        "row",
        F.when(F.col("made.n_removed") > 0, F.col("made.text").cast("string")).otherwise(text).alias("text"),
        "made.n_parts",
        "made.n_removed",
    )


def _cut(text: bytes | None, spans, end: re.Pattern) -> tuple[bytes | None, int, int]:
    each = parts(text, end)
    filled = [at for at, part in enumerate(each) if part.strip()]
    if spans is None or not len(spans):
        return None, len(filled), 0
    gone = {filled[at] for span in spans for at in range(span["start"], span["start"] + span["length"])}
    return b"".join(part for at, part in enumerate(each) if at not in gone), len(filled), len(gone)


def replaced(cut: DataFrame, docs: DataFrame, text_column: str, length_column: str | None = None) -> DataFrame:
    """The rows with docs' columns and the new text, without those that lost all their parts."""
    new = {text_column: F.col("text")}
    if length_column in docs.columns:
        new[length_column] = F.length("text").cast(docs.schema[length_column].dataType)
    left = cut.filter("n_removed = 0 or n_removed < n_parts")

    def column(name: str) -> Column:
        old = F.col("row").getField(name)
        return F.when(F.col("n_removed") > 0, new[name]).otherwise(old) if name in new else old

    return left.select(*(column(name).alias(name) for name in docs.columns))
