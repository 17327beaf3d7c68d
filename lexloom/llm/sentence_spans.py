"""Repeated passages, by hashes of sliding spans of sentences."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.cuts import SENTENCE, minimal_windows, n_words, parts, without
from lexloom.llm.text import as_binary, map_batches, row_key
from lexloom.session import written

#: A span is a run of sentences, as many of them as make so many words; one that is long enough is a span by itself.
LEAST_SENTENCES, LEAST_WORDS = 1, 20


class Spans:
    """Place and 96-bit hash of every span of sentences in a batch of texts."""

    def __init__(self, least_sentences: int, least_words: int):
        self.least_sentences, self.least_words = least_sentences, least_words

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        columns: tuple[list, ...] = ([], [], [], [], [], [])
        for k_id, k_text, text in zip(*(batch.column(name).to_pylist() for name in ("k_id", "k_text", "text")), strict=True):
            sentences = [words for part in parts((text or b"").lower(), SENTENCE) if (words := part.split())]
            marks = [xxhash.xxh3_128_digest(b" ".join(words)) for words in sentences]
            for start, length in minimal_windows([n_words(words) for words in sentences], self.least_words, self.least_sentences):
                mark = xxhash.xxh3_128_intdigest(b"".join(marks[start : start + length]))
                for column, value in zip(
                    columns, (k_id, k_text, start, length, (mark >> 64) - (1 << 63), (mark & 0xFFFFFFFF) - (1 << 31)), strict=True
                ):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
        made = [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(made, names=["k_id", "k_text", "start", "length", "h", "c"])


def repeated_spans(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_sentences: int = LEAST_SENTENCES,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """(k_id, k_text, start, length): spans of sentences that stand earlier too, in this document or one before it.

    A sentence ends at white space after . ! or ?, after a full-width end mark, or at a line end; A-Z and white space don't
    matter, and two characters of a script without spaces count as a word. Hashes are first
    counted, with a partial step in every task and nothing but the first place beside them; then the places of those that
    repeat are looked up by a join, whose hot keys Spark can split. First is the smallest id, then the hash of the text,
    then the sentence. Null and empty texts have no spans; repeated rows are one document.
    """
    rows = docs.select(*row_key(id_column, text_column), as_binary(F.col(text_column)).alias("text"))
    rows = rows.withColumn("k_id", F.col("k_id").cast("long"))
    spans = map_batches(
        rows, Spans(least_sentences, least_words), "k_id long, k_text long, start int, length int, h long, c int"
    )
    place = F.struct("k_id", "k_text", "start")
    firsts = spans.groupBy("h", "c").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
    firsts = written(firsts.select("h", "c", "first"), "firsts")
    return spans.join(firsts, ["h", "c"]).filter(~place.eqNullSafe(F.col("first"))).select("k_id", "k_text", "start", "length")


def passages_removed(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_sentences: int = LEAST_SENTENCES,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """(row, text, n_parts, n_removed): texts without the sentences that any repeated span but the first covers."""
    spans = repeated_spans(docs, id_column, text_column, least_sentences, least_words)
    return without(docs, spans, SENTENCE, id_column, text_column)
