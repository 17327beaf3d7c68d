"""Language of a text by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.text import map_batches
from lexloom.session import ship_package, written

GRAM_LENGTHS = (1, 2, 3)
SMOOTHING = 0.5
UNKNOWN = "und"
#: The matrix that goes to all tasks has languages * buckets entries of 4 bytes, and never more than this.
MATRIX_BYTES = 64 << 20
MOST_BUCKET_BITS = 16
#: A long text is taken in stretches of this many characters, which overlap by the longest n-gram.
STRETCH = 1 << 18
#: Rows of counts that one task holds before it passes them on.
LANGUAGES_HELD = 32

SPACE = 32
STEP, SPREAD = np.uint64(1_114_127), np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def letter_table() -> np.ndarray:
    """For every code point: its lower-case letter, or a space where it is no letter."""
    table = np.full(sys.maxunicode + 1, SPACE, np.uint32)
    for code in range(sys.maxunicode + 1):
        if (char := chr(code)).isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def letters(text: str) -> Iterator[np.ndarray]:
    """Stretches of a text's letters in lower case, with one space in place of anything between; none without letters."""
    overlap = max(GRAM_LENGTHS) - 1
    for start in range(0, len(text), STRETCH):
        part = text[start : start + STRETCH + overlap]
        codes = letter_table()[np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)]
        blank = codes == SPACE
        if blank.all():
            continue
        codes = codes[~blank | np.concatenate([[True], ~blank[:-1]])]
        before = [SPACE] if start == 0 and codes[0] != SPACE else []
        after = [SPACE] if start + STRETCH >= len(text) and codes[-1] != SPACE else []
        yield np.concatenate([before, codes, after]).astype(np.uint64)


def gram_buckets(codes: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of all n-grams of a stretch."""
    found, hashed = [], np.zeros(len(codes), np.uint64)
    for length in range(1, max(GRAM_LENGTHS) + 1):
        if length > len(codes):
            break
        hashed = hashed[: len(codes) - length + 1] * STEP + codes[length - 1 :]
        if length in GRAM_LENGTHS:
            found.append(((hashed + np.uint64(length)) * SPREAD) >> np.uint64(64 - bits))
    return np.concatenate(found).astype(np.int64)


def gram_counts(rows: DataFrame, bits: int) -> DataFrame:
    """(lang, bucket, n) over rows (lang, text). Each task sums up first; bucket -1 counts texts."""
    ship_package(rows.sparkSession)
    buckets = 1 << bits
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def emit(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, counts in sums.items():
            filled = np.flatnonzero(counts)
            columns = [pa.array([lang] * len(filled)), pa.array(filled - 1, pa.int32()), pa.array(counts[filled])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        sums.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                lang, text = batch.column("lang")[row].as_py(), batch.column("text")[row].as_py()
                if lang not in sums:
                    if len(sums) == LANGUAGES_HELD:
                        yield from emit(sums)
                    sums[lang] = np.zeros(buckets + 1, np.int64)
                sums[lang][0] += 1
                for codes in letters(text or ""):
                    found = gram_buckets(codes, bits)
                    if len(found) * 4 < buckets:
                        np.add.at(sums[lang], found + 1, 1)
                    else:
                        sums[lang][1:] += np.bincount(found, minlength=buckets)
        yield from emit(sums)

    counts = rows.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long")
    return counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Log probabilities (bucket, language) and log shares of the languages, in order of their names."""

    def __init__(self, languages: list[str], shares: np.ndarray, matrix: np.ndarray, bits: int):
        self.languages, self.shares, self.matrix, self.bits = languages, shares, matrix, bits

    def predict(self, text: str | None) -> tuple[str, float]:
        total, any_letter = self.shares.copy(), False
        for codes in letters(text or ""):
            any_letter = True
            total += self.matrix[gram_buckets(codes, self.bits)].sum(axis=0, dtype=np.float64)
        if not any_letter or not self.languages:
            return UNKNOWN, 0.0
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def train(rows: DataFrame) -> LanguageModel:
    """Fits on all rows (lang, text) with a language. Counting is Spark's; only the bounded matrix comes to the driver."""
    rows = rows.filter("lang is not null")
    languages = [row[0] for row in rows.select("lang").distinct().orderBy("lang").collect()]
    bits = min(MOST_BUCKET_BITS, (MATRIX_BYTES // 4 // max(1, len(languages))).bit_length() - 1)
    counts = np.zeros((1 << bits, len(languages)))
    texts = np.zeros(len(languages))
    at = {lang: column for column, lang in enumerate(languages)}
    if languages:
        found = written(gram_counts(rows, bits), "gram_counts").toArrow()
        columns = np.array([at[lang] for lang in found.column("lang").to_pylist()], np.int64)
        buckets, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
        grams = buckets >= 0
        counts[buckets[grams], columns[grams]] = n[grams]
        texts[columns[~grams]] = n[~grams]
    smooth = counts + SMOOTHING
    matrix = np.log(smooth / smooth.sum(axis=0, keepdims=True)).astype(np.float32)
    return LanguageModel(languages, np.log(texts / max(1.0, texts.sum())), matrix, bits)


class Predictions:
    def __init__(self, shared):
        self.shared = shared

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        model = self.shared.value
        found = [model.predict(text.as_py()) for text in batch.column("text")]
        made = [pa.array([lang for lang, _ in found], pa.string()), pa.array([score for _, score in found], pa.float64())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its whole text alone.

    `und` with score 0 where the text is null, has no letter, or nothing was learned; the first name wins a tie. Repeated
    rows and null ids come out as they went in. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, Predictions(shared), f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    """Whether a document is kept from training; a row without an id is in no fold."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))


def languages_of(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): fits on the rows with an id that are not held out, and predicts all."""
    learned = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    model = train(learned.select("lang", "text").filter("text is not null"))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
