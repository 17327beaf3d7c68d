"""Repeated runs of lines, by a suffix array of line ids that is sorted by prefix doubling."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.cuts import LINE, minimal_windows, n_words, parts, without
from lexloom.llm.text import as_binary, map_batches, row_key
from lexloom.operators.ranking import numbered
from lexloom.session import written, written_counted

#: A run counts as repeated text from so many words on; lines of one or two words are mostly headings and marks.
LEAST_WORDS = 3
PLACE = ["k_id", "k_text", "i"]


class Lines:
    """Place, digest and windows of every line with words in a batch of texts."""

    def __init__(self, least_words: int):
        self.least_words = least_words

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for k_id, k_text, text in zip(*(batch.column(name).to_pylist() for name in ("k_id", "k_text", "text")), strict=True):
            lines = [line.split() for line in parts(text, LINE)]
            lines = [words for words in lines if words]
            windows: dict[int, list[int]] = {}
            for start, length in minimal_windows([n_words(words) for words in lines], self.least_words, 1):
                windows.setdefault(start, []).append(length)
            for at, words in enumerate(lines):
                rows.append((k_id, k_text, at, xxhash.xxh3_128_digest(b" ".join(words)), windows.get(at, [])))
        if not rows:
            return None
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()))
        columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["k_id", "k_text", "i", "line", "lengths"])


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose `by` columns occur more than once, with their rank: the place of their values in order.

    Values are counted before they are put in order, and ranges are numbered by their counts, so that neither a frequent
    value nor the order of all is the work of one task.
    """
    names = numbered(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), by)
    return rows.join(written(names.select(*by, F.col("rn").alias("rank")), "ranks"), by)


def repeated_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(k_id, k_text, start, length): windows of lines that stand earlier too, in this document or one before it.

    Lines are compared without outer and repeated white space; lines without words are passed over. The suffixes of all
    line sequences are ranked by their first line, then by their first 2, 4, ... lines: the rank of 2w lines at a line is
    that of the pair of ranks at the line and w lines on. Only suffixes whose prefix occurs again stay, so the rounds
    shrink, and they end when no window that matters is longer. Suffixes with equal ranks are an interval of the suffix
    array whose common prefix has at least that many lines; for a window of any other length, the ranks of its first and
    its last 2^j lines say which interval it belongs to. Of each interval all but the first are repeats. The windows are
    the least ones with `least_words` words, which together cover every maximal repeated run of at least that size. Two
    characters of a script without spaces count as a word.

    First is the smallest id, then the hash of the text, then the line. No run crosses documents. Null and empty texts
    have no lines, and repeated rows are one document.
    """
    rows = docs.select(*row_key(id_column, text_column), as_binary(F.col(text_column)).alias("text"))
    rows = rows.withColumn("k_id", F.col("k_id").cast("long"))
    lines = map_batches(rows, Lines(least_words), "k_id long, k_text long, i int, line binary, lengths array<int>")
    lines = written(lines.dropDuplicates(PLACE), "lines")
    level = written(_ranked(lines, ["line"]).select(*PLACE, "rank", "lengths"), "level")
    windows = level.select(*PLACE, F.explode("lengths").alias("length"))
    longest = windows.agg(F.max("length")).first()[0] or 0
    level, found, width = level.drop("lengths"), [], 1
    while width <= longest:
        here = windows.filter((F.col("length") >= width) & (F.col("length") < 2 * width))
        here = _with_rank(here, level, F.col("i"), "rank")
        found.append(_with_rank(here, level, F.col("i") + F.col("length") - width, "rank_last"))
        if 2 * width > longest:
            break
        pairs = _with_rank(level.withColumnRenamed("rank", "rank_here"), level, F.col("i") + width, "rank_after")
        level, n = written_counted(_ranked(pairs, ["rank_here", "rank_after"]).select(*PLACE, "rank"), "level")
        width *= 2
        if not n:
            break
    if not found:
        return windows.select("k_id", "k_text", F.col("i").alias("start"), "length")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = written(every, "windows")
    interval = ["length", "rank", "rank_last"]
    firsts = every.groupBy(*interval).agg(F.min(F.struct(*PLACE)).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = written(firsts.drop("n"), "intervals")
    repeats = every.join(firsts, interval).filter(~F.struct(*PLACE).eqNullSafe(F.col("first")))
    return repeats.select("k_id", "k_text", F.col("i").alias("start"), "length")


def _with_rank(rows: DataFrame, level: DataFrame, at: Column, name: str) -> DataFrame:
    """Rows with the rank of the suffix at another line of their document, where it has one."""
    ranks = level.select(
        F.col("k_id").alias("of_id"), F.col("k_text").alias("of_text"), F.col("i").alias("of_line"), F.col("rank").alias(name)
    )
    same = F.col("k_id").eqNullSafe(F.col("of_id")) & (F.col("k_text") == F.col("of_text")) & (at == F.col("of_line"))
    return rows.join(ranks, same).drop("of_id", "of_text", "of_line")


def line_deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(row, text, n_parts, n_removed): texts without the lines of later copies of repeated runs."""
    return without(docs, repeated_runs(docs, id_column, text_column, least_words), LINE, id_column, text_column)
