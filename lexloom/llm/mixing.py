"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.text import WORD
from lexloom.operators.ranking import numbered
from lexloom.session import written

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: The one random offset of the sample, in [0, 1).
OFFSET = 0.37454011


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_no, source_size, n_rows, target) from rows (source, size).

    Sources in code point order, null last, get the weights in turn and share the total size by them. A target above
    `max_repeats` times its source's size is cut to that, and the excess goes to the others by weight, again and again:
    all uncut targets are weight * level, and the level rises until no further source is cut. One row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    totals = totals.withColumn("no_source", F.col("source").isNull())
    ranked = numbered(totals, ["no_source", "source"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.select(
        "source",
        F.col("rn").alias("source_no"),
        "source_size",
        "n_rows",
        weight.alias("weight"),
        (F.col("source_size") * max_repeats).alias("most"),
    )
    ranked = written(ranked, "sources")
    total, level, before = ranked.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1.0
    while level != before:
        cut = F.col("most") < F.col("weight") * F.lit(level)
        most, weight = ranked.agg(F.sum(F.when(cut, F.col("most"))), F.sum(F.when(~cut, F.col("weight")))).first()
        before, level = level, (total - (most or 0)) / weight if weight else level
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level))
    return ranked.select("source", "source_no", "source_size", "n_rows", target.alias("target"))


def mix(
    docs: DataFrame,
    key: list[Column],
    source: Column,
    size: Column,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    offset: float = OFFSET,
) -> DataFrame:
    """The key columns of each row with size, source_size, target and copies, how often the mix takes the row.

    Every row of a source has the same expected number of copies, target / source_size. Their running sum plus one
    offset crosses so many whole numbers at each row, and the row is taken that often. Rows stand in order of size, so
    that every stretch of sizes is sampled evenly and the words taken stay within about one document of the target; rows
    of one size stand in the order of the md5 of their first key, then of the keys. Only keys, sources and sizes move.
    Row numbers come from counts per range, so a source with most of the rows is spread over all tasks.

    Texts without words have size 0 and may be taken. A source without words has target 0 and nothing is taken. Repeated
    rows are rows of their own.
    """
    names = [f"key{i}" for i in range(len(key))]
    rows = docs.select(*(column.alias(name) for column, name in zip(key, names, strict=True)), source.alias("source"), size.alias("size"))
    rows = rows.withColumn("no_source", F.col("source").isNull()).withColumn("mark", F.md5(F.col("key0").cast("string")))
    placed = numbered(rows, ["no_source", "source", "size", "mark", *names])
    targets = source_targets(placed.select("source", "size"), weights, max_repeats)
    starts = placed.groupBy("source").agg((F.min("rn") - 1).alias("before"))
    targets = written(
        targets.join(starts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets"
    )
    of = targets.withColumnRenamed("source", "s")
    joined = placed.join(of, F.col("source").eqNullSafe(F.col("s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = F.col("rn") - F.col("before")
    copies = F.floor(at * rate + F.lit(offset)) - F.floor((at - 1) * rate + F.lit(offset))
    return joined.select(*names, "size", "source_size", "target", copies.cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, text_column: str = "text", source_column: str = "source", id_column: str = "doc_id") -> DataFrame:
    """The rows of docs themselves, each as often as the mix takes it, with docs' columns.

    Rows are told apart by their id and a hash of all their columns; rows alike in all are one row taken as often as they
    are together.
    """
    whole = F.struct(*(docs[name] for name in docs.columns))
    marked = docs.select(
        docs[id_column].alias("id"),
        F.xxhash64(*docs.columns).alias("mark"),
        docs[source_column].alias("source"),
        docs[text_column].alias("text"),
        whole.alias("row"),
    )
    chosen = mix(marked, [F.col("id"), F.col("mark")], F.col("source"), n_words(F.col("text")))
    chosen = chosen.groupBy("key0", "key1").agg(F.sum("copies").cast("int").alias("copies")).filter("copies > 0")
    rows = marked.select("id", "mark", "row").dropDuplicates(["id", "mark"])
    rows = rows.join(chosen, F.col("id").eqNullSafe(F.col("key0")) & (F.col("mark") == F.col("key1")))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
