"""Fingerprints of texts: the k smallest hashes of their shingles."""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.text import SHINGLE_WORDS, WordHashes, as_binary, text_shingles
from lexloom.session import ship_package

SKETCH_SIZE = 128
#: Hashes are cut to 48 bits, so that each is eight characters of a fingerprint.
HASH_BYTES, HASH_CHARS = 6, 8
HASH_SPACE = 1 << (8 * HASH_BYTES)
#: Bytes of text that one range of documents holds on average, and how many ranges there are at most.
RANGE_BYTES, MOST_RANGES, SAMPLES_PER_RANGE = 24 << 20, 20_000, 20


def bottom(hashes: np.ndarray, size: int = SKETCH_SIZE) -> np.ndarray:
    """The sketch of a set of 64-bit hashes that come in ascending order."""
    return np.unique(hashes[: size + 8] >> np.uint64(64 - 8 * HASH_BYTES))[:size]


def encode(sketch: np.ndarray) -> str:
    raw = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES :]
    return base64.b64encode(raw.tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, HASH_BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - HASH_BYTES :] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def merge(sketches: list[np.ndarray], size: int = SKETCH_SIZE) -> np.ndarray:
    """The sketch of the union of the sets."""
    return np.unique(np.concatenate(sketches))[:size] if sketches else np.zeros(0, np.uint64)


def distinct(sketch: np.ndarray, size: int = SKETCH_SIZE) -> float:
    """Number of shingles: exact while the sketch isn't full."""
    return float(len(sketch)) if len(sketch) < size else (size - 1) * HASH_SPACE / float(sketch[-1])


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SKETCH_SIZE) -> float:
    """Shared part of the two sets' union; 1 for two empty sets."""
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    union = both[np.concatenate([[True], ~twice])] if len(both) else both
    if not len(union):
        return 1.0
    union = union[:size]
    return float((both[1:][twice] <= union[-1]).sum()) / len(union)


def containment(a: np.ndarray, b: np.ndarray, size: int = SKETCH_SIZE) -> float:
    """Part of the first set that lies in the second; 1 for an empty first set."""
    if not len(a):
        return 1.0
    alike = resemblance(a, b, size)
    return min(1.0, alike * distinct(merge([a, b], size), size) / distinct(a, size))


def merged(rows: DataFrame, key: str, fingerprint: str = "fingerprint", size: int = SKETCH_SIZE) -> DataFrame:
    """(key, fingerprint) of the union of each key's sets, from fingerprints of its parts.

    Every value is a row, and each task keeps the `size` smallest of a key before any are moved.
    """
    places = F.sequence(F.lit(0), (F.length(fingerprint) / HASH_CHARS).cast("int") - 1)
    values = F.transform(places, lambda at: F.substring(F.col(fingerprint), at * HASH_CHARS + 1, F.lit(HASH_CHARS)))
    filled = F.when(F.length(fingerprint) > 0, values).otherwise(F.array().cast("array<string>"))
    each = rows.select(F.col(key), F.explode_outer(filled).alias("value")).distinct().withColumn("_rank", F.hex(F.unbase64("value")))
    each = each.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("_rank"))).filter(F.col("rn") <= size)
    ordered = F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("_rank", "value"))))
    return each.groupBy(key).agg(F.array_join(F.transform(ordered, lambda pair: pair["value"]), "").alias("fingerprint"))


class Sketcher:
    """Sketches of texts in one task."""

    def __init__(self, size: int = SKETCH_SIZE, width: int = SHINGLE_WORDS):
        self.size, self.width, self._known = size, width, WordHashes()

    def __call__(self, text: bytes | None) -> np.ndarray:
        return bottom(text_shingles(text, self._known, self.width), self.size)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SKETCH_SIZE) -> DataFrame:
    """(doc_id, fingerprint, n_distinct) of every row's whole text; a text without words has an empty fingerprint.

    Repeated rows and null ids come out as they went in. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), as_binary(F.col(text_column)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(size)
        for batch in batches:
            found = [sketch(text.as_py()) for text in batch.column("text")]
            made = [pa.array(map(encode, found), pa.string()), pa.array([distinct(one, size) for one in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "fingerprint", "n_distinct"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fingerprint string, n_distinct double")


def _bounds(rows: DataFrame, size: int) -> list[tuple[int, int]]:
    """Where ranges of (id, t) begin, from a sample; as many as the bytes of text ask for."""
    n, held = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    ranges = min(MOST_RANGES, -(-(held or 0) // size))
    if ranges < 2:
        return []
    share = min(1.0, SAMPLES_PER_RANGE * ranges / n)
    sample = sorted((row[0], row[1]) for row in rows.select("id", "t").sample(share, 1).collect())
    return sorted({sample[len(sample) * cut // ranges] for cut in range(1, ranges)}) if sample else []


def with_next(docs: DataFrame, id_column: str, text_column: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(range, last, id, no_id, t, text) in the order of ids within each partition: each range is followed by the first
    row of the next one, marked `last`, and the last range by the first row of all.

    Ids and hashes of texts decide the order and the ranges, so rows that share an id, or have none, can lie in several
    ranges. Texts are moved once; the rows sent twice are one per range.
    """
    text = F.col(text_column).cast("string")
    order = F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(order.alias("id"), F.col(id_column).isNull().alias("no_id"), F.xxhash64(text).alias("t"), as_binary(text).alias("text"))
    bounds = _bounds(rows, range_bytes)

    @F.arrow_udf("int")
    def range_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        pairs = zip(ids.to_pylist(), hashes.to_pylist(), strict=True)
        return pa.array([bisect_right(bounds, pair) for pair in pairs], pa.int32())

    rows = rows.withColumn("range", range_of("id", "t") if bounds else F.lit(0))
    firsts = rows.groupBy("range").agg(F.min(F.struct("id", "t")).alias("first")).select("range", "first.*").orderBy("range").collect()
    if not firsts:
        return rows.withColumn("last", F.lit(False))
    follows = [(before["range"], row["id"], row["t"]) for before, row in zip(firsts, firsts[1:] + firsts[:1], strict=True)]
    spark = docs.sparkSession
    follow = F.broadcast(spark.createDataFrame(follows, "range int, id long, t long"))
    again = rows.drop("range").join(follow, ["id", "t"]).dropDuplicates(["range", "id", "t"]).withColumn("last", F.lit(True))
    every = rows.withColumn("last", F.lit(False)).unionByName(again)
    # A range is a partition by its number: a hash of the numbers would put several in one.
    return every.repartitionById(len(bounds) + 1, "range").sortWithinPartitions("range", "last", "id", "t")


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SKETCH_SIZE) -> DataFrame:
    """Every text's fingerprint beside that of an edit of it, and how alike the sketches say they are.

    The edit replaces the last half of the code points by the first as many of the next document by id; the last document
    is followed by the first. Rows of one id stand in the order of a hash of their texts, rows without an id come first,
    and one row alone is followed by itself. A null text is empty; two empty fingerprints are alike by 1.
    """
    ship_package(docs.sparkSession)
    ordered = with_next(docs, id_column, text_column)
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [part.split()[0] for part in kinds.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, before = Sketcher(size), None
        for batch in batches:
            made = []
            for at, last, row_id, no_id, raw in zip(
                *(batch.column(name).to_pylist() for name in ("range", "last", "id", "no_id", "text")), strict=True
            ):
                text, own = (raw or b"").decode("utf-8", "replace"), sketch(raw)
                if before is not None and before[0] == at:
                    _, kept_id, kept_text, kept = before
                    half = len(kept_text) // 2
                    edited = (kept_text[: len(kept_text) - half] + text[:half]).encode()
                    other = sketch(edited)
                    likeness = resemblance(kept, other, size), resemblance(kept, own, size)
                    made.append((kept_id, len(kept_text), hashlib.sha256(edited).hexdigest(), encode(kept), encode(other), *likeness))
                before = None if last else (at, None if no_id else row_id, text, own)
            if made:
                columns = [pa.array(column, kind) for column, kind in zip(zip(*made, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return ordered.select("range", "last", "id", "no_id", "text").mapInArrow(run, kinds)
