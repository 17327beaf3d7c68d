"""Near-duplicate texts by min-max hashing."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.graph import components
from lexloom.llm.text import FOLD, SHINGLE_WORDS, WordHashes, as_binary, lists, map_batches, mixed, signed, text_shingles
from lexloom.session import written

#: 84 permutations give 168 values: 28 bands of three minima and three maxima. A pair at 0.85 shares no band once in
#: 600,000 times, one at 0.5 shares some band in a third of the cases and one at 0.2 almost never.
BANDS, PERMUTATIONS_PER_BAND = 28, 3
LINK_PERCENT = 85
SHINGLES_PER_STEP = 2048
SETS_KEPT = 64


class Signatures:
    """Set size, digest of the set and band hashes of each text in a batch."""

    def __init__(self, bands: int, per_band: int, width: int, seed: int = 7):
        self.bands, self.per_band, self.width, self.seed = bands, per_band, width, seed
        self._known = None

    def __getstate__(self):
        return self.__dict__ | {"_known": None}

    def _start(self) -> None:
        made = np.random.default_rng(self.seed).integers(0, 2**63, (2, self.bands * self.per_band), dtype=np.uint64)
        self._times, self._plus = (made[0] * np.uint64(2) + np.uint64(1))[:, None], mixed(made[1])[:, None]
        self._salt = mixed(np.arange(1, self.bands + 1, dtype=np.uint64) * FOLD)
        self._known = WordHashes()

    def band_hashes(self, found: np.ndarray) -> np.ndarray:
        """One pass of each permutation over the set gives two values, its least and its greatest hash."""
        low, high = None, None
        for start in range(0, len(found), SHINGLES_PER_STEP):
            hashed = self._times * found[None, start : start + SHINGLES_PER_STEP] + self._plus
            least, most = hashed.min(axis=1), hashed.max(axis=1)
            low = least if low is None else np.minimum(low, least)
            high = most if high is None else np.maximum(high, most)
        values = np.concatenate([low.reshape(self.bands, -1), high.reshape(self.bands, -1)], axis=1)
        folded = reduce(lambda hashed, column: mixed(hashed * FOLD + column), values.T, self._salt)
        return folded

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        if self._known is None:
            self._start()
        sizes, digests, bands = [], [], []
        for text in batch.column("text").to_pylist():
            found = text_shingles(text, self._known, self.width)
            sizes.append(len(found))
            digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            bands.append(signed(self.band_hashes(found)) if len(found) else None)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                batch.column("t"),
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            names=["id", "t", "n", "digest", "bands"],
        )


class Sets:
    """The shingles of each text in a batch."""

    def __init__(self, width: int):
        self.width, self._known = width, None

    def __getstate__(self):
        return self.__dict__ | {"_known": None}

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        if self._known is None:
            self._known = WordHashes()
        found = [signed(text_shingles(text, self._known, self.width)) for text in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), lists(found, pa.int64())], names=["id", "shingles"])


class Overlaps:
    """Share of shingles that two texts have in common, on their whole sets. Sets used lately are kept."""

    def __init__(self, width: int):
        self.width, self._known, self._sets = width, None, None

    def __getstate__(self):
        return self.__dict__ | {"_known": None, "_sets": None}

    def _set(self, key: int, text: bytes) -> np.ndarray:
        found = self._sets.pop(key, None)
        if found is None:
            found = text_shingles(text, self._known, self.width)
        self._sets[key] = found
        if len(self._sets) > SETS_KEPT:
            self._sets.pop(next(iter(self._sets)))
        return found

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        if self._known is None:
            self._known, self._sets = WordHashes(), {}
        common = []
        columns = (batch.column(name).to_pylist() for name in ("a", "b", "text_a", "text_b"))
        for a, b, text_a, text_b in zip(*columns, strict=True):
            left, right = self._set(a, text_a), self._set(b, text_b)
            both = np.concatenate([left, right])
            both.sort()
            common.append(int((both[1:] == both[:-1]).sum()))
        return pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), batch.column("n_a"), batch.column("n_b"), pa.array(common, pa.int64())],
            names=["a", "b", "n_a", "n_b", "common"],
        )


def could_link(percent: int):
    """Whether sets of two sizes can be alike enough at all."""
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def overlaps(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) with `common`, counted on the full sets of texts (id, text)."""
    first = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(second, "b").join(first, "a").select("a", "b", "n_a", "n_b", "text_a", "text_b")
    return map_batches(rows, Overlaps(width), "a long, b long, n_a long, n_b long, common long", 64)


def own_shingles(texts: DataFrame, width: int) -> DataFrame:
    """(id, own): how many of a text's shingles no other of the texts has; no row for none."""
    sets = map_batches(texts.select("id", "text"), Sets(width), "id long, shingles array<long>")
    once = sets.select("id", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return once.filter("n = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    percent: int = LINK_PERCENT,
    width: int = SHINGLE_WORDS,
    bands: int = BANDS,
    permutations_per_band: int = PERMUTATIONS_PER_BAND,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: which texts are linked, straight or over others.

    Texts of equal sets are one class, named by its smallest id, and only classes are compared. In every band's bucket the
    class of the smallest id is compared with the others. Most buckets are then of one component. In the rest, members
    outside the first one's component are compared with the members of other components, unless a link is ruled out by
    what is known of both: their sizes; their distances to the bucket's first, since 1 - resemblance obeys the triangle
    inequality; or the shingles that no other text of these buckets has, which no two can have in common. These bounds
    lose nothing, and in a large group of edited copies the last one rules out nearly all pairs that are no links. No
    bucket is cut, and copies are never compared with each other.

    Null and empty texts have no shingles and link with nothing. Repeated rows come out as often as they went in. Rows
    with one id and different texts are linked through the id; where several sets would be named by one id, the set with
    the smallest digest stands for it in the search. A row without an id has no component and is kept. Other columns are
    not read.
    """
    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("t"), as_binary(text).alias("text"))
    signed_rows = map_batches(
        rows,
        Signatures(bands, permutations_per_band, width),
        "id long, t long, n long, digest binary, bands array<long>",
    )
    signed_rows = written(signed_rows, "signatures")
    usable = signed_rows.filter("id is not null and digest is not null")
    classes = written(usable.groupBy("digest").agg(F.min("id").alias("class"), F.max("n").alias("n")), "classes")

    owners = classes.groupBy(F.col("class").alias("id")).agg(F.min("digest").alias("digest"))
    heads = written(usable.join(owners, ["digest", "id"], "left_semi").dropDuplicates(["id"]), "heads")
    slots = heads.select("id", "n", F.explode("bands").alias("bucket"))
    hubs = slots.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("hub"), F.count(F.lit(1)).alias("members"))
    hubs = hubs.filter("members > 1").select("bucket", F.col("hub.id").alias("a"), F.col("hub.n").alias("n_a"))
    members = written(slots.join(hubs, "bucket").select("bucket", "a", "n_a", F.col("id").alias("b"), F.col("n").alias("n_b")), "members")

    pairs = written(members.filter("a <> b").filter(could_link(percent)).drop("bucket").distinct(), "pairs")
    wanted = heads.select("id", "t").join(members.select(F.col("b").alias("id")), "id", "left_semi")
    texts = rows.join(wanted, ["id", "t"], "left_semi").dropDuplicates(["id"]).select("id", "text")
    texts = written(texts, "texts")
    counted = written(overlaps(pairs, texts, width), "overlaps")
    is_link = F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent
    links = counted.filter(is_link).select("a", "b")
    named = written(components(links), "components")

    # Buckets of several components: the first one's component, and members outside it.
    near = counted.select("a", "b", (1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("far"))
    placed = members.join(near, ["a", "b"], "left").withColumn("far", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.col("far")))
    placed = placed.join(named.select(F.col("id").alias("b"), F.col("component").alias("of")), "b", "left")
    placed = placed.join(named.select(F.col("id").alias("a"), F.col("component").alias("hub_of")), "a", "left")
    placed = placed.select("bucket", "b", "n_b", "far", F.coalesce("of", "b").alias("of"), F.coalesce("hub_of", "a").alias("hub_of"))
    placed = written(placed, "placed")
    outside = placed.filter("of <> hub_of").select("bucket").distinct()
    inside = written(placed.join(outside, "bucket", "left_semi"), "inside")
    own = own_shingles(texts.join(inside.select(F.col("b").alias("id")), "id", "left_semi"), width)
    inside = inside.join(own.withColumnRenamed("id", "b"), "b", "left").withColumn("rest", F.col("n_b") - F.coalesce("own", F.lit(0)))
    inside = written(inside.filter(F.col("rest") * 100 >= F.col("n_b") * percent), "inside")
    inside = inside.join(heads.select(F.col("id").alias("b"), "bands"), "b").select(
        "bucket", F.col("b").alias("id"), F.col("n_b").alias("n"), "far", "of", "rest", "bands", F.expr("of <> hub_of").alias("apart")
    )
    left, right = (
        inside.select("bucket", *(F.col(name).alias(f"{name}_{side}") for name in inside.columns if name != "bucket"))
        for side in ("a", "b")
    )
    rest = F.least("rest_a", "rest_b")
    more = (
        left.filter("apart_a")
        .join(right, "bucket")
        .filter("of_a <> of_b and (not apart_b or id_a < id_b)")
        .filter(could_link(percent))
        .filter(F.coalesce(F.abs(F.col("far_a") - F.col("far_b")), F.lit(0.0)) <= 1 - percent / 100 + 1e-9)
        .filter(rest * 100 >= (F.col("n_a") + F.col("n_b") - rest) * percent)
        # A pair that meets in several buckets comes from the first of them.
        .filter(F.col("bucket") == F.array_min(F.array_intersect("bands_a", "bands_b")))
    )
    turned = F.col("id_a") > F.col("id_b")
    more = more.select(
        F.least("id_a", "id_b").alias("a"),
        F.greatest("id_a", "id_b").alias("b"),
        F.when(turned, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"),
        F.when(turned, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
    )
    more = more.distinct().join(counted.select("a", "b"), ["a", "b"], "left_anti")
    more = written(more, "pairs")
    late = written(overlaps(more, texts, width), "overlaps").filter(is_link).select("a", "b")
    if not late.isEmpty():
        named = written(components(links.unionByName(late)), "components")

    of_class = classes.join(named.withColumnRenamed("id", "class"), "class", "left").select(
        "digest", F.coalesce("component", "class").alias("component")
    )
    found = signed_rows.select("id", "n", "digest").join(written(of_class, "classes"), "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
