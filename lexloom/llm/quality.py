"""Document quality by co-training a classifier of texts and a classifier of page metadata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.text import TEXT_ROWS, WordHashes, as_binary, lists, map_batches
from lexloom.session import ship_package, written

#: The classifiers are fitted on samples: so many labelled rows and so many without a label, on average. All rows are scored.
LABELLED_ROWS, UNLABELLED_ROWS = 16_000, 16_000
#: Feature space of each view.
TEXT_BITS, METADATA_BITS = 15, 10
ROUNDS = 3
#: A pseudo-label is passed on where its giver is so sure, by probabilities calibrated on rows that it was not fitted on.
SURE = 0.97
CALIBRATION_SHARE = 0.25
#: Documents below this probability of being good are rejected.
ACCEPT_FROM = 0.5
EPOCHS, STEPS, BATCH, RATE, DECAY = 8, 400, 128, 0.5, 1e-5

UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def _magnitude(share: float) -> int:
    """A share as one of ten magnitudes, from below 1/256 to all."""
    return int(share * 256).bit_length()


def _mark(known: WordHashes, name: str, value: object) -> int:
    return known[f"\0{name}={value}".encode()]


class Views:
    """Hashed features and their weights of both views of each document in a batch.

    Text: distinct words, and shares that describe the text: repeated neighbours, distinct words, capitals, digits, other
    signs, word lengths. Metadata: source, language, and magnitudes of the length, the number of lines and their length.
    """

    def __init__(self):
        self._known = None

    def __getstate__(self):
        return {"_known": None}

    def text(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        known, words = self._known, text.split()
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        found, counts = np.unique(hashes >> np.uint64(64 - TEXT_BITS), return_counts=True)
        values = np.log1p(counts.astype(np.float32))
        if len(values):
            values /= np.linalg.norm(values)
        n = max(1, len(words))
        kinds = np.frombuffer(text, np.uint8)
        sums = np.bincount(kinds, minlength=256)
        filled = max(1, len(kinds) - int(sums[BLANK].sum()))
        shares = {
            "same": _magnitude(float((hashes[1:] == hashes[:-1]).mean()) if len(hashes) > 1 else 0.0),
            "distinct": _magnitude(len(np.unique(hashes)) / n),
            "capitals": _magnitude(sums[UPPER].sum() / filled),
            "digits": _magnitude(sums[DIGIT].sum() / filled),
            "signs": _magnitude((filled - sums[LETTER].sum() - sums[DIGIT].sum()) / filled),
            "length": min(20, filled // n),
        }
        marks = np.array([_mark(known, name, value) for name, value in shares.items()], np.uint64) >> np.uint64(64 - TEXT_BITS)
        indexes = np.concatenate([found, marks]).astype(np.int32)
        return indexes, np.concatenate([values, np.full(len(marks), 0.4, np.float32)])

    def metadata(self, source, lang, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        known, lines = self._known, text.count(b"\n") + 1
        facts = {
            "source": source,
            "lang": lang,
            "size": len(text).bit_length(),
            "lines": lines.bit_length(),
            "line": (len(text) // lines).bit_length(),
        }
        marks = np.array([_mark(known, name, value) for name, value in facts.items()], np.uint64)
        return (marks >> np.uint64(64 - METADATA_BITS)).astype(np.int32), np.full(len(marks), 0.45, np.float32)

    def both(self, texts, sources, langs) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        if self._known is None:
            self._known = WordHashes()
        rows = zip(texts, sources, langs, strict=True)
        found = [(self.text(text or b""), self.metadata(source, lang, text or b"")) for text, source, lang in rows]
        return [list(view) for view in zip(*found, strict=True)]


class Features:
    def __init__(self):
        self.views = Views()

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column("id")]
        for view in self.views.both(*(batch.column(name).to_pylist() for name in ("text", "source", "lang"))):
            columns += [lists([i for i, _ in view], pa.int32()), lists([v for _, v in view], pa.float32())]
        return pa.RecordBatch.from_arrays(columns, names=["id", "text_at", "text_by", "meta_at", "meta_by"])


class Rows:
    """Sparse rows of one view."""

    def __init__(self, at: pa.ListArray, by: pa.ListArray):
        self.starts = at.offsets.to_numpy().astype(np.int64)
        self.at, self.by = at.values.to_numpy(), by.values.to_numpy()

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(weights[self.at] * self.by, dtype=np.float64)])
        return sums[self.starts[1:]] - sums[self.starts[:-1]] + bias


def sigmoid(values: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(values, -30, 30)))


class Logistic:
    """Logistic regression by stochastic steps of adaptive size, with scores calibrated on rows kept aside."""

    def __init__(self, size: int):
        self.weights, self.bias, self.slope, self.shift = np.zeros(size), 0.0, 1.0, 0.0

    def fit(self, rows: Rows, picked: np.ndarray, wanted: np.ndarray, seed: int) -> None:
        random, size = np.random.default_rng(seed), len(self.weights)
        self.weights, self.bias = np.zeros(size), 0.0
        squares, bias_square = np.full(size, 1e-6), 1e-6
        # Few rows are gone over more often.
        for _ in range(max(EPOCHS, STEPS * BATCH // max(1, len(picked)))):
            order = random.permutation(len(picked))
            for start in range(0, len(order), BATCH):
                chosen = order[start : start + BATCH]
                each = [slice(rows.starts[r], rows.starts[r + 1]) for r in picked[chosen]]
                at, by = np.concatenate([rows.at[s] for s in each]), np.concatenate([rows.by[s] for s in each])
                lengths = np.array([s.stop - s.start for s in each])
                row = np.repeat(np.arange(len(each)), lengths)
                score = np.bincount(row, self.weights[at] * by, len(each)) + self.bias
                error = (sigmoid(score) - wanted[chosen]) / len(each)
                slope = np.bincount(at, by * error[row], size) + DECAY * self.weights
                squares += slope**2
                self.weights -= RATE * slope / np.sqrt(squares)
                bias_square += error.sum() ** 2
                self.bias -= RATE * error.sum() / bias_square**0.5

    def calibrate(self, rows: Rows, picked: np.ndarray, wanted: np.ndarray) -> None:
        """Platt scaling: slope and shift of the scores, by Newton steps with smoothed targets.

        A step is halved until the loss falls. The slope is drawn towards 1 a little, which only tells on few rows.
        """
        scores = rows.scores(self.weights, self.bias)[picked]
        good, bad = wanted.sum(), len(wanted) - wanted.sum()
        target = np.where(wanted > 0, (good + 1) / (good + 2), 1 / (bad + 2))

        def loss(slope: float, shift: float) -> float:
            odds = slope * scores + shift
            return (np.logaddexp(0, odds) - target * odds).sum() + 0.05 * (slope - 1) ** 2 + 0.0005 * shift**2

        slope, shift = 1.0, 0.0
        for _ in range(30):
            chance = sigmoid(slope * scores + shift)
            error, spread = chance - target, np.maximum(chance * (1 - chance), 1e-6)
            a, b, c = (spread * scores**2).sum() + 0.1, (spread * scores).sum(), spread.sum() + 0.001
            first, second = (error * scores).sum() + 0.1 * (slope - 1), error.sum() + 0.001 * shift
            det = a * c - b * b
            by_slope, by_shift = (c * first - b * second) / det, (a * second - b * first) / det
            length = 1.0
            while length > 1e-4 and loss(slope - length * by_slope, shift - length * by_shift) > loss(slope, shift):
                length /= 2
            slope, shift = slope - length * by_slope, shift - length * by_shift
        self.slope, self.shift = max(0.0, float(slope)), float(shift)

    def logits(self, rows: Rows) -> np.ndarray:
        return np.clip(self.slope * rows.scores(self.weights, self.bias) + self.shift, -30, 30)


class QualityModel:
    """Both views' classifiers and the log odds of a good document, which both views' odds contain."""

    def __init__(self, text: Logistic, metadata: Logistic, prior: float):
        self.text, self.metadata, self.prior = text, metadata, prior

    def combined(self, text: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        """Calibrated odds of views that are independent given the class multiply; the prior odds count once."""
        return sigmoid(text + metadata - self.prior)


def co_train(text: Rows, metadata: Rows, labels: np.ndarray, rounds: int = ROUNDS, seed: int = 3) -> QualityModel | None:
    """Fits both views on labels 1 and 0, and on the rows of label -1 that the other view is sure of.

    A share of the labelled rows is kept aside to calibrate on. In each round each view labels the rows that it is sure
    of, for the other one to learn from; labels are given anew each round, so early mistakes don't stay. None if the
    labels are not of both kinds.
    """
    random = np.random.default_rng(seed)
    known = np.flatnonzero(labels >= 0)
    known = known[random.permutation(len(known))]
    aside, base = known[: int(len(known) * CALIBRATION_SHARE)], known[int(len(known) * CALIBRATION_SHARE) :]
    if len(set(labels[base])) < 2 or len(set(labels[aside])) < 2:
        return None
    free = np.flatnonzero(labels < 0)
    good = labels[known].mean()
    views = {"text": (Logistic(1 << TEXT_BITS), text), "metadata": (Logistic(1 << METADATA_BITS), metadata)}
    lent = {name: (np.zeros(0, np.int64), np.zeros(0)) for name in views}
    for _ in range(rounds):
        for name, (model, rows) in views.items():
            more, given = lent[name]
            model.fit(rows, np.concatenate([base, more]), np.concatenate([labels[base], given]).astype(np.float64), seed)
            model.calibrate(rows, aside, labels[aside].astype(np.float64))
        for name, other in (("text", "metadata"), ("metadata", "text")):
            model, rows = views[other]
            chance = sigmoid(model.logits(rows))[free]
            sure = (chance >= SURE) | (chance <= 1 - SURE)
            lent[name] = free[sure], (chance[sure] >= SURE).astype(np.float64)
    return QualityModel(views["text"][0], views["metadata"][0], float(np.log(good / (1 - good))))


def _share(column: Column, wanted: int, rows: int) -> Column:
    """A part of the rows that depends on the id alone and holds as many as wanted, on average."""
    parts = 1 << 20
    return F.pmod(F.xxhash64(F.lit("sample"), column), F.lit(parts)) < int(min(1.0, wanted / max(1, rows)) * parts)


def _inputs(docs: DataFrame, text_column: str = "text") -> list[Column]:
    """Text, source and language of docs; a column that docs doesn't have is null."""
    kinds = [docs[name].cast("string") if name in docs.columns else F.lit(None).cast("string") for name in ("source", "lang")]
    return [as_binary(docs[text_column]).alias("text"), kinds[0].alias("source"), kinds[1].alias("lang")]


def fit_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "quality") -> QualityModel | None:
    """Fits on documents (id, text, source, lang) and labels (id, 0 or 1); of two labels of an id the lower counts.

    The samples are taken by the ids' hashes, so they are the same in every run; of rows that share an id one is taken.
    None without labels of both kinds.
    """
    known = labels.filter(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull())
    known = known.groupBy(F.col(id_column).cast("long").alias("id")).agg(F.min(label_column).cast("int").alias("label"))
    n_labelled, n_docs = known.count(), docs.count()
    with_label, without = _share(F.col("id"), LABELLED_ROWS, n_labelled), _share(F.col("id"), UNLABELLED_ROWS, n_docs)
    ids = docs.select(docs[id_column].cast("long").alias("id")).filter(with_label | without).distinct()
    chosen = ids.join(known, "id", "left").filter(F.when(F.col("label").isNotNull(), with_label).otherwise(without))
    chosen = F.broadcast(written(chosen, "sample_ids"))
    rows = docs.select(docs[id_column].cast("long").alias("id"), *_inputs(docs)).filter(with_label | without)
    rows = rows.join(chosen.select("id"), "id").dropDuplicates(["id"])
    kinds = "id long, text_at array<int>, text_by array<float>, meta_at array<int>, meta_by array<float>"
    made = written(map_batches(rows, Features(), kinds).join(chosen, "id"), "features")
    table = made.orderBy("id").toArrow().combine_chunks()
    if not table.num_rows:
        return None
    at = {name: table.column(name).combine_chunks() for name in table.column_names}
    at = {name: part.chunk(0) if isinstance(part, pa.ChunkedArray) else part for name, part in at.items()}
    given = at["label"].fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return co_train(Rows(at["text_at"], at["text_by"]), Rows(at["meta_at"], at["meta_by"]), given)


def score_column(docs: DataFrame, model: QualityModel | None) -> Column:
    """A struct of text_score, metadata_score and score: probabilities of a good document. Without a model they are 1."""
    if model is None:
        return F.struct(*(F.lit(1.0).alias(name) for name in ("text_score", "metadata_score", "score")))
    ship_package(docs.sparkSession)
    shared, views = docs.sparkSession.sparkContext.broadcast(model), Views()

    names = ["text_score", "metadata_score", "score"]

    @F.arrow_udf(", ".join(f"{name} double" for name in names))
    def score(texts: pa.Array, sources: pa.Array, langs: pa.Array) -> pa.Array:
        fitted, parts = shared.value, []
        for start in range(0, len(texts), TEXT_ROWS):
            columns = [column.slice(start, TEXT_ROWS).to_pylist() for column in (texts, sources, langs)]
            odds = []
            for view, logistic in zip(views.both(*columns), (fitted.text, fitted.metadata), strict=True):
                rows = Rows(lists([i for i, _ in view], pa.int32()), lists([v for _, v in view], pa.float32()))
                odds.append(logistic.logits(rows))
            parts.append(np.stack([sigmoid(odds[0]), sigmoid(odds[1]), fitted.combined(*odds)], axis=1))
        made = np.concatenate(parts) if parts else np.zeros((0, 3))
        return pa.StructArray.from_arrays([pa.array(column) for column in made.T], names=names)

    return score(*_inputs(docs))


def quality_scores(docs: DataFrame, model: QualityModel | None, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, text_score, metadata_score, score, kept) of every row, from its whole text and its metadata.

    A null or empty text is judged as one without words; null metadata is a value of its own. Repeated rows and null ids
    come out as they went in. Nothing is shuffled.
    """
    scored = docs.select(docs[id_column].alias("doc_id"), score_column(docs, model).alias("made"))
    return scored.select("doc_id", "made.*").withColumn("kept", F.col("score") >= ACCEPT_FROM)


def accepted(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """The rows of docs that the model accepts, unchanged, with all their columns."""
    if model is None:
        return docs
    return docs.filter(score_column(docs, model).getField("score") >= ACCEPT_FROM)
