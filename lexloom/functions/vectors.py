"""Vector arithmetic as columns, and the scoring used by the search tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_SCALE = 1_000_000.0
SINGLE_EXACT = 2.0**24


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda total, value: total + value)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def rounded(score: Column) -> Column:
    return F.floor(score * SCORE_SCALE + 0.5).cast("double") / SCORE_SCALE


def cosine_score(vector: Column, query: Column) -> Column:
    """1 + cosine, to six digits; null where a vector has no direction."""
    size = norm(vector) * norm(query)
    return rounded(1.0 + dot(vector, query) / F.when((size > 0) & (size < float("inf")), size))


def dot_block(matrix: np.ndarray, norms: np.ndarray, queries: np.ndarray, query_norms: np.ndarray) -> np.ndarray:
    """Dot product of every (query, row).

    Whole numbers whose norms keep all sums below 2^24 are multiplied in single precision, which is then exact.
    """
    small = len(norms) and len(query_norms) and norms.max() * query_norms.max() < SINGLE_EXACT
    if small and is_whole(queries) and is_whole(matrix):
        return (queries.astype(np.float32) @ matrix.astype(np.float32).T).astype(np.float64)
    return queries @ matrix.T


def is_whole(matrix: np.ndarray) -> bool:
    return bool((matrix == np.rint(matrix)).all())


def score_block(matrix: np.ndarray, norms: np.ndarray, queries: np.ndarray, query_norms: np.ndarray) -> np.ndarray:
    """The same score for every (query, row) of two blocks."""
    scores = dot_block(matrix, norms, queries, query_norms)
    scores /= query_norms[:, None] * norms[None, :]
    return whole_digits(scores)


def score_rows(matrix: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The same score for the rows of two matrices, one by one."""
    return whole_digits(np.einsum("ij,ij->i", matrix, queries) / (row_norms(matrix) * row_norms(queries)))


def whole_digits(scores: np.ndarray) -> np.ndarray:
    """1 + cosine, to six digits, in place."""
    scores += 1.0
    scores *= SCORE_SCALE
    scores += 0.5
    np.floor(scores, out=scores)
    scores /= SCORE_SCALE
    return scores


def row_norms(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
