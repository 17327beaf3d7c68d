"""Keyed tables: last write wins, lookups, guards and retention."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.params import MESSAGE_MAX_BYTES
from lexloom.session import written

# Rows of keys and numbers that every executor can hold.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 * 1024 * 1024


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the greatest by the order columns.

    An aggregate rather than a window: every task first reduces its own rows to one per key, so a key with a large
    share of the rows is never gathered in one place.
    """
    rest = [name for name in rows.columns if name not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, "newest.*")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return latest_per_key(current.unionByName(changes), keys, order)


def small(rows: DataFrame, limit: int = BROADCAST_ROWS, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Stores the rows, and asks for a broadcast if they are measured to be few and short; otherwise leaves the join to Spark."""
    stored = written(rows)
    width = F.octet_length(F.concat_ws("", *(F.col(name).cast("string") for name in rows.columns)))
    n, held = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(stored) if n <= limit and held <= limit_bytes else stored


def lookup(wanted: DataFrame, store: DataFrame, key: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Wanted rows with the stored row of their key; `missing` where there is none.

    The store is first cut down to the wanted keys where it lies, so that it is not shuffled for a few of its rows.
    """
    wanted = written(wanted)
    keys = small(wanted.select(key).distinct(), broadcast_rows)
    found = store.join(keys, key, "left_semi").withColumn("_stored", F.lit(True))
    joined = wanted.join(found, key, "left")
    return joined.withColumn("missing", F.col("_stored").isNull()).drop("_stored")


def prefix_error(key: Column, prefix: str) -> Column:
    return F.when(~key.startswith(f"{prefix}/"), "wrong_prefix")


def fits_message(text: Column, limit: int = MESSAGE_MAX_BYTES) -> Column:
    return F.octet_length(text) <= limit


def kept_since(as_of: datetime, days: int) -> datetime:
    return as_of - timedelta(days=days)
