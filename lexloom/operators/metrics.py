"""Backlog metric and its step signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.params import SCALE_IN_UPPER, SCALE_OUT_LOWER


def backlog_per_worker(samples: DataFrame) -> DataFrame:
    """(minute, messages, tasks, backlog) from samples (ts, messages, tasks) where either value may be null.

    Both series are maxima over the same minutes, so one grouping gives what joining the two series would.
    """
    return (
        samples.filter(F.col("messages").isNotNull() | F.col("tasks").isNotNull())
        .groupBy(F.window("ts", "1 minute").alias("w"))
        .agg(F.max("messages").alias("messages"), F.max("tasks").alias("tasks"))
        .select(F.col("w.start").alias("minute"), "messages", "tasks")
        .withColumn("backlog", filled_ratio(F.col("messages"), F.col("tasks")))
    )


def filled_ratio(messages: Column, tasks: Column) -> Column:
    filled = F.coalesce(tasks, F.lit(0))
    return F.coalesce(messages, F.lit(0.0)) / F.when(filled == 0, 1).otherwise(filled)


def step_signal(backlog: Column) -> Column:
    return F.when(backlog.between(0, SCALE_IN_UPPER), -1).when(backlog >= SCALE_OUT_LOWER, 1).otherwise(0)
