"""Full refresh: a crawl's state replaced by its seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.batches import read_if_there
from lexloom.operators.frontier import merge_seen, seeds_or_default


class CrawlState:
    """Seen set and frontier as tables under one folder; each refresh starts a new generation.

    The folder says which generation is the current one. That is written last, so a refresh that breaks off leaves the
    state as it was.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @property
    def generation(self) -> int:
        started = read_if_there(self.spark, f"{self.folder}/generations", "generation int")
        return started.agg(F.coalesce(F.max("generation"), F.lit(-1))).first()[0]

    def path(self, name: str, generation: int | None = None) -> str:
        """A place of the current generation; stream checkpoints and sinks belong there too."""
        return f"{self.folder}/generation={self.generation if generation is None else generation}/{name}"

    def start(self, seen: DataFrame, frontier: DataFrame) -> None:
        """Opens a generation with these rows, after all before it."""
        made = self.generation + 1
        merge_seen(seen, seen.limit(0)).write.mode("overwrite").parquet(self.path("seen", made))
        frontier.select("url").write.mode("overwrite").parquet(self.path("frontier", made))
        opened = self.spark.createDataFrame([(made,)], "generation int").coalesce(1)
        opened.write.mode("append").parquet(f"{self.folder}/generations")

    def refresh(self, seeds: DataFrame) -> None:
        """Nothing seen, and only the seeds to crawl."""
        self.start(seeds.limit(0), seeds_or_default(self.spark, seeds))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema("url string").parquet(self.path(name))


def full_refresh(spark: SparkSession, folder: str, seen: DataFrame, frontier: DataFrame, seeds: DataFrame) -> DataFrame:
    """Runs a refresh over the given state; (store, before, after) row counts."""
    state = CrawlState(spark, folder)
    state.start(seen, frontier)
    before = {name: state.read(name) for name in ("seen", "frontier")}
    CrawlState(spark, folder).refresh(seeds)
    state = CrawlState(spark, folder)
    counts = [
        rows.select(F.lit(name).alias("store"), F.lit(when).alias("when"))
        for when, tables in (("before", before), ("after", {n: state.read(n) for n in before}))
        for name, rows in tables.items()
    ]
    marks = counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])
    return marks.groupBy("store").agg(
        F.count_if(F.col("when") == "before").alias("before"), F.count_if(F.col("when") == "after").alias("after")
    )
