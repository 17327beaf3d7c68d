"""Crawl frontier: unseen URLs, the seen set, closure over links, seeds and refresh."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.extract import frontier_links, scrape
from lexloom.operators.store import lookup
from lexloom.params import MAX_RECEIVES, SEED_URL
from lexloom.session import ship_package, work_path, written, written_counted


DEPTHS = "node long, depth int, origin int"
#: Edges that one task follows at a time, as numbers: 20 bytes each when they come, and some 100 while they are put in order.
EDGES_PER_BLOCK = 4_000_000
UNKNOWN = np.iinfo(np.int32).max


def not_among(given: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct given keys that are not known.

    One grouping of both sides in place of a distinct and an anti-join: every task first reduces its own rows to one
    per key, so a key with a large share of either side costs no more than any other.
    """
    marked = given.select(key, F.lit(False).alias("known")).unionByName(known.select(key, F.lit(True).alias("known")))
    return marked.groupBy(key).agg(F.max("known").alias("known")).filter(~F.col("known")).select(key)


def unseen(frontier: DataFrame, seen: DataFrame) -> DataFrame:
    """Distinct frontier URLs not yet seen, by exact string match."""
    return not_among(frontier, seen, "url")


def merge_seen(seen: DataFrame, stored: DataFrame) -> DataFrame:
    """The seen set after these pages were stored; marking a URL twice changes nothing."""
    return seen.select("url").union(stored.select("url")).distinct()


def seeds_or_default(spark: SparkSession, seeds: DataFrame, default: str = SEED_URL) -> DataFrame:
    """The given seeds, or the default seed when there are none."""
    fallback = spark.createDataFrame([(default,)], "url string")
    return seeds.select("url") if not seeds.isEmpty() else fallback


def in_blocks(edges: DataFrame, n: int, per_block: int) -> DataFrame:
    """Edges with `block`: those of one source together, or spread over several blocks where they are too many for one."""
    blocks = max(1, math.ceil(n / per_block))
    if blocks == 1:
        return edges.select("src", "dst", F.lit(0).alias("block"))
    hubs = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > per_block)
    hubs = hubs.select("src", F.ceil(F.col("n") / per_block).alias("parts"))
    part = F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1)))
    place = F.pmod(F.pmod(F.xxhash64("src"), F.lit(blocks)) + part, F.lit(blocks)).cast("int")
    return edges.join(hubs, "src", "left").select("src", "dst", place.alias("block"))


def walked(starts: pa.Table, edges: pa.Table) -> pa.Table:
    """Least depths of all that the edges of one block reach from starts (block, node, depth), a level at a time."""
    block = starts.column("block")[0].as_py()
    given = [edges.column("src").to_numpy(), edges.column("dst").to_numpy(), starts.column("node").to_numpy()]
    names, places = np.unique(np.concatenate(given), return_inverse=True)
    places = places.astype(np.int32)
    src, dst, begins = np.split(places, np.cumsum([len(each) for each in given])[:-1])
    order = np.argsort(src, kind="stable")
    ways, first = dst[order], np.searchsorted(src[order], np.arange(len(names) + 1))
    depths = starts.column("depth").to_numpy()
    order = np.argsort(depths, kind="stable")
    begins, depths = begins[order], depths[order]
    least, told_by = np.full(len(names), UNKNOWN, np.int32), np.zeros(len(names), np.int32)
    level, depth, at = begins[:0], 0, 0
    while len(level) or at < len(begins):
        if not len(level):
            depth = int(depths[at])
        if at < len(begins) and depths[at] == depth:
            end = int(np.searchsorted(depths, depth, "right"))
            new = np.unique(begins[at:end])
            new, at = new[least[new] > depth], end
            least[new] = depth
            level = np.concatenate([level, new])
        n = first[level + 1] - first[level]
        ends = np.cumsum(n)
        found = ways[np.arange(n.sum()) + np.repeat(first[level] - ends + n, n)]
        found = found[least[found] > depth + 1]
        depth += 1
        least[found] = depth
        # Each once: the one that was the last to say so.
        each = np.arange(len(found), dtype=np.int32)
        told_by[found] = each
        level = found[told_by[found] == each]
    reached = np.flatnonzero(least < UNKNOWN)
    columns = [pa.array(names[reached]), pa.array(least[reached]), pa.array(np.full(len(reached), block, np.int32))]
    return pa.Table.from_arrays(columns, names=["node", "depth", "origin"])


def crawl_closure(edges: DataFrame, seeds: DataFrame, per_block: int = EDGES_PER_BLOCK) -> DataFrame:
    """(url, depth) of everything reachable from the seeds over (src, dst) edges, with the fewest edges to it.

    URLs get numbers, and edges of numbers lie in blocks of a bounded number. In a round each block that has news follows its
    own edges as far as they lead, and what came out nearer than known is news for the other blocks in which it has edges.
    Depths only fall, so that when there is no more news they are the least ones. A deep graph takes as many rounds as its
    shortest ways change blocks, and one of a single block a single round. Rounds are stored, so a lost executor costs a
    rereading.
    """
    spark = edges.sparkSession
    ship_package(spark)
    edges, n = written_counted(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "edges")
    seeds = seeds.select("url").distinct()
    every = edges.select(F.col("src").alias("url")).union(edges.select("dst")).union(seeds).distinct()
    names = written(every.withColumn("node", F.monotonically_increasing_id()), "names")
    for end in ("src", "dst"):
        numbered = names.select(F.col("url").alias(end), F.col("node").alias(f"{end}_node"))
        edges = edges.join(numbered, end)
    edges = edges.select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))
    if n > per_block:
        edges = written(edges, "numbered")
    edges = written(in_blocks(edges, n, per_block), "blocks")
    sources = written(edges.select(F.col("src").alias("node"), "block").distinct(), "sources")
    folder, number = work_path(spark, "depths"), 0
    begins = names.join(seeds.withColumnRenamed("url", "seed"), F.col("url").eqNullSafe(F.col("seed")), "left_semi")
    n = _store_round(begins.select("node", F.lit(0).alias("depth"), F.lit(-1).alias("origin")), folder, number)
    while n:
        news = spark.read.schema(DEPTHS).parquet(f"{folder}/round={number}")
        starts = news.join(sources, "node").filter("block <> origin").select("block", "node", "depth")
        here = edges.join(starts.select("block").distinct(), "block", "left_semi")
        found = starts.groupBy("block").cogroup(here.groupBy("block")).applyInArrow(walked, DEPTHS)
        found = found.groupBy("node").agg(F.min(F.struct("depth", "origin")).alias("to"))
        known = spark.read.schema(DEPTHS).parquet(folder).groupBy("node").agg(F.min("depth").alias("known"))
        nearer = found.join(known, "node", "left").filter("known is null or known > to.depth").select("node", "to.depth", "to.origin")
        number += 1
        n = _store_round(nearer, folder, number)
    least = spark.read.schema(DEPTHS).parquet(folder).groupBy("node").agg(F.min("depth").alias("depth"))
    return names.join(least, "node").select("url", "depth")


def _store_round(found: DataFrame, folder: str, number: int) -> int:
    counted = Observation()
    found.observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/round={number}")
    return counted.get["n"]


def populate(snapshot: DataFrame, seeds: DataFrame) -> DataFrame:
    """The crawl from seeds over a snapshot of fetched pages (url, html): (url, depth, outcome, error_code, statute).

    Links of good index pages feed the frontier until nothing new turns up; a URL that is not in the snapshot has outcome
    `not_fetched`. All pages are read once, before the rounds, which then move only URLs; the scraped pages are cut down to
    those reached before they are joined.
    """
    scraped = written(scrape(snapshot), "scraped")
    edges = frontier_links(scraped).select(F.col("url").alias("src"), F.col("link").alias("dst"))
    reached = crawl_closure(edges, seeds)
    found = lookup(reached, scraped.select("url", "outcome", "error_code", "statute"), "url").drop("missing")
    return found.withColumn("outcome", F.coalesce("outcome", F.lit("not_fetched")))


def delivery_state(failures: Column, max_receives: int = MAX_RECEIVES) -> Column:
    return F.when(failures == 0, "done").when(failures < max_receives, "retry").otherwise("dead_letter")


def fetch_outcome(status: Column) -> Column:
    return F.when(status == 200, "stored").otherwise("retry")


def pending(given: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs of a stage that have no output yet."""
    return not_among(given, done, key)
