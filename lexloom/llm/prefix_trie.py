"""The trie of conversations' common beginnings, written as balanced parentheses in shards that are then put together.

A conversation is a path: the codes of its turns in a row, so that paths in byte order are the trie's leaves in order. Each
task reads a range of sorted distinct paths and cuts it into shards. A shard's trie is a row of parentheses, one pair for
each node. Where a node's pair closes is found by blocks of least and greatest excess; how many leaf pairs `()` lie
inside is a difference of ranks, and what its turns save is one of running sums.

Only nodes of a shard's first and last path, its spine, can also be in other shards. They are few, and are merged by key;
all others are done.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import ship_package, written

#: A turn's code: half of a SHA-256 of its role and text, and the text's bytes in number.
DIGEST_BYTES, LENGTH_BYTES = 16, 6
CODE_BYTES = DIGEST_BYTES + LENGTH_BYTES
#: Nodes of a shard, about; a longer path makes a shard of its own. Ids in one part of a list that is hashed.
SHARD_NODES, IDS_PER_PART = 100_000, 4096
BLOCK = 64

NODE = (
    "spine boolean, shard long, at long, line long, `key` binary, parent_key binary, depth long, n_bytes long, conv_id long, "
    "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """A row of balanced parentheses, with the excess of open ones behind each and its least and greatest by blocks."""

    def __init__(self, opening: np.ndarray, block: int = BLOCK):
        self.block, n = block, len(opening)
        self.excess = np.cumsum(np.where(opening, 1, -1))
        self.opens = np.flatnonzero(opening)
        #: How many open before each place, and how many `()` begin before it.
        self.rank = np.concatenate([[0], np.cumsum(opening)])
        self.leaf_rank = np.concatenate([[0], np.cumsum(opening & ~np.append(opening[1:], True))])
        starts = np.arange(0, n, block)
        self._leaves = 1 << max(0, len(starts) - 1).bit_length()
        self._least = np.full(2 * self._leaves, n + 1)
        self._most = np.full(2 * self._leaves, -n - 1)
        self._least[self._leaves : self._leaves + len(starts)] = np.minimum.reduceat(self.excess, starts)
        self._most[self._leaves : self._leaves + len(starts)] = np.maximum.reduceat(self.excess, starts)
        for at in range(self._leaves - 1, 0, -1):
            self._least[at] = min(self._least[2 * at], self._least[2 * at + 1])
            self._most[at] = max(self._most[2 * at], self._most[2 * at + 1])

    def _in_block(self, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The first place from `at` on, inside its block, with the wanted excess; -1 where there is none."""
        found = np.full(len(at), -1)
        open_ = np.flatnonzero(at < len(self.excess))
        at = at.copy()
        stop = np.minimum((at // self.block + 1) * self.block, len(self.excess))
        while len(open_):
            hit = self.excess[at[open_]] == wanted[open_]
            found[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < stop[open_]]
        return found

    def _block_with(self, block: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The first block from `block` on in which the excess comes down to what is wanted; there is one."""
        node = block + self._leaves
        holds = (self._least[node] <= wanted) & (wanted <= self._most[node])
        while not holds.all():
            # Up while at a right end, then one to the right.
            climb = np.flatnonzero(~holds)
            here = node[climb]
            while (right := here % 2 == 1).any():
                here = np.where(right, here // 2, here)
            node[climb] = here + 1
            holds[climb] = (self._least[node[climb]] <= wanted[climb]) & (wanted[climb] <= self._most[node[climb]])
        while (inner := node < self._leaves).any():
            left = 2 * node
            take = self._least[np.where(inner, left, 0)] <= wanted
            node = np.where(inner, np.where(take, left, left + 1), node)
        return node - self._leaves

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """Where the parentheses that open at these places close."""
        wanted = self.excess[opens] - 1
        same = (opens + 1) % self.block != 0
        found = np.full(len(opens), -1)
        found[same] = self._in_block(opens[same] + 1, wanted[same])
        rest = np.flatnonzero(found < 0)
        if len(rest):
            block = self._block_with(opens[rest] // self.block + 1, wanted[rest])
            found[rest] = self._in_block(block * self.block, wanted[rest])
        return found


def common_turns(one: bytes, other: bytes) -> int:
    """How many turns two paths begin with alike."""
    low, high = 0, min(len(one), len(other)) // CODE_BYTES
    while low < high:
        middle = (low + high + 1) // 2
        if one[low * CODE_BYTES : middle * CODE_BYTES] == other[low * CODE_BYTES : middle * CODE_BYTES]:
            low = middle
        else:
            high = middle - 1
    return low


def prefix_keys(path: bytes) -> list[bytes]:
    """A key of each beginning of the path, from the empty one to the whole."""
    hashed, keys = hashlib.sha256(), []
    for end in range(0, len(path) + 1, CODE_BYTES):
        keys.append(hashed.digest()[:DIGEST_BYTES])
        hashed.update(path[end : end + CODE_BYTES])
    return keys


class Shard:
    """Sorted distinct paths with how many conversations end there, the smallest of them, and the hash of them all."""

    def __init__(self):
        self.paths: list[bytes] = []
        self.common: list[int] = []
        self.values: list[tuple] = []
        self.n_nodes = 1

    def add(self, path: bytes, *values) -> None:
        self.common.append(common_turns(self.paths[-1], path) if self.paths else 0)
        self.paths.append(path)
        self.values.append(values)
        self.n_nodes += len(path) // CODE_BYTES - self.common[-1]

    def nodes(self, number: int, block: int = BLOCK) -> pa.RecordBatch:
        common = np.array(self.common, np.int64)
        lengths = np.array([len(path) // CODE_BYTES for path in self.paths], np.int64)
        made = lengths - common
        made[0] += 1
        closed = np.append(lengths[:-1] - common[1:], lengths[-1] + 1)
        row = np.repeat(np.arange(2 * len(made)) % 2 == 0, np.column_stack([made, closed]).ravel())
        tree = Parentheses(row, block)
        n, start = int(made.sum()), np.cumsum(made) - made
        from_depth = common + 1
        from_depth[0] = 0
        depth = np.repeat(from_depth - start, made) + np.arange(n)
        codes = b"".join(path[shared * CODE_BYTES :] for path, shared in zip(self.paths, self.common, strict=True))
        table = np.frombuffer(codes, np.uint8).reshape(-1, CODE_BYTES)[:, DIGEST_BYTES:].astype(np.int64)
        n_bytes = np.append(0, table @ (1 << 8 * np.arange(LENGTH_BYTES - 1, -1, -1)))

        closes = tree.find_close(tree.opens)
        until = tree.rank[closes]
        ends = np.cumsum(made) - 1
        counts, smallest, hashes = zip(*self.values, strict=True)
        ended = np.zeros(n, np.int64)
        ended[ends] = counts
        here = np.arange(n)
        sums = np.concatenate([[0], np.cumsum(ended)])
        n_convs = sums[until] - sums[here]
        # A node's conversations end at a range of the paths; the least of each range.
        bounds = np.column_stack([np.searchsorted(ends, here), np.searchsorted(ends, until)]).ravel()
        conv_id = np.minimum.reduceat(np.append(np.array(smallest, np.int64), np.iinfo(np.int64).max), bounds)[::2]
        by_depth = np.sort(depth * (n + 1) + here)
        parent = by_depth[np.searchsorted(by_depth, (depth - 1) * (n + 1) + here) - 1] % (n + 1)
        n_children = np.bincount(parent[1:], minlength=n)
        n_leaves = tree.leaf_rank[closes] - tree.leaf_rank[tree.opens]

        on_first, on_last = here <= lengths[0], until > ends[-1]
        spine = on_first | on_last
        own = (n_convs - 1) * n_bytes
        apart = np.concatenate([[0], np.cumsum(np.where(spine, 0, own))])
        saved = np.concatenate([[0], np.cumsum(own)])
        spine_leaf = np.concatenate([[0], np.cumsum(spine & (n_children == 0))])
        spine_kids = np.bincount(parent[1:][spine[1:]], minlength=n)
        hashed = np.full(n, None, object)
        hashed[ends] = hashes

        inner = np.flatnonzero(~spine)
        up = parent[inner]
        batch = {
            "spine": np.zeros(len(inner), bool),
            "shard": np.full(len(inner), number),
            "at": pa.array(up, mask=~spine[up]),
            "depth": depth[inner],
            "conv_id": conv_id[inner],
            "parent_conv_id": pa.array(conv_id[up], mask=spine[up]),
            "n_convs": n_convs[inner],
            "n_children": n_children[inner],
            "n_leaves": n_leaves[inner],
            "saved_tokens": saved[until[inner]] - saved[inner],
            "ends_sha256": pa.array(hashed[inner].tolist(), pa.string()),
        }
        lines = [(on_first, self.paths[0], None), (on_last, self.paths[-1], on_first)]
        parts = [_batch(batch)]
        for side, (on_line, path, counted) in enumerate(lines[: 1 if len(self.paths) == 1 else 2]):
            line, keys = np.flatnonzero(on_line), prefix_keys(path)
            # What a node of both lines holds is told once, with the first.
            told = np.ones(len(line), np.int64) if counted is None else (~counted[line]).astype(np.int64)
            values = {
                "spine": np.ones(len(line), bool),
                "shard": np.full(len(line), number),
                "at": line,
                "line": np.full(len(line), 2 * number + side),
                "key": pa.array(keys, pa.binary()),
                "parent_key": pa.array([None, *keys[:-1]], pa.binary()),
                "depth": depth[line],
                "n_bytes": n_bytes[line],
                "conv_id": conv_id[line],
                "n_convs": n_convs[line] * told,
                "n_children": (n_children - spine_kids)[line] * told,
                "n_leaves": (n_leaves - spine_leaf[until] + spine_leaf[here])[line] * told,
                "saved_tokens": (apart[until] - apart[here])[line] * told,
                "ends_sha256": pa.array(hashed[line].tolist(), pa.string()),
            }
            parts.append(_batch(values))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


KINDS = {"spine": pa.bool_(), "key": pa.binary(), "parent_key": pa.binary(), "ends_sha256": pa.string()}
NODE_SCHEMA = pa.schema([(name.strip("`"), KINDS.get(name.strip("`"), pa.int64())) for name in (f.split(" ")[0] for f in NODE.split(", "))])


def _batch(values: dict) -> pa.RecordBatch:
    n = len(values["spine"])
    columns = [pa.array(values[f.name], f.type) if f.name in values else pa.nulls(n, f.type) for f in NODE_SCHEMA]
    return pa.RecordBatch.from_arrays(columns, schema=NODE_SCHEMA)


def turn_code(role: Column, text: Column) -> Column:
    """A turn as bytes: what it says, and how long its text is. A null role or text is an empty one."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    length = F.lpad(F.hex(F.octet_length(text)), 2 * LENGTH_BYTES, "0")
    return F.unhex(F.concat(F.substring(said, 1, 2 * DIGEST_BYTES), length))


def conversation_codes(turns: DataFrame) -> DataFrame:
    """(conv_id, codes): the codes of each conversation's turns by turn, null first; equal turns by their codes.

    Turns without a conv_id belong to no conversation. A conversation is one row, of 22 bytes a turn.
    """
    rows = turns.filter(F.col("conv_id").isNotNull())
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), turn_code(F.col("role"), F.col("text")).alias("code"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "code")))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda each: each["code"]).alias("codes"))


def path_of(codes: Column) -> Column:
    return F.unhex(F.array_join(F.transform(codes, F.hex), ""))


def hash_of_ids(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, id): SHA-256 of each key's ids as text, ascending and with commas.

    Ids go by ranges of (key, id), so that those of one key may lie in many tasks, which write them as text in parts. The
    parts of a key then pass one task in order; no more than one part is held.
    """
    ship_package(rows.sparkSession)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        done: list[tuple] = []
        for batch in batches:
            for at, found in zip(batch.column("key").to_pylist(), batch.column("id").to_pylist(), strict=True):
                if at != key or len(ids) == IDS_PER_PART:
                    if ids:
                        done.append((key, ids[0], ",".join(map(str, ids))))
                    key, ids = at, []
                ids.append(found)
            if done:
                yield _ids_batch(done)
                done = []
        if ids:
            yield _ids_batch([(key, ids[0], ",".join(map(str, ids)))])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hashed = None, hashlib.sha256()
        for batch in batches:
            done = []
            for at, text in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if at == key:
                    hashed.update(b",")
                else:
                    if key is not None:
                        done.append((key, hashed.hexdigest()))
                    key, hashed = at, hashlib.sha256()
                hashed.update(text.encode())
            yield _hash_batch(done)
        if key is not None:
            yield _hash_batch([(key, hashed.hexdigest())])

    ranged = rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    told = ranged.mapInArrow(parts, "`key` binary, first long, ids string")
    return told.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashes, "`key` binary, ends_sha256 string")


def _ids_batch(rows: list[tuple]) -> pa.RecordBatch:
    keys, firsts, ids = zip(*rows, strict=True)
    columns = [pa.array(keys, pa.binary()), pa.array(firsts, pa.int64()), pa.array(ids, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["key", "first", "ids"])


def _hash_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([key for key, _ in rows], pa.binary()), pa.array([made for _, made in rows], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["key", "ends_sha256"])


def shard_nodes(paths: DataFrame, nodes: int = SHARD_NODES) -> DataFrame:
    """The nodes of every shard's trie from (path, n, first, ends_sha256), as NODE has them: done, or of a spine."""
    ship_package(paths.sparkSession)
    names = ["path", "n", "first", "ends_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, Shard()
        for batch in batches:
            for row in zip(*(batch.column(name).to_pylist() for name in names), strict=True):
                if shard.paths and shard.n_nodes >= nodes:
                    yield shard.nodes(number)
                    number, shard = number + 1, Shard()
                shard.add(*row)
        if shard.paths:
            yield shard.nodes(number)

    return paths.select(*names).repartitionByRange("path").sortWithinPartitions("path").mapInArrow(run, NODE)


def merged_spines(spine: DataFrame) -> DataFrame:
    """The nodes of all shards' first and last paths, each once, with what all shards hold below it.

    A node of several lines is counted by one of them, its owner. A line's running sums from its end upward then add up
    for each node to what the owned nodes below it have.
    """
    sums = [F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    least = [F.min(name).alias(name) for name in ("parent_key", "depth", "n_bytes", "conv_id")]
    one = spine.groupBy("key").agg(*sums, *least, F.max("ends_sha256").alias("ends_sha256"), F.min("line").alias("owner"))
    one = written(one, "spine")
    kids = one.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    one = one.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = one.select(
        "key",
        F.col("owner").alias("line"),
        (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("own"),
    )
    below = Window.partitionBy("line").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    told = spine.select("key", "line", "depth").join(own, ["key", "line"], "left").fillna(0, ["leaf", "own"])
    told = told.select("key", F.sum("leaf").over(below).alias("leaf"), F.sum("own").over(below).alias("own"))
    totals = told.groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    done = one.join(totals, "key")
    done = done.withColumn("n_leaves", F.col("n_leaves") + F.col("leaf")).withColumn("saved_tokens", F.col("saved_tokens") + F.col("own"))
    return written(done.select("key", "parent_key", *(name for name in COLUMNS if name != "parent_conv_id")), "spine")


def prefix_trie(conversations: DataFrame, shard_size: int = SHARD_NODES) -> DataFrame:
    """One row per node of the trie of (conv_id, codes): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    A node is a distinct beginning of `depth` turns, and conv_id the smallest conversation that has it. Conversations
    without turns end at the root. Each conv_id stands once, as conversation_codes gives them. Without conversations
    there is no node, not even a root. Groups of like conversations are brought together before anything is sorted.
    """
    rows = conversations.select(F.col("conv_id").alias("id"), path_of(F.col("codes")).alias("path"))
    rows = rows.withColumn("key", F.unhex(F.substring(F.sha2("path", 256), 1, 2 * DIGEST_BYTES)))
    rows = written(rows, "paths")
    paths = rows.groupBy("key", "path").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    paths = written(paths.join(hash_of_ids(rows.select("key", "id")), "key").drop("key"), "ends")
    nodes = written(shard_nodes(paths, shard_size), "nodes")
    spine = nodes.filter("spine")
    merged = merged_spines(spine)

    of_parent = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    done = [merged.join(of_parent, "parent_key", "left").select(*COLUMNS)]
    inner = nodes.filter("not spine")
    done.append(inner.filter("at is null").select(*COLUMNS))
    # A node may stand in both lines of its shard, and is looked up once.
    places = spine.select("shard", "at", "key").distinct().join(merged.select("key", F.col("conv_id").alias("up")), "key")
    under = inner.filter("at is not null").join(places.select("shard", "at", "up"), ["shard", "at"])
    done.append(under.withColumn("parent_conv_id", F.col("up")).select(*COLUMNS))
    every = done[0].unionByName(done[1]).unionByName(done[2])
    return every.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))


def regrown(own: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, codes) with the first turns of the conversation c - c % every, as many as a hash of c says, and c's own after.

    A missing conversation lends no turns.
    """
    own = written(own, "conversations")
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = own.filter(F.col("conv_id") % every == 0)
    heads = heads.select(F.col("conv_id").alias("base"), F.slice("codes", 1, most - 1).alias("head"))
    rows = own.withColumn("base", base).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    joined = rows.join(heads, "base", "left")
    nothing = F.array().cast("array<binary>")
    lent = F.slice(F.coalesce("head", nothing), F.lit(1), F.col("h"))
    kept = F.slice("codes", F.col("h") + 1, F.greatest(F.size("codes") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(lent, kept).alias("codes"))
