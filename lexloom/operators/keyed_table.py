"""A table with one row per key: rows lie in buckets by key, a change rewrites only its buckets, and commits have numbers.

Every commit is one entry of a log, which is made only if its number is still free. Of two writers that want the same
number, one gets it; the other reads what has changed and tries the next one. So the order is that of the numbers, not of
anyone's clock. An entry says which folder holds each bucket and the last batch of each writer: a batch that runs again
finds itself there and changes nothing. Readers hold a version and are not disturbed by later ones.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexloom.operators.store import small
from lexloom.session import written

BUCKETS = 16
#: How many files a task writes at a time before it sorts what is left, and their row groups.
OPEN_FILES, ROW_GROUP_BYTES = "spark.sql.maxConcurrentOutputFileWriters", 16 * 1024 * 1024


class Batch(NamedTuple):
    """A batch number means something only together with who counts: two checkpoints both start at 0."""

    writer: str
    number: int


def as_batch(batch: Batch | int) -> Batch:
    return batch if isinstance(batch, Batch) else Batch("direct", batch)


class Files:
    """Small files of a shared folder, through the file systems that Spark uses."""

    def __init__(self, spark: SparkSession):
        self._context = spark.sparkContext
        self._hadoop = self._context._jvm.org.apache.hadoop.fs

    def _place(self, path: str) -> tuple:
        place = self._hadoop.Path(path)
        return place, place.getFileSystem(self._context._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        place, system = self._place(folder)
        return [each.getPath().getName() for each in system.listStatus(place)] if system.exists(place) else []

    def read(self, path: str) -> str:
        place, system = self._place(path)
        stream = system.open(place)
        try:
            return self._context._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Makes the file with this text, whole or not at all; False where there is one of that name already."""
        folder, _, name = path.rpartition("/")
        aside, system = self._place(f"{folder}/.{name}-{uuid.uuid4().hex}")
        stream = system.create(aside)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = getattr(self._hadoop, "Options$Rename")
        how = self._context._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        files = self._hadoop.FileContext.getFileContext(system.getUri(), self._context._jsc.hadoopConfiguration())
        try:
            files.rename(aside, self._place(path)[0], how)
        except Exception as error:
            system.delete(aside, False)
            if "FileAlreadyExistsException" in str(error):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        place, system = self._place(path)
        system.delete(place, True)


class KeyedTable:
    """Rows of one schema, one per key. All state is in the folder, so any session that opens it sees what was written."""

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType | str | None = None, keys: list[str] | None = None, buckets: int = BUCKETS
    ):
        """Schema, keys and buckets count only when the table is made; later they are read from it."""
        self.spark, self.path = spark, path.rstrip("/")
        self._files, self._schema, self._keys, self._buckets = Files(spark), schema, keys, buckets

    def init(self) -> None:
        """Makes the table if there is none; otherwise does nothing."""
        if not self._files.names(self._log):
            schema = self.spark.createDataFrame([], self._schema).schema
            made = {"schema": schema.json(), "keys": self._keys, "buckets": self._buckets, "folders": {}, "writers": {}}
            self._files.create(self._entry_path(0), json.dumps(made))

    @property
    def _log(self) -> str:
        return f"{self.path}/log"

    def _entry_path(self, version: int) -> str:
        return f"{self._log}/{version:012d}.json"

    def version(self) -> int | None:
        """Number of the last commit; None where there is no table."""
        numbers = [int(name[:-5]) for name in self._files.names(self._log) if name.endswith(".json") and not name.startswith(".")]
        return max(numbers, default=None)

    def entry(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return {"version": version, **json.loads(self._files.read(self._entry_path(version)))}

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version, the last one by default."""
        entry = self.entry(version)
        return self._rows(entry, entry["folders"])

    def _rows(self, entry: dict, buckets) -> DataFrame:
        schema = StructType.fromJson(json.loads(entry["schema"]))
        folders = [f"{self.path}/data/{folder}/bucket={b}" for b in sorted(buckets) for folder in entry["folders"].get(b, ())]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    @staticmethod
    def _bucket(entry: dict) -> Column:
        return F.pmod(F.xxhash64(*entry["keys"]), F.lit(entry["buckets"])).cast("int")

    def write(self, rows: DataFrame, batch: Batch | int, removed: DataFrame | None = None) -> int:
        """Puts the rows in place of those with their keys, without the keys in `removed`, as one commit; its number.

        Rows of equal keys in one batch: that of the greatest hash stays. A batch whose number its writer has passed is
        known already and changes nothing. New rows are written once, in their buckets. Of the buckets that they touch,
        the old rows that stay are written beside them; these are never shuffled while the changed keys are few enough to
        be sent to them.
        """
        batch = as_batch(batch)
        self.init()
        entry = self.entry()
        if self._known(entry, batch):
            return entry["version"]
        schema, keys = StructType.fromJson(json.loads(entry["schema"])), entry["keys"]
        new = self._stored(rows.select(*schema.names), entry)
        changes = self._folder_rows(new, schema)
        if not changes.groupBy(*keys).count().filter("count > 1").isEmpty():
            repeated, new = new, self._stored(one_per_key(changes, keys), entry)
            self._files.delete(f"{self.path}/data/{repeated}")
            changes = self._folder_rows(new, schema)
        gone = changes.select(*keys)
        touched = set(self._filled(new))
        if removed is not None:
            taken = written(removed.select(*keys).withColumn("bucket", self._bucket(entry)), "removed")
            touched |= {str(row.bucket) for row in taken.select("bucket").distinct().collect()}
            gone = gone.unionByName(taken.drop("bucket")).distinct()
        old = self._left(entry, gone, touched)
        while True:
            made = {name: entry[name] for name in ("schema", "keys", "buckets")}
            made["folders"] = {b: folders for b, folders in entry["folders"].items() if b not in touched}
            for folder in (new, *([old] if old else [])):
                for b in self._filled(folder):
                    made["folders"].setdefault(b, []).append(folder)
            made["writers"] = entry["writers"] | {batch.writer: batch.number}
            if self._files.create(self._entry_path(entry["version"] + 1), json.dumps(made)):
                return entry["version"] + 1
            before, entry = entry, self.entry()
            if self._known(entry, batch):
                return entry["version"]
            if any(before["folders"].get(b) != entry["folders"].get(b) for b in touched):
                old = self._left(entry, gone, touched)

    @staticmethod
    def _known(entry: dict, batch: Batch) -> bool:
        return entry["writers"].get(batch.writer, -1) >= batch.number

    def _filled(self, folder: str) -> list[str]:
        return [name.partition("=")[2] for name in self._files.names(f"{self.path}/data/{folder}") if name.startswith("bucket=")]

    def _stored(self, rows: DataFrame, entry: dict) -> str:
        """Writes the rows in their buckets to a folder of their own, one file or few in each.

        Rebalanced, so that a bucket with many rows is written by several tasks.
        """
        return self._in_buckets(rows.withColumn("bucket", self._bucket(entry)).hint("rebalance", "bucket"), entry)

    def _in_buckets(self, rows: DataFrame, entry: dict) -> str:
        """Writes rows that say their bucket to a new folder.

        A task keeps a file open for each bucket, with short row groups. It would sort its rows by bucket otherwise, and
        wide rows, which are far longer in memory than in files, took memory in proportion to a bucket.
        """
        folder, conf = uuid.uuid4().hex, rows.sparkSession.conf
        before = conf.get(OPEN_FILES)
        conf.set(OPEN_FILES, str(entry["buckets"]))
        try:
            rows.write.partitionBy("bucket").option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{self.path}/data/{folder}")
        finally:
            conf.set(OPEN_FILES, before)
        return folder

    def _folder_rows(self, folder: str, schema: StructType) -> DataFrame:
        """The rows of a folder, whatever buckets it has."""
        filled = [f"{self.path}/data/{folder}/bucket={b}" for b in self._filled(folder)]
        return self.spark.read.schema(schema).parquet(*filled) if filled else self.spark.createDataFrame([], schema)

    def _left(self, entry: dict, gone: DataFrame, touched: set[str]) -> str | None:
        """The folder with what is left of the old rows of these buckets without the keys that are gone; None for nothing."""
        if not any(b in entry["folders"] for b in touched):
            return None
        changed = small(gone.select(*(F.col(key).alias(f"_{key}") for key in entry["keys"])))
        same = [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in entry["keys"]]
        left = self._rows(entry, touched).join(changed, same, "left_anti")
        return self._in_buckets(left.withColumn("bucket", self._bucket(entry)), entry)

    def pinned(self, batch: Batch | int) -> int:
        """The version that a batch reads: the last one when the batch first asked, the same one whenever it runs again."""
        batch = as_batch(batch)
        path = f"{self.path}/pins/{batch.writer}-{batch.number}"
        self._files.create(path, str(self.version()))
        return int(self._files.read(path))

    def clean(self, keep: int = 2) -> None:
        """Deletes the folders that none of the last versions holds. Readers of older versions must have ended."""
        version = self.version()
        held = {f for v in range(max(0, version - keep + 1), version + 1) for each in self.entry(v)["folders"].values() for f in each}
        for name in self._files.names(f"{self.path}/data"):
            if name not in held:
                self._files.delete(f"{self.path}/data/{name}")

    def rebuilt(self, path: str, buckets: int) -> KeyedTable:
        """The rows in a new table of as many buckets as their number now needs."""
        entry = self.entry()
        made = KeyedTable(self.spark, path, StructType.fromJson(json.loads(entry["schema"])), entry["keys"], buckets)
        made.write(self.read(entry["version"]), Batch("rebuilt", 0))
        return made


def one_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the greatest hash for each key. Rows are only moved if some key stands twice."""
    if rows.groupBy(*keys).count().filter("count > 1").isEmpty():
        return rows
    hashed = rows.withColumn("_hash", F.xxhash64(*rows.columns))
    most = hashed.groupBy(*keys).agg(F.max("_hash").alias("_most"))
    same = [F.col(f"r.{key}").eqNullSafe(F.col(f"m.{key}")) for key in keys]
    found = hashed.alias("r").join(most.alias("m"), same).filter("r._hash = m._most")
    return found.select("r.*").drop("_hash").dropDuplicates(keys)
