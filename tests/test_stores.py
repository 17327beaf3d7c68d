import random
from datetime import datetime

from pyspark.sql import functions as F

from lexloom.operators import frontier as fr
from lexloom.operators import ranking
from lexloom.operators.dated_table import DatedTable
from lexloom.operators.keyed_table import OPEN_FILES, Batch, KeyedTable
from lexloom.operators.ranking import crawl_schedule
from lexloom.operators.refresh import CrawlState, full_refresh
from lexloom.operators.store import latest_per_key, lookup, upsert
from lexloom.operators.vector_table import VectorTable
from lexloom.session import work_path


def test_latest_row_of_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), (F.col("id") * 7919 % 3001).alias("seq"), "id")
    best = latest_per_key(rows, ["k"], ["seq"]).filter("k = 0").first()
    expected = max((i * 7919 % 3001, i) for i in range(0, 3000, 3))
    assert (best.seq, best.id) == expected and latest_per_key(rows, ["k"], ["seq"]).count() == 2001


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, seq int, body string")
    new = spark.createDataFrame([("b", 2, "z"), ("c", 2, "w")], "id string, seq int, body string")
    once = upsert(old, new, ["id"], ["seq"])
    assert sorted(map(tuple, once.collect())) == [("a", 1, "x"), ("b", 2, "z"), ("c", 2, "w")]
    assert sorted(map(tuple, upsert(once, new, ["id"], ["seq"]).collect())) == sorted(map(tuple, once.collect()))


def test_lookup_either_way(spark):
    wanted = spark.createDataFrame([(1, "a"), (2, "a"), (3, "n")], "w int, id string")
    store = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, body string")
    for limit in (0, 100):
        found = sorted((r.w, r.body, r.missing) for r in lookup(wanted, store, "id", limit).collect())
        assert found == [(1, "A", False), (2, "A", False), (3, None, True)]


def test_unseen_and_merge(spark):
    frontier = spark.createDataFrame([("a",), ("a",), ("b",), ("B",)], "url string")
    seen = spark.createDataFrame([("b",)], "url string")
    assert sorted(r.url for r in fr.unseen(frontier, seen).collect()) == ["B", "a"]
    assert sorted(r.url for r in fr.merge_seen(seen, frontier).collect()) == ["B", "a", "b"]


def test_closure_with_cycles_and_a_hub(spark):
    random.seed(5)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(90)] + [(0, d) for d in range(20, 40)] + [(1, 0)]
    depths, level, depth = {1: 0}, {1}, 0
    while level:
        depth += 1
        level = {d for s, d in edges if s in level} - depths.keys()
        depths.update(dict.fromkeys(level, depth))
    frame = spark.createDataFrame([(str(s), str(d)) for s, d in edges], "src string, dst string")
    seeds = spark.createDataFrame([("1",), ("1",)], "url string")
    for per_block in (400_000, 7):
        rows = fr.crawl_closure(frame, seeds, per_block).collect()
        assert {int(r.url): r.depth for r in rows} == depths and len(rows) == len(depths)
    blocks = fr.in_blocks(frame.distinct(), frame.distinct().count(), 7).groupBy("src", "block").count()
    assert blocks.agg(F.max("count")).first()[0] <= 14 and fr.crawl_closure(frame.limit(0), seeds).collect() == [("1", 0)]


def test_closure_of_a_deep_graph_of_half_a_million_edges_takes_few_rounds(spark, monkeypatch):
    """It took two blocks, and one round for each time that a shortest way changed between them."""
    n, rounds, store = 225_001, [], fr._store_round

    def stored(found, folder, number):
        assert number < 4
        rounds.append(number)
        return store(found, folder, number)

    monkeypatch.setattr(fr, "_store_round", stored)
    name = F.concat(F.lit("https://www.revisor.mn.gov/"), F.col("id").cast("string"))
    ways = spark.range(n).select(name.alias("src"), F.explode(F.array(F.col("id") + 1, F.col("id") + 40)).alias("id"))
    found = fr.crawl_closure(ways.select("src", name.alias("dst")), spark.range(1).select(name.alias("url")))
    at = F.element_at(F.split("url", "/"), -1).cast("long")
    wrong = found.filter(F.col("depth") != F.floor(at / 40) + at % 40)
    assert found.agg(F.count("url"), F.countDistinct("url")).first() == (n + 40, n + 40) and wrong.isEmpty()
    assert len(rounds) == 3


def test_schedule_over_several_ranges(spark):
    urls = [f"u{random.Random(i).random():.6f}" for i in range(500)]
    frame = spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, page_id int").repartition(6)
    found = crawl_schedule(frame, ["url", "page_id"], 3 + F.col("page_id") % 2)
    expected, clock = {}, {}
    for rn, (url, page_id) in enumerate(sorted((u, i) for i, u in enumerate(urls)), 1):
        worker = rn % 6
        expected[page_id] = (rn, worker, clock.get(worker, 0))
        clock[worker] = clock.get(worker, 0) + 3 + page_id % 2
    assert {r.page_id: (r.rn, r.worker, r.start) for r in found.collect()} == expected


def test_numbers_do_not_depend_on_the_ranges(spark, monkeypatch):
    rows = spark.range(0, 3000, 1, 7).select((F.col("id") * 7919 % 3001).alias("k"), (F.col("id") % 2 == 0).alias("even"))
    wanted = {k: rn for rn, k in enumerate(sorted(i * 7919 % 3001 for i in range(3000)), 1)}
    for limit in (1_000_000, 50):
        monkeypatch.setattr(ranking, "ROWS_PER_RANGE", limit)
        found = ranking.numbered(rows, ["k"]).collect()
        assert {r.k: r.rn for r in found} == wanted
    assert len({r.part for r in found}) > 8 and ranking.numbered(rows.limit(0), ["k"]).count() == 0


def test_delivery_states(spark):
    frame = spark.createDataFrame([(0,), (1,), (2,), (9,)], "n int")
    assert [r[0] for r in frame.select(fr.delivery_state(F.col("n"))).collect()] == ["done", "retry", "dead_letter", "dead_letter"]


def test_refresh_with_seeds(spark):
    old = spark.createDataFrame([("a",), ("b",), ("b",)], "url string")
    seeds = spark.createDataFrame([("s",), ("t",)], "url string")
    rows = full_refresh(spark, work_path(spark, "state"), old, old, seeds).collect()
    assert {r.store: (r.before, r.after) for r in rows} == {"seen": (2, 0), "frontier": (3, 2)}


def test_vector_table(spark):
    path = work_path(spark, "vectors")
    table = VectorTable(spark, path, 2)
    assert table.read().count() == 0
    table.init()
    table.init()
    first = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, vector array<double>")
    table.upsert(first, 0)
    table.upsert(spark.createDataFrame([("b", [1.0, 1.0])], "id string, vector array<double>"), 1)
    table.upsert(first, 0)
    wanted = {"a": [1.0, 0.0], "b": [1.0, 1.0]}
    assert {r.id: r.vector for r in table.read().collect()} == wanted
    asked = spark.createDataFrame([("q", [1.0, 0.9])], "query_id string, vector array<double>")
    assert [r.id for r in table.search(asked, 2, 1).collect()] == ["b"]
    again = VectorTable(spark, path, 2)
    again.init()
    assert {r.id: r.vector for r in again.read().collect()} == wanted
    smaller = again.rebuilt(work_path(spark, "vectors"), 3)
    smaller.upsert(spark.createDataFrame([("a", [0.0, 3.0])], "id string, vector array<double>"), 0)
    assert {r.id: r.vector for r in smaller.read().collect()} == wanted | {"a": [0.0, 3.0]}


def test_two_writers_of_batch_0_keep_both(spark):
    table = VectorTable(spark, work_path(spark, "vectors"), 2)
    kind = "id string, vector array<double>"
    table.upsert(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], kind), Batch("one", 0))
    table.upsert(spark.createDataFrame([("b", [5.0, 1.0]), ("c", [1.0, 1.0])], kind), Batch("two", 0))
    table.upsert(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], kind), Batch("one", 0))
    assert {r.id: r.vector[0] for r in table.read().collect()} == {"a": 1.0, "b": 5.0, "c": 1.0}


def test_vectors_that_cannot_be_indexed_are_kept_aside(spark):
    table = VectorTable(spark, work_path(spark, "vectors"), 2)
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0]), ("d", None), ("e", [float("nan"), 1.0])]
    table.upsert(spark.createDataFrame(rows, "id string, vector array<double>"), 0)
    assert [r.id for r in table.read().collect()] == ["a"]
    refused = {r.id: r.error_code for r in table.refused().collect()}
    assert refused == {"b": "zero_vector", "c": "wrong_dimension", "d": "no_vector", "e": "bad_element"}


def test_refreshed_state_is_found_again(spark):
    folder = work_path(spark, "state")
    urls = [spark.createDataFrame([(name,)], "url string") for name in "abc"]
    CrawlState(spark, folder).start(urls[0], urls[0])
    CrawlState(spark, folder).refresh(urls[1])
    state = CrawlState(spark, folder)
    assert state.generation == 1 and state.read("seen").count() == 0 and state.read("frontier").first().url == "b"
    state.refresh(urls[2])
    assert CrawlState(spark, folder).read("frontier").first().url == "c" and state.generation == 2


KIND = "id string, body string, n int"


def rows_of(table, version=None):
    return {r.id: (r.body, r.n) for r in table.read(version).collect()}


def test_commits_come_in_the_order_in_which_they_are_made(spark, monkeypatch):
    """Whatever a writer's clock says and however its batches are numbered."""
    import time

    path = work_path(spark, "keyed")
    KeyedTable(spark, path, KIND, ["id"], 4).write(spark.createDataFrame([("a", "first", 1), ("b", "first", 1)], KIND), Batch("one", 7))
    monkeypatch.setattr(time, "time_ns", lambda: 0)
    KeyedTable(spark, path).write(spark.createDataFrame([("a", "second", 2)], KIND), Batch("two", 7))
    table = KeyedTable(spark, path)
    assert rows_of(table) == {"a": ("second", 2), "b": ("first", 1)} and table.read().count() == 2
    assert rows_of(table, 1) == {"a": ("first", 1), "b": ("first", 1)} and table.read(0).count() == 0


def test_two_writers_that_commit_at_once_both_stay(spark, monkeypatch):
    """The second writer commits while the first is still writing its buckets: on other keys, on the same key."""
    for key in ("z", "a"):
        path = work_path(spark, "keyed")
        first, second = KeyedTable(spark, path, KIND, ["id"], 2), KeyedTable(spark, path)
        first.write(spark.createDataFrame([("a", "old", 0), ("b", "old", 0)], KIND), Batch("zero", 0))
        left, once = first._left, []

        def slow(*given):
            made = left(*given)
            if not once:
                once.append(second.write(spark.createDataFrame([(key, "between", 1)], KIND), Batch("two", 0)))
            return made

        monkeypatch.setattr(first, "_left", slow)
        assert first.write(spark.createDataFrame([("a", "late", 2)], KIND), Batch("one", 0)) == 3 and once == [2]
        assert rows_of(first) == {"a": ("late", 2), "b": ("old", 0)} | ({"z": ("between", 1)} if key == "z" else {})
        assert first.read().count() == (3 if key == "z" else 2)


def test_only_buckets_of_changed_keys_are_written_and_old_rows_stay_where_they_are(spark):
    table = KeyedTable(spark, work_path(spark, "keyed"), KIND, ["id"], 8)
    table.write(spark.range(200).selectExpr("cast(id AS string) AS id", "'x' AS body", "cast(id AS int) AS n"), 0)
    before = table.entry()["folders"]
    assert len(before) == 8
    table.write(spark.createDataFrame([("5", "y", 9)], KIND), 1, removed=spark.createDataFrame([("5",), ("7",)], "id string"))
    after = table.entry()["folders"]
    changed = [b for b in after if after[b] != before[b]]
    assert 1 <= len(changed) <= 2 and table.read().count() == 199 and rows_of(table)["5"] == ("y", 9)
    plan = table._rows(table.entry(), changed).join(F.broadcast(spark.createDataFrame([("5",)], "k string")), F.col("id") == F.col("k"), "left_anti")
    assert "Exchange hashpartitioning" not in plan._jdf.queryExecution().toString()
    table.clean(1)
    assert table.read().count() == 199 and sorted(table._files.names(f"{table.path}/data")) == sorted({f for each in after.values() for f in each})


def test_repeated_and_null_keys_and_empty_batches(spark):
    table = KeyedTable(spark, work_path(spark, "keyed"), KIND, ["id"], 3)
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "y", 2), (None, "n", 1), (None, "m", 2)], KIND)
    table.write(rows, 0)
    assert table.read().count() == 2
    table.write(spark.createDataFrame([(None, "later", 3)], KIND), 1)
    assert rows_of(table)[None] == ("later", 3) and table.read().count() == 2
    assert table.write(rows.limit(0), 2) == 3 and table.read().count() == 2
    assert table.rebuilt(work_path(spark, "keyed"), 5).read().count() == 2


def test_old_days_are_dropped_whole_and_readers_keep_their_version(spark, monkeypatch):
    kind = "n int, ts timestamp"
    table = DatedTable(spark, work_path(spark, "dated"), kind, ["ts"])

    def rows(*given):
        return spark.createDataFrame([(n, at and datetime.fromisoformat(at)) for n, at in given], kind)

    table.write(rows((1, "2024-01-01T10:00"), (2, "2024-01-03T09:00"), (3, "2024-01-03T11:00"), (4, None)), 0)
    table.write(rows((5, "2024-01-03T12:00"), (6, "2024-01-09T12:00"), (6, "2024-01-09T12:00")), 1)
    table.write(rows((9, "2024-01-09T12:00")), 1)
    before = table.version()
    monkeypatch.setattr(table, "_rows", None)
    table.expire(datetime.fromisoformat("2024-01-10T10:00"), 7, Batch("expiring", 0))
    monkeypatch.undo()
    assert sorted(r.n for r in table.read().collect()) == [3, 4, 5, 6, 6] and "2024-01-01" not in table.entry()["folders"]
    assert sorted(r.n for r in table.read(before).collect()) == [1, 2, 3, 4, 5, 6, 6]
    table.compact(Batch("compacting", 0))
    assert {len(folders) for folders in table.entry()["folders"].values()} == {1}
    table.clean(1)
    assert sorted(r.n for r in table.read().collect()) == [3, 4, 5, 6, 6]
    table.expire(datetime.fromisoformat("2024-01-02T10:00"), 7, Batch("expiring", 1))
    assert table.read().count() == 5


def test_a_bucket_of_many_rows_is_written_by_several_tasks(spark):
    """And not sorted in memory; the setting that keeps files open is put back."""
    table, kept = KeyedTable(spark, work_path(spark, "wide"), "id long, text string", ["id"], 1), spark.conf.get(OPEN_FILES)
    rows = spark.range(0, 40_000, 1, 8).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    advised = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(advised)
    spark.conf.set(advised, "256k")
    try:
        table.write(rows, 0)
        table.write(rows.filter("id < 10").withColumn("text", F.lit("new")), 1)
    finally:
        spark.conf.set(advised, before)
    assert len(table.read(1).inputFiles()) > 1
    assert table.read().count() == 40_000 and table.read().filter("text = 'new'").count() == 10
    assert spark.conf.get(OPEN_FILES) == kept
