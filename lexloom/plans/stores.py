"""Queries over keyed stores: raw pages, chunks, vectors, messages, guards and retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lexloom.functions.text import is_localhost_url, raw_object_key
from lexloom.operators.dated_table import DatedTable
from lexloom.operators.keyed_table import Batch
from lexloom.operators.answer import outbound_message
from lexloom.operators.chunk import document_chunks
from lexloom.operators.frontier import seeds_or_default
from lexloom.operators.refresh import full_refresh as refresh_state
from lexloom.operators.store import fits_message, kept_since, latest_per_key, lookup, prefix_error, upsert
from lexloom.operators.vector_table import VectorTable
from lexloom.params import (
    DEAD_LETTER_RETENTION_DAYS,
    MESSAGE_RETENTION_DAYS,
    PAGE_RETENTION_DAYS,
    RAW_PREFIX,
)
from lexloom.session import work_path
from lexloom.sources import events as messages
from lexloom.sources.tables import table

SENDER = "15550001111"
#: Length of the vectors in the given table.
EMBEDDING_DIM = 64

DOCUMENT_CHUNKS = """
WITH doc_lines AS (
  SELECT doc_id, lang, source, unnest(range(1, len(lines) + 1)) AS n, unnest(lines) AS line
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS lines FROM documents)
), doc_chunks AS (
  SELECT doc_id, lang || '.' || doc_id || '.' || n AS id,
         '§ ' || lang || '.' || doc_id || ', subd. ' || n || ': ' || source || chr(10) || line || chr(10) AS body
  FROM doc_lines WHERE line <> ''
)
"""


def raw_page_scan(spark, sf):
    """The text of every page by its key; only the needed columns are read."""
    pages = table(spark, sf, "pages")
    return pages.select(raw_object_key(F.col("url")).alias("object_key"), F.md5("html").alias("html_md5"), F.length("html").alias("n_chars"))


def raw_page_upsert(spark, sf):
    """Every page stored once, then again with new text under a later or an earlier sequence number."""
    pages = table(spark, sf, "pages")
    first = pages.select(raw_object_key(F.col("url")).alias("object_key"), "html", F.lit(1).alias("seq"))
    again = pages.select(
        raw_object_key(F.col("url")).alias("object_key"),
        F.concat("html", F.lit("<!-- again -->")).alias("html"),
        F.when(F.col("page_id") % 2 == 0, 2).otherwise(0).alias("seq"),
    )
    stored = upsert(first, again, ["object_key"], ["seq"])
    return stored.select("object_key", "seq", F.md5("html").alias("html_md5"))


def raw_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", raw_object_key(F.col("url")).alias("object_key"))


def prefix_guard(spark, sf):
    """Every page under its full key and under the bare file name, which the guard refuses."""
    full = table(spark, sf, "pages").select("page_id", raw_object_key(F.col("url")).alias("object_key"))
    bare = full.select("page_id", F.substring_index("object_key", "raw/", -1).alias("object_key"))
    keys = full.unionByName(bare)
    return keys.withColumn("error_code", prefix_error(F.col("object_key"), RAW_PREFIX))


def chunk_upsert(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.concat_ws(".", "l_orderkey", "l_linenumber").alias("id"), "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    return latest_per_key(lines, ["id"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]).select(
        "id", "l_partkey", "l_suppkey", "l_extendedprice"
    )


def chunk_lookup(spark, sf):
    """The first chunk of the English document numbered like each benchmark item, where the store has it."""
    wanted = table(spark, sf, "benchmark").select("item_id", F.format_string("en.%d.1", "item_id").alias("id"))
    store = document_chunks(table(spark, sf, "documents")).select("id", "body")
    return lookup(wanted, store, "id").select("item_id", "id", "body", "missing")


def all_document_chunks(spark, sf):
    return document_chunks(table(spark, sf, "documents"))


def object_events(spark, sf):
    """Every event as an object-created message; some cut short, so that they cannot be read."""
    events = table(spark, sf, "events")
    number = F.get_json_object("props", "$.k").cast("int")
    key = F.when(number % 2 == 0, F.format_string("raw/%d.html", "event_id")).otherwise(
        F.format_string("chunk/%d.txt", "event_id")
    )
    body = F.to_json(
        F.struct(
            F.lit("aws.s3").alias("source"),
            F.when(F.col("event_type") == "error", "Object Deleted").otherwise("Object Created").alias("detail-type"),
            F.struct(
                F.struct(F.when(F.col("user_id") % 10 == 0, "other").otherwise("main").alias("name")).alias("bucket"),
                F.struct(key.alias("key")).alias("object"),
            ).alias("detail"),
        )
    )
    cut = F.when(F.col("user_id") % 10 == 1, F.substring(body, F.lit(1), F.length(body) - 3)).otherwise(body)
    return events.select("event_id", cut.alias("body"))


def object_event_route(spark, sf):
    events = object_events(spark, sf).withColumn("event", messages.parsed(F.col("body"), messages.OBJECT_EVENT))
    route = messages.event_route(F.col("event"), "main")
    return events.select(
        "event_id",
        F.when(route != "bad_event", F.col("event.detail.object.key")).alias("object_key"),
        route.alias("route"),
    )


def inbound_messages(spark, sf):
    """User turns as inbound messages; the tenth of them cut short."""
    turns = table(spark, sf, "conversations").filter(F.col("role") == "user")
    identity = F.concat(F.when(F.col("turn") % 2 == 1, "+").otherwise(""), F.col("conv_id").cast("string"))
    body = F.to_json(
        F.struct(
            F.struct(
                F.struct(F.struct(F.col("text").alias("text")).alias("text_message")).alias("contact_message"),
                F.struct(identity.alias("identity")).alias("channel_identity"),
            ).alias("message")
        )
    )
    cut = F.when(F.col("conv_id") % 10 == 9, F.substring(body, F.lit(1), F.length(body) - 2)).otherwise(body)
    return turns.select("conv_id", "turn", cut.alias("body"))


def webhook_parse(spark, sf):
    parsed = inbound_messages(spark, sf).withColumn("m", messages.parsed(F.col("body"), messages.INBOUND))
    good = F.col("m._bad").isNull()
    return parsed.select(
        "conv_id",
        "turn",
        F.when(good, 200).otherwise(500).alias("status"),
        F.when(good, messages.inbound_prompt(F.col("m"))).alias("prompt"),
        F.when(good, messages.inbound_identity(F.col("m"))).alias("identity"),
    )


def outbox_payload(spark, sf):
    turns = table(spark, sf, "conversations").filter(F.col("role") == "user")
    identity = F.concat(F.when(F.col("turn") % 2 == 1, "+").otherwise(""), F.col("conv_id").cast("string"))
    sent = turns.select("conv_id", "turn", outbound_message(SENDER, identity, F.col("text")).alias("payload"))
    fields = F.from_json("payload", messages.OUTBOUND)
    return sent.select(
        "conv_id",
        "turn",
        fields["from"].alias("sender"),
        F.array_join(fields["to"], ",").alias("recipients"),
        fields["body"].alias("message"),
    )


def seed_frontier(spark, sf):
    """The frontier started with every page URL as a seed, and started with no seeds."""
    urls = table(spark, sf, "pages").select("url")
    given = seeds_or_default(spark, urls).select(F.lit("given").alias("mode"), "url")
    none = seeds_or_default(spark, urls.filter(F.col("url") == "")).select(F.lit("default").alias("mode"), "url")
    return given.unionByName(none)


def retention_filter(spark, sf):
    """Events still kept as pages, dead letters and messages, counted back from the newest event."""
    events = table(spark, sf, "events")
    as_of = events.agg(F.max("ts")).first()[0] or datetime.min.replace(year=1970)
    days = max(PAGE_RETENTION_DAYS, DEAD_LETTER_RETENTION_DAYS, MESSAGE_RETENTION_DAYS)
    ts = F.col("ts")

    def since(n):
        return ts >= F.lit(kept_since(as_of, n)).cast("timestamp_ntz")

    return events.filter(since(days)).select(
        "event_id",
        since(PAGE_RETENTION_DAYS).alias("as_page"),
        since(DEAD_LETTER_RETENTION_DAYS).alias("as_dead_letter"),
        since(MESSAGE_RETENTION_DAYS).alias("as_message"),
    )


def retention_store(spark, sf):
    """Events stored in three batches, then expired as pages and brought together; what a reader is left with."""
    events = table(spark, sf, "events").select("event_id", "ts")
    as_of = events.agg(F.max("ts")).first()[0] or datetime.min.replace(year=1970)
    store = DatedTable(spark, work_path(spark, "events"), events.schema, ["ts"])
    for number in range(3):
        store.write(events.filter(F.col("event_id") % 3 == number), Batch("arriving", number))
    store.expire(as_of, PAGE_RETENTION_DAYS, Batch("expiring", 0))
    store.compact(Batch("compacting", 0))
    return store.read()


def size_guard(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.octet_length("text").alias("n_bytes"), fits_message(F.col("text")).alias("accepted")
    )


def _changed_vectors(spark, sf):
    vectors = table(spark, sf, "embeddings")
    base = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit(5).alias("seq"))
    changes = vectors.select(
        F.col("vec_id").alias("id"),
        F.reverse("embedding").alias("vector"),
        F.when(F.col("label") >= 5, F.col("label") + 1).otherwise(F.col("label")).alias("seq"),
    )
    return base, changes


def vector_upsert(spark, sf):
    """Every vector written to the table, then in reverse where its label gives it the later sequence number."""
    base, changes = _changed_vectors(spark, sf)
    vectors = VectorTable(spark, work_path(spark, "vectors"), EMBEDDING_DIM)
    vectors.init()
    vectors.upsert(base, 0)
    vectors.upsert(changes.filter("seq > 5"), 1)
    numbers = upsert(base.select("id", "seq"), changes.select("id", "seq"), ["id"], ["seq"])
    stored = vectors.read().join(numbers.withColumn("id", F.col("id").cast("string")), "id")
    first = F.get("vector", F.lit(0))
    last = F.element_at("vector", -1)
    return stored.select(
        F.col("id").cast("long").alias("id"), "seq", F.size("vector").alias("dim"), first.alias("first"), last.alias("last")
    )


def vector_table_init(spark, sf):
    """The vector table made, filled from embeddings, and opened again, which neither empties nor hides it."""
    path = work_path(spark, "vectors")
    vectors = VectorTable(spark, path, EMBEDDING_DIM)
    vectors.init()
    vectors.init()
    rows = table(spark, sf, "embeddings")
    vectors.upsert(rows.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector")), batch=0)
    again = VectorTable(spark, path, EMBEDDING_DIM)
    again.init()
    return again.read().select("id", F.size("vector").alias("dim"))


def full_refresh(spark, sf):
    """Seen set and frontier before and after a refresh without seeds."""
    pages = table(spark, sf, "pages").select("url")
    return refresh_state(spark, work_path(spark, "state"), seen=pages, frontier=pages, seeds=pages.filter(F.col("url") == ""))


def localhost_urls(spark, sf):
    """Every page URL as it is and with its host replaced by loopback and other hosts."""
    hosts = ["localhost", "localhost:8080", "127.0.0.1", "127.255.3.9:8443", "[::1]", "[0:0:0:0:0:0:0:1]:80", "128.0.0.1", "localhost.example.com", "[::2]"]
    variants = [F.col("url")] + [F.regexp_replace("url", "//[^/?#]*", f"//{host}") for host in hosts]
    urls = table(spark, sf, "pages").select("page_id", F.posexplode(F.array(*variants)).alias("variant", "url"))
    return urls.withColumn("is_localhost", is_localhost_url(F.col("url")))


QUERIES = {
    "raw_page_scan": raw_page_scan,
    "raw_page_upsert": raw_page_upsert,
    "raw_object_key": raw_key,
    "prefix_guard": prefix_guard,
    "chunk_upsert": chunk_upsert,
    "document_chunks": all_document_chunks,
    "chunk_lookup": chunk_lookup,
    "object_event_route": object_event_route,
    "webhook_parse": webhook_parse,
    "outbox_payload": outbox_payload,
    "seed_frontier": seed_frontier,
    "retention_filter": retention_filter,
    "retention_store": retention_store,
    "size_guard": size_guard,
    "vector_upsert": vector_upsert,
    "vector_table_init": vector_table_init,
    "full_refresh": full_refresh,
    "is_localhost_url": localhost_urls,
}

RAW_KEY = "'raw/url=' || to_base64(encode(url))"

ORACLES = {
    "raw_page_scan": f"SELECT {RAW_KEY} AS object_key, md5(html) AS html_md5, length(html) AS n_chars FROM pages",
    "raw_page_upsert": f"""SELECT {RAW_KEY} AS object_key, CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END AS seq,
      md5(CASE WHEN page_id % 2 = 0 THEN html || '<!-- again -->' ELSE html END) AS html_md5 FROM pages""",
    "raw_object_key": f"SELECT page_id, {RAW_KEY} AS object_key FROM pages",
    "prefix_guard": f"""SELECT page_id, {RAW_KEY} AS object_key, CAST(NULL AS VARCHAR) AS error_code FROM pages
      UNION ALL SELECT page_id, 'url=' || to_base64(encode(url)), 'wrong_prefix' FROM pages""",
    "chunk_upsert": """SELECT l_orderkey || '.' || l_linenumber AS id, l_partkey, l_suppkey, l_extendedprice FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1""",
    "document_chunks": DOCUMENT_CHUNKS + "SELECT doc_id, id, body FROM doc_chunks",
    "chunk_lookup": DOCUMENT_CHUNKS
    + """SELECT item_id, 'en.' || item_id || '.1' AS id, body, body IS NULL AS missing
      FROM benchmark LEFT JOIN doc_chunks ON doc_chunks.id = 'en.' || item_id || '.1'""",
    "object_event_route": """WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
      keyed AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'raw/' || event_id || '.html' ELSE 'chunk/' || event_id || '.txt' END AS key FROM e)
      SELECT event_id, CASE WHEN user_id % 10 = 1 THEN NULL ELSE key END AS object_key,
        CASE WHEN user_id % 10 = 1 THEN 'bad_event' WHEN event_type = 'error' OR user_id % 10 = 0 THEN 'drop'
             WHEN k % 2 = 0 THEN 'scrape' ELSE 'index' END AS route FROM keyed""",
    "webhook_parse": """SELECT conv_id, turn, CASE WHEN conv_id % 10 = 9 THEN 500 ELSE 200 END AS status,
      CASE WHEN conv_id % 10 <> 9 THEN text END AS prompt,
      CASE WHEN conv_id % 10 <> 9 THEN CASE WHEN turn % 2 = 1 THEN '+' ELSE '' END || conv_id END AS identity
      FROM conversations WHERE role = 'user'""",
    "outbox_payload": f"""SELECT conv_id, turn, '{SENDER}' AS sender, '+' || conv_id AS recipients, text AS message
      FROM conversations WHERE role = 'user'""",
    "seed_frontier": """SELECT 'given' AS mode, url FROM pages
      UNION ALL SELECT 'default', 'https://www.revisor.mn.gov/statutes/'""",
    "retention_filter": """WITH m AS (SELECT max(ts) AS as_of FROM events)
      SELECT event_id, ts >= as_of - INTERVAL 20 DAY AS as_page, ts >= as_of - INTERVAL 14 DAY AS as_dead_letter,
        ts >= as_of - INTERVAL 7 DAY AS as_message FROM events, m WHERE ts >= as_of - INTERVAL 20 DAY""",
    "retention_store": "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY",
    "size_guard": """SELECT doc_id, strlen(text) AS n_bytes, strlen(text) <= 10240 AS accepted FROM documents""",
    "vector_upsert": """SELECT vec_id AS id, CASE WHEN label >= 5 THEN label + 1 ELSE 5 END AS seq,
      len(embedding) AS dim, CAST(CASE WHEN label >= 5 THEN embedding[-1] ELSE embedding[1] END AS DOUBLE) AS first,
      CAST(CASE WHEN label >= 5 THEN embedding[1] ELSE embedding[-1] END AS DOUBLE) AS last FROM embeddings""",
    "vector_table_init": "SELECT CAST(vec_id AS VARCHAR) AS id, len(embedding) AS dim FROM embeddings",
    "full_refresh": """SELECT 'seen' AS store, count(DISTINCT url) AS before, 0 AS after FROM pages
      UNION ALL SELECT 'frontier', count(*), 1 FROM pages""",
    "is_localhost_url": """SELECT page_id, variant, CASE WHEN variant = 0 THEN url ELSE regexp_replace(url, '//[^/?#]*', '//' || host) END AS url,
      variant BETWEEN 1 AND 6 AS is_localhost
      FROM pages, (VALUES (0, ''), (1, 'localhost'), (2, 'localhost:8080'), (3, '127.0.0.1'), (4, '127.255.3.9:8443'), (5, '[::1]'),
        (6, '[0:0:0:0:0:0:0:1]:80'), (7, '128.0.0.1'), (8, 'localhost.example.com'), (9, '[::2]')) AS h(variant, host)""",
}
