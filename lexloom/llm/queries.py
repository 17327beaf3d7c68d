"""The registered queries of this subpackage, each over its whole table, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.alignment import align
from lexloom.llm.harmonic import harmonic_pack
from lexloom.llm.language import languages_of
from lexloom.llm.licenses import license_scan, scan_sql
from lexloom.llm.line_runs import LEAST_WORDS as LINE_WORDS
from lexloom.llm.line_runs import line_deduplicated
from lexloom.llm.minmax import near_duplicates
from lexloom.llm.mixing import MAX_REPEATS, OFFSET, mix, n_words
from lexloom.llm.multi_index import near_vectors
from lexloom.llm.packing import pack
from lexloom.llm.prefix_trie import conversation_codes, prefix_trie, regrown
from lexloom.llm.quality import fit_quality, quality_scores
from lexloom.llm.sentence_spans import LEAST_SENTENCES, passages_removed
from lexloom.llm.sentence_spans import LEAST_WORDS as SPAN_WORDS
from lexloom.llm.sketches import edited_fingerprints
from lexloom.sources.tables import table


def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), with_ids=False)


def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_scores(docs, fit_quality(docs, table(spark, folder, "labels")))


def minmax_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = line_deduplicated(table(spark, folder, "documents"))
    return cut.select("row.doc_id", "text", F.col("n_parts").alias("n_lines"), "n_removed")


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return edited_fingerprints(table(spark, folder, "documents"))


def embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = passages_removed(table(spark, folder, "documents"))
    return cut.select("row.doc_id", "text", F.col("n_parts").alias("n_sentences"), "n_removed")


def source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    mixed = mix(docs, [F.col("doc_id")], F.col("source"), n_words(F.col("text")))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select(F.col("key0").alias("doc_id"), "size", "source_size", "target", taken, "copies")


def license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(table(spark, folder, "documents"))


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    return languages_of(table(spark, folder, "documents"))


def harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    return harmonic_pack(table(spark, folder, "documents"), with_ids=False)


def conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(regrown(conversation_codes(table(spark, folder, "conversations"))))


def tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align(table(spark, folder, "documents"))


QUERIES = {
    "op1_best_fit_packing": best_fit_packing,
    "op2_quality_classifier": quality_classifier,
    "op3_minmax_near_dedup": minmax_near_dedup,
    "op4_line_dedup": line_dedup,
    "op5_fingerprints": fingerprints,
    "op6_embedding_near_dedup": embedding_near_dedup,
    "op7_substring_dedup": substring_dedup,
    "op8_source_mixing": source_mixing,
    "op9_license_scans": license_scans,
    "op10_language_id": language_id,
    "op11_harmonic_packing": harmonic_packing,
    "op12_conversation_trie": conversation_trie,
    "op13_tokenizer_alignment": tokenizer_alignment,
}

WS = r"[\x20\x09-\x0D]"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SHINGLE_LINKS = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.to_id FROM reached r
  JOIN (SELECT a AS from_id, b AS to_id FROM links UNION ALL SELECT b, a FROM links) l ON l.from_id = r.b),
named AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN named USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def windows_sql(end: str, replaced: str, least_words: int, least_parts: int, lowered: bool, words: str) -> str:
    """Texts without the parts of windows of parts that stand earlier too: all windows, and no more than they need."""
    text = ASCII_LOWER.format("part") if lowered else "part"
    return f"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '{end}', '{replaced}', 'g'), chr(1)) AS parts FROM documents),
parts AS (
  SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM cut),
filled AS (
  SELECT *, regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+') AS w FROM parts),
units AS (
  SELECT doc_id, pos, array_to_string(w, ' ') AS body, len(w) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i
  FROM filled WHERE len(w) > 0),
sums AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto, count(*) OVER (PARTITION BY doc_id) AS n_units FROM units),
spans AS (
  SELECT a.doc_id, a.i AS first, b.i AS last FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.i >= a.i + {least_parts - 1}
    AND b.i < a.i + {least_words + least_parts}
  WHERE b.upto - a.upto + a.n >= {least_words}
    AND (b.i = a.i + {least_parts - 1} OR b.upto - b.n - a.upto + a.n < {least_words} OR b.upto - a.upto < {least_words})),
bodies AS (
  SELECT s.doc_id, s.first, s.last, string_agg(u.body, chr(10) ORDER BY u.i) AS body
  FROM spans s JOIN units u ON u.doc_id = s.doc_id AND u.i BETWEEN s.first AND s.last GROUP BY ALL),
marked AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS copy FROM bodies),
gone AS (
  SELECT DISTINCT u.doc_id, u.pos FROM marked m JOIN units u ON u.doc_id = m.doc_id AND u.i BETWEEN m.first AND m.last WHERE copy > 1),
rest AS (
  SELECT p.doc_id, string_agg(p.part, '' ORDER BY p.pos) AS text FROM parts p
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.pos = p.pos) GROUP BY p.doc_id)
SELECT d.doc_id, CASE WHEN k.n IS NULL THEN d.text ELSE coalesce(r.text, '') END AS text,
  coalesce((SELECT count(*) FROM units u WHERE u.doc_id = d.doc_id), 0) AS {words}, coalesce(k.n, 0) AS n_removed
FROM documents d LEFT JOIN rest r USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) k USING (doc_id)
"""


MIXED = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, [1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, {MAX_REPEATS} * source_size AS most
  FROM totals),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY most / weight, source) AS k, sum(most) OVER (ORDER BY most / weight, source) - most AS cut,
    sum(weight) OVER (ORDER BY most / weight DESC, source DESC) AS open, sum(source_size) OVER () AS total FROM ranked),
level AS (
  SELECT (total - cut)::BIGINT / open::BIGINT AS value FROM ordered WHERE (total - cut) / open <= most / weight ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size, least(most::DOUBLE, weight * (SELECT value FROM level)) AS target FROM ranked),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, md5(doc_id::VARCHAR), doc_id) AS rn FROM sized),
rated AS (
  SELECT doc_id, size, source_size, target, rn, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, (floor(rn * rate + {OFFSET}::DOUBLE) - floor((rn - 1) * rate + {OFFSET}::DOUBLE))::INT AS copies FROM rated)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM counted
"""

NEAR_VECTORS = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""

TRIE = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)),
    lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384::BIGINT, a >> 1) ELSE a >> 1 END)) AS t),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc),
grown AS (
  SELECT c.conv_id, 0 AS part, pos, role, text FROM convs c JOIN turns b ON b.conv_id = c.conv_id - c.conv_id % 5 AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM convs c JOIN turns USING (conv_id) WHERE pos > h),
paths AS (
  SELECT conv_id, coalesce(list({'r': role, 't': text} ORDER BY part, pos) FILTER (part IS NOT NULL), []) AS path
  FROM convs LEFT JOIN grown USING (conv_id) GROUP BY conv_id),
beginnings AS (
  SELECT conv_id, len(path) AS n, d AS depth, path[1:d] AS beginning FROM paths, unnest(range(len(path) + 1)) AS depths(d)),
nodes AS (
  SELECT depth, beginning, CASE WHEN depth > 0 THEN beginning[1:depth - 1] END AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * CASE WHEN depth > 0 THEN strlen(beginning[depth].t) ELSE 0 END AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM beginnings GROUP BY depth, beginning),
kids AS (SELECT depth - 1 AS depth, parent AS beginning, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (depth, beginning)),
below AS (
  SELECT d AS depth, beginning[1:d] AS beginning, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens
  FROM counted, unnest(range(counted.depth + 1)) AS depths(d) GROUP BY ALL)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
FROM counted c JOIN below b ON b.depth = c.depth AND b.beginning = c.beginning
LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.beginning = c.parent
"""

ORACLES = {
    "op3_minmax_near_dedup": SHINGLE_LINKS,
    "op4_line_dedup": windows_sql(r"\n", r"\0" + "\x01", LINE_WORDS, 1, False, "n_lines"),
    "op6_embedding_near_dedup": NEAR_VECTORS,
    "op7_substring_dedup": windows_sql(rf"[.!?]{WS}+|\n{WS}*", r"\0" + "\x01", SPAN_WORDS, LEAST_SENTENCES, True, "n_sentences"),
    "op8_source_mixing": MIXED,
    "op9_license_scans": scan_sql(),
    "op12_conversation_trie": TRIE,
}
