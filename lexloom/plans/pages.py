"""Queries over rendered statute and index pages, and over the given web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions.text import chunk_id_of_key, chunk_object_key, resolve_href
from lexloom.operators import extract as ex
from lexloom.operators.chunk import statute_chunks
from lexloom.params import KIND_STATUTE
from lexloom.sources.rendered import rendered_pages
from lexloom.sources.tables import wide_table

# The rows the rendered pages were made from, as SQL over the tables.
RENDERED = """
WITH sec AS (
  SELECT o_orderkey AS k, o_orderkey % 97 AS v, CAST(o_orderkey % 100 AS VARCHAR) AS chapter,
         CAST(o_orderkey AS VARCHAR) AS section, upper(o_orderpriority) || ' RULES & CO.' AS title, o_orderstatus AS st,
         'https://www.revisor.mn.gov/statutes/cite/' || (o_orderkey % 100) || '.' || o_orderkey AS url
  FROM orders
), lines AS (
  SELECT l_orderkey AS k, l_linenumber AS ln, min(l_partkey) AS pk, max(l_returnflag) AS rf FROM lineitem GROUP BY 1, 2
), plain AS (
  SELECT sec.*, ln, pk, rf, row_number() OVER (PARTITION BY k ORDER BY ln) - 1 AS pos,
         CASE WHEN ln = 1 THEN 'Subdivision ' WHEN pk % 5 = 0 THEN 'Subd ' ELSE 'Subd. ' END AS prefix,
         ln || CASE WHEN pk % 7 = 0 THEN 'a' ELSE '' END AS number,
         'Part ' || pk || ' <' || rf || '> goods.' AS heading,
         NOT (rf = 'R' AND pk % 3 = 0) AS live,
         CASE WHEN pk % 4 = 0 THEN chr(10) || 'Part,$1,' || pk || chr(10) || 'Flag,' || rf || chr(10) END AS csv,
         'Line ' || ln || ' of order ' || k || ' is flagged "' || rf || '".'
           || CASE WHEN pk % 6 = 5 THEN chr(10) ELSE '' END AS para
  FROM sec JOIN lines USING (k) WHERE v NOT IN (1, 2, 3) AND v NOT BETWEEN 6 AND 14
), broken(v, pos, header, headnote, number, heading, content, live, code, csv) AS (VALUES
  (7, 1, NULL, NULL, NULL, NULL, 'No header.', false, 'no_subd_header', NULL),
  (8, 1, 'Part 1.Head.', 'Head.', NULL, NULL, 'x', true, 'bad_subd_prefix', NULL),
  (9, 1, 'Subd. 2Head', 'Head', '2Head', NULL, 'x', true, 'bad_subd_number', NULL),
  (10, 1, 'Subd. 2. MS 2000Head.', 'Head.', '2', 'MS 2000Head.', 'x', true, 'heading_mismatch', NULL),
  (11, 1, 'Subd. 2.Head.', 'Head.', '2', 'Head.', NULL, true, 'no_subd_body', NULL),
  (12, 1, 'Subd. 2.Head.', 'Head.', '2', 'Head.', NULL, true, 'no_table_body', NULL),
  (13, 1, 'Subd. 2.H.', 'H.', '2', 'H.', '', true, 'empty_table', ''),
  (14, 1, 'Subd. 2. ', '', '2', '', 'x', true, 'empty_heading', NULL)
), parts AS (
  SELECT url, v, pos, prefix || number || CASE WHEN live THEN '. ' || heading || ' ' ELSE '.[Repealed]' END AS header,
         CASE WHEN live THEN heading END AS headnote, number, heading, coalesce(csv, para) AS content, live,
         CAST(NULL AS VARCHAR) AS code, csv
  FROM plain
  UNION ALL SELECT url, v, 0, 'Subdivision 1.Kept.', 'Kept.', '1', 'Kept.', 'Kept text.', true, NULL, NULL
  FROM sec WHERE v BETWEEN 7 AND 14
  UNION ALL SELECT url, v, b.pos, b.header, b.headnote, b.number, b.heading, b.content, b.live, b.code, b.csv
  FROM sec JOIN broken b USING (v)
), outcomes AS (
  SELECT url, v, CASE WHEN v = 1 THEN -1 ELSE 4 END AS page_kind,
         CASE WHEN v = 3 THEN 'repealed' WHEN v BETWEEN 1 AND 14 THEN 'error' ELSE 'statute' END AS outcome,
         CASE v WHEN 1 THEN 'unknown_kind' WHEN 2 THEN 'no_title' WHEN 4 THEN 'malformed_title'
                WHEN 5 THEN 'malformed_title' WHEN 6 THEN 'no_body' WHEN 7 THEN 'no_subd_header'
                WHEN 8 THEN 'bad_subd_prefix' WHEN 9 THEN 'bad_subd_number' WHEN 10 THEN 'heading_mismatch'
                WHEN 11 THEN 'no_subd_body' WHEN 12 THEN 'no_table_body' WHEN 13 THEN 'empty_table'
                WHEN 14 THEN 'empty_heading' END AS error_code
  FROM sec
), whole AS (
  SELECT url, chapter, section, title, 'Whole text of order ' || k || ', status ' || st || '.' AS content
  FROM sec WHERE v NOT BETWEEN 1 AND 14 AND k NOT IN (SELECT k FROM lines)
), subds AS (
  SELECT url, chapter, section, title, row_number() OVER (PARTITION BY url ORDER BY ln) - 1 AS pos, number, heading,
         coalesce(csv, para) AS content
  FROM plain WHERE live AND v NOT IN (4, 5)
  UNION ALL SELECT url, chapter, section, title, 0, '', '', content FROM whole
), chunks AS (
  SELECT url, pos, chapter || '.' || section || CASE WHEN number <> '' THEN '.' || number ELSE '' END AS id,
         '§ ' || chapter || '.' || section || CASE WHEN number <> '' THEN ', subd. ' || number ELSE '' END || ': '
           || title || CASE WHEN heading <> '' THEN ' -- ' || heading ELSE '' END || chr(10) || content
           || CASE WHEN content LIKE '%' || chr(10) THEN '' ELSE chr(10) END AS body
  FROM subds
), idx AS (
  SELECT o_orderkey AS k, o_orderkey // 50 AS page, o_orderstatus AS st, o_orderpriority AS pr,
         CASE WHEN o_orderstatus = 'P' THEN ''
              WHEN o_orderkey % 3 = 0 THEN '//www.revisor.mn.gov/statutes/cite/' || (o_orderkey % 100) || '.' || o_orderkey
              WHEN o_orderkey % 3 = 1 THEN '/statutes/cite/' || (o_orderkey % 100) || '.' || o_orderkey
              ELSE 'https://www.revisor.mn.gov/statutes/cite/' || (o_orderkey % 100) || '.' || o_orderkey END AS href
  FROM orders
), index_pages AS (
  SELECT DISTINCT page, page % 11 AS w, CASE WHEN page % 11 = 1 THEN -1 ELSE 1 + page % 3 END AS page_kind,
         'https://www.revisor.mn.gov/statutes/part/' || page AS url
  FROM idx
), listed AS (
  SELECT page, k AS ord, CASE WHEN st = 'P' THEN 'Repealed ' || pr ELSE upper(pr) || ' A&B' END AS title, href,
         CASE WHEN st <> 'P' AND k % 7 = 0 THEN 3 ELSE 2 END AS n_td, st <> 'P' AS valid,
         CASE WHEN st = 'P' THEN NULL ELSE 'https://www.revisor.mn.gov/statutes/cite/' || (k % 100) || '.' || k END AS link
  FROM idx
  UNION ALL SELECT page, 8000000000000000 + more, 'PART ' || (2 * page + more), '/statutes/part/' || (2 * page + more), 2, true,
    'https://www.revisor.mn.gov/statutes/part/' || (2 * page + more) FROM index_pages, (VALUES (5), (6)) AS m(more)
  UNION ALL SELECT page, -1, NULL, '', 1, false, NULL FROM index_pages
  UNION ALL SELECT page, 9000000000000000, NULL, '', 1, false, NULL FROM index_pages WHERE w = 3
  UNION ALL SELECT page, 9000000000000000, 'CAPS ONLY', '', 2, true, '' FROM index_pages WHERE w = 4
), toc AS (
  SELECT url, page_kind, w, row_number() OVER (PARTITION BY page ORDER BY ord) - 1 AS pos, title, href, n_td, valid, link
  FROM listed JOIN index_pages USING (page) WHERE w NOT IN (1, 2)
), links AS (
  SELECT url, row_number() OVER (PARTITION BY url ORDER BY pos) - 1 AS pos, link
  FROM toc WHERE valid AND w NOT IN (3, 4)
), all_pages AS (
  SELECT url, page_kind, outcome, error_code FROM outcomes
  UNION ALL
  SELECT url, page_kind, CASE WHEN w BETWEEN 1 AND 4 THEN 'error' ELSE 'links' END,
         CASE w WHEN 1 THEN 'unknown_toc_heading' WHEN 2 THEN 'no_toc_rows' WHEN 3 THEN 'bad_toc_row'
                WHEN 4 THEN 'no_href' END
  FROM index_pages
)
"""

PAGE_LINKS = """
WITH page_links AS (
  SELECT url, unnest(range(len(found))) AS pos, unnest(found) AS href
  FROM (SELECT url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS found FROM pages)
)
"""


def _statutes(spark, sf):
    marked = ex.statute_pages(rendered_pages(spark, sf), ex.STATUTE_MARKERS)
    return marked.filter(F.col("page_kind") == KIND_STATUTE)


def _parts(spark, sf):
    marked = ex.checked_subdivisions(_statutes(spark, sf))
    zipped = F.arrays_zip("headers", "parts", "subds")
    return marked.select("url", F.posexplode(zipped).alias("pos", "sub")).select(
        "url", "pos", "sub.headers.header", "sub.headers.headnote", "sub.parts.*", "sub.subds.paragraph", "sub.subds.cells"
    )


def _rows(spark, sf):
    marked = ex.checked_rows(ex.statute_pages(rendered_pages(spark, sf), ex.ROW_MARKERS))
    return marked.filter("page_kind in (1, 2, 3)").select("url", F.posexplode("rows").alias("pos", "row")).select(
        "url", "pos", "row.*"
    )


def _scraped(spark, sf):
    return ex.scrape(rendered_pages(spark, sf))


def page_kind(spark, sf):
    marked = ex.statute_pages(rendered_pages(spark, sf), {})
    return marked.select(
        "url", "page_kind", ex.kind_name(F.col("page_kind")).alias("page_kind_name"), F.col("kind_error").alias("error_code")
    )


def toc_rows(spark, sf):
    return _rows(spark, sf).select("url", "pos", "title", "href", "n_td")


def toc_valid_rows(spark, sf):
    return _rows(spark, sf).filter("valid").select("url", "pos", "title")


def href_resolve(spark, sf):
    links = ex.page_links(wide_table(spark, sf, "pages", "url")).select(
        "url", "pos", "href", resolve_href(F.col("href")).alias("link")
    )
    return _rows(spark, sf).filter("valid").select("url", "pos", "href", "link").unionByName(links)


def link_fanout(spark, sf):
    return ex.frontier_links(_scraped(spark, sf))


def statute_header(spark, sf):
    return (
        ex.with_header(_statutes(spark, sf))
        .filter(F.col("h1").isNotNull())
        .select("url", "h1", "chapter", "section", "title")
    )


def statute_outcome(spark, sf):
    return _scraped(spark, sf).filter(F.col("page_kind") == KIND_STATUTE).select("url", "outcome", "error_code")


def statute_no_subd(spark, sf):
    only = F.get("statute.subdivisions", F.lit(0))
    return (
        _scraped(spark, sf)
        .filter((F.col("outcome") == "statute") & (only["number"] == ""))
        .select("url", only["number"].alias("number"), only["heading"].alias("heading"), only["content"].alias("content"))
    )


def subdivisions(spark, sf):
    return _parts(spark, sf).select("url", "pos", "header")


def subd_live(spark, sf):
    return _parts(spark, sf).filter("live").select("url", "pos", "headnote")


def subd_number_heading(spark, sf):
    return _parts(spark, sf).filter("live").select("url", "pos", "number", "heading")


def subd_checks(spark, sf):
    return _parts(spark, sf).select("url", "pos", "live", "code")


def subd_body(spark, sf):
    return _parts(spark, sf).filter("live").select("url", "pos", "content")


def table_to_csv(spark, sf):
    tables = _parts(spark, sf).filter("paragraph is null and cells is not null")
    return tables.select("url", "pos", ex.table_text(F.col("cells")).alias("csv"))


def page_text(spark, sf):
    return ex.page_outline(wide_table(spark, sf, "pages", "url"), ("h1",)).select("url", F.col("h1").alias("heading_text"))


def scrape_route(spark, sf):
    return _scraped(spark, sf).select(
        "url",
        "page_kind",
        "outcome",
        F.coalesce(F.size("links"), F.lit(0)).alias("n_links"),
        F.coalesce(F.size("statute.subdivisions"), F.lit(0)).alias("n_chunks"),
    )


def scrape_quarantine(spark, sf):
    return ex.quarantine(_scraped(spark, sf))


def page_links(spark, sf):
    return ex.page_links(wide_table(spark, sf, "pages", "url"))


def page_paragraph_count(spark, sf):
    return ex.page_outline(wide_table(spark, sf, "pages", "url"), ("paragraphs",)).select("url", F.size("paragraphs").alias("n_paragraphs"))


def chunk_id(spark, sf):
    return statute_chunks(_scraped(spark, sf)).select("url", "pos", "id")


def chunk_body(spark, sf):
    return statute_chunks(_scraped(spark, sf)).select("id", "body")


def all_statute_chunks(spark, sf):
    return statute_chunks(_scraped(spark, sf))


def chunk_stats(spark, sf):
    """Pages and chunks per outcome and chapter, from one pass."""
    chapter = F.coalesce("statute.chapter", F.lit(""))
    return (
        _scraped(spark, sf)
        .groupBy("outcome", chapter.alias("chapter"))
        .agg(
            F.count(F.lit(1)).alias("n_pages"),
            F.sum(F.coalesce(F.size("statute.subdivisions"), F.lit(0))).alias("n_chunks"),
        )
    )


def chunk_key_to_id(spark, sf):
    keys = statute_chunks(_scraped(spark, sf)).select("url", "pos", chunk_object_key(F.col("id")).alias("object_key"))
    return keys.withColumn("chunk_id", chunk_id_of_key(F.col("object_key")))


QUERIES = {
    "page_kind": page_kind,
    "toc_rows": toc_rows,
    "toc_valid_rows": toc_valid_rows,
    "href_resolve": href_resolve,
    "link_fanout": link_fanout,
    "statute_header": statute_header,
    "statute_outcome": statute_outcome,
    "statute_no_subd": statute_no_subd,
    "subdivisions": subdivisions,
    "subd_live": subd_live,
    "subd_number_heading": subd_number_heading,
    "subd_checks": subd_checks,
    "subd_body": subd_body,
    "table_to_csv": table_to_csv,
    "page_text": page_text,
    "scrape_route": scrape_route,
    "scrape_quarantine": scrape_quarantine,
    "page_links": page_links,
    "page_paragraph_count": page_paragraph_count,
    "chunk_id": chunk_id,
    "chunk_body": chunk_body,
    "statute_chunks": all_statute_chunks,
    "chunk_stats": chunk_stats,
    "chunk_key_to_id": chunk_key_to_id,
}

ORACLES = {
    "page_kind": RENDERED
    + """SELECT url, page_kind, CASE page_kind WHEN -1 THEN 'error' WHEN 1 THEN 'chapters_table'
         WHEN 2 THEN 'chapters_short_table' WHEN 3 THEN 'sections_table' ELSE 'statute' END AS page_kind_name,
         CASE WHEN page_kind = -1 THEN error_code END AS error_code FROM all_pages""",
    "toc_rows": RENDERED + "SELECT url, pos, title, href, n_td FROM toc",
    "toc_valid_rows": RENDERED + "SELECT url, pos, title FROM toc WHERE valid",
    "href_resolve": RENDERED
    + """, page_links AS (
      SELECT url, unnest(range(len(found))) AS pos, unnest(found) AS href
      FROM (SELECT url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS found FROM pages))
    SELECT url, pos, href, link FROM toc WHERE valid
    UNION ALL SELECT url, pos, href, CASE WHEN href LIKE '//www.revisor.mn.gov%' THEN 'https:' || href
      WHEN href LIKE '/statutes%' THEN 'https://www.revisor.mn.gov' || href ELSE href END FROM page_links""",
    "link_fanout": RENDERED + "SELECT url, pos, link FROM links",
    "statute_header": RENDERED
    + """, h AS (SELECT url, v, chapter, section, chapter || '.' || section AS cite,
      CASE WHEN v = 6 THEN 'EMPTY SECTION.' WHEN v BETWEEN 7 AND 14 THEN 'BAD.' ELSE title END AS title
      FROM sec WHERE v NOT IN (1, 2, 3))
    SELECT url, CASE v WHEN 4 THEN cite WHEN 5 THEN section || ' RULES & CO.' ELSE cite || ' ' || title END AS h1,
      CASE WHEN v = 5 THEN section ELSE chapter END AS chapter, CASE WHEN v = 5 THEN NULL ELSE section END AS section,
      CASE WHEN v = 4 THEN NULL WHEN v = 5 THEN 'RULES & CO.' ELSE title END AS title FROM h""",
    "statute_outcome": RENDERED + "SELECT url, outcome, error_code FROM outcomes WHERE page_kind = 4",
    "statute_no_subd": RENDERED + "SELECT url, '' AS number, '' AS heading, content FROM whole",
    "subdivisions": RENDERED + "SELECT url, pos, header FROM parts",
    "subd_live": RENDERED + "SELECT url, pos, headnote FROM parts WHERE live",
    "subd_number_heading": RENDERED + "SELECT url, pos, number, heading FROM parts WHERE live",
    "subd_checks": RENDERED + "SELECT url, pos, live, code FROM parts",
    "subd_body": RENDERED + "SELECT url, pos, content FROM parts WHERE live",
    "table_to_csv": RENDERED + "SELECT url, pos, csv FROM parts WHERE csv IS NOT NULL",
    "page_text": """SELECT url, replace(replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS heading_text FROM pages""",
    "scrape_route": RENDERED
    + """SELECT p.url, page_kind, outcome, coalesce(l.n, 0) AS n_links, coalesce(c.n, 0) AS n_chunks FROM all_pages p
      LEFT JOIN (SELECT url, count(*) AS n FROM links GROUP BY 1) l USING (url)
      LEFT JOIN (SELECT url, count(*) AS n FROM chunks GROUP BY 1) c USING (url)""",
    "scrape_quarantine": RENDERED + "SELECT url, page_kind, error_code FROM all_pages WHERE outcome = 'error'",
    "page_links": PAGE_LINKS + "SELECT url, pos, href FROM page_links",
    "page_paragraph_count": """SELECT url, CAST((length(html) - length(replace(html, '<p>', ''))) / 3 AS BIGINT)
      AS n_paragraphs FROM pages""",
    "chunk_id": RENDERED + "SELECT url, pos, id FROM chunks",
    "chunk_body": RENDERED + "SELECT id, body FROM chunks",
    "statute_chunks": RENDERED + "SELECT url, pos, id, body FROM chunks",
    "chunk_stats": RENDERED
    + """, per_page AS (SELECT url, count(*) AS n FROM chunks GROUP BY 1)
    SELECT outcome, CASE WHEN outcome = 'statute' THEN chapter ELSE '' END AS chapter, count(*) AS n_pages,
      CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_chunks
    FROM all_pages LEFT JOIN sec USING (url) LEFT JOIN per_page USING (url) GROUP BY 1, 2""",
    "chunk_key_to_id": RENDERED
    + "SELECT url, pos, 'chunk/' || id || '.txt' AS object_key, id AS chunk_id FROM chunks",
}
