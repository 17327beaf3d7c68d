"""Statute and index pages rendered from orders and lineitem, so that every expected row follows from the tables."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.params import SITE_HOST
from lexloom.sources.tables import table

ORDERS_PER_INDEX_PAGE = 50
PAGES_PER_PARTITION = 50_000
VARIANTS = 97
INDEX_VARIANTS = 11

GOOD_SUBD = (
    '<div class="subd"><h2 class="subd_no">Subdivision 1.<span class="headnote">Kept.</span></h2><p>Kept text.</p></div>'
)
# o_orderkey % 97 to the markup inside the section (or, for the first, instead of it).
BROKEN_SECTIONS = {
    2: "<p>No heading here.</p>",
    3: "<p>42.1 [Repealed, 2001 c 1 s 1]</p>",
    6: '<h1 class="shn">{cite} EMPTY SECTION.</h1>',
    7: '<h1 class="shn">{cite} BAD.</h1>' + GOOD_SUBD + '<div class="subd"><p>No header.</p></div>',
    8: '<h1 class="shn">{cite} BAD.</h1>'
    + GOOD_SUBD
    + '<div class="subd"><h2 class="subd_no">Part 1.<span class="headnote">Head.</span></h2><p>x</p></div>',
    9: '<h1 class="shn">{cite} BAD.</h1>'
    + GOOD_SUBD
    + '<div class="subd"><h2 class="subd_no">Subd. 2<span class="headnote">Head</span></h2><p>x</p></div>',
    10: '<h1 class="shn">{cite} BAD.</h1>'
    + GOOD_SUBD
    + '<div class="subd"><h2 class="subd_no">Subd. 2. MS 2000<span class="headnote">Head.</span></h2><p>x</p></div>',
    11: '<h1 class="shn">{cite} BAD.</h1>'
    + GOOD_SUBD
    + '<div class="subd"><h2 class="subd_no">Subd. 2.<span class="headnote">Head.</span></h2><ul><li>x</ul></div>',
    12: '<h1 class="shn">{cite} BAD.</h1>'
    + GOOD_SUBD
    + '<div class="subd"><h2 class="subd_no">Subd. 2.<span class="headnote">Head.</span></h2><table></table></div>',
    13: '<h1 class="shn">{cite} BAD.</h1>'
    + GOOD_SUBD
    + '<div class="subd"><h2 class="subd_no">Subd. 2.<span class="headnote">H.</span></h2><table><tbody></tbody></table></div>',
    14: '<h1 class="shn">{cite} BAD.</h1>'
    + GOOD_SUBD
    + '<div class="subd"><h2 class="subd_no">Subd. 2.<span class="headnote"> </span></h2><p>x</p></div>',
}


def filled(template: str, *values: Column | str) -> Column:
    """As format_string of %d and %s, put together by concat, which takes a fraction of the time."""
    texts = re.split("%[ds]", template)
    given = [F.coalesce((F.col(value) if isinstance(value, str) else value).cast("string"), F.lit("null")) for value in values]
    pieces = [F.lit(texts[0]), *chain.from_iterable(zip(given, map(F.lit, texts[1:]), strict=True))]
    return F.concat(*pieces)


def subdivision_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (order, line); combined before the shuffle, so copies of one line number add nothing to a group."""
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_partkey").alias("part"), F.char(F.max(F.ascii("l_returnflag"))).alias("flag"))
    )


def section_pages(spark: SparkSession, folder: str) -> DataFrame:
    partitions = page_partitions(spark, folder)
    line, part, flag, key = F.col("l_linenumber"), F.col("part"), F.col("flag"), F.col("l_orderkey")
    prefix = F.when(line == 1, "Subdivision ").when(part % 5 == 0, "Subd ").otherwise("Subd. ")
    number = F.concat(line.cast("string"), F.when(part % 7 == 0, "a").otherwise(""))
    repealed = (flag == "R") & (part % 3 == 0)
    note = F.when(repealed, "[Repealed]").otherwise(
        filled('<span class="headnote"> Part %d &lt;%s&gt; goods. </span>', part, flag)
    )
    listing = F.concat(
        F.when(part % 8 == 0, "<table><tbody>").otherwise("<table>"),
        filled(
            "<tr><th>Head</th></tr><tr><td>Part</td><td> $1,%d </td></tr><tr><td>Flag</td><td>%s</td></tr></table>",
            part,
            flag,
        ),
    )
    paragraph = F.concat(
        filled("<p>Line %d of order %d is flagged &quot;%s&quot;.", line, key, flag),
        F.when(part % 6 == 5, "\n").otherwise(""),
        F.when(part % 6 == 1, "").otherwise("</p>"),
        F.lit("<p>lost tail</p>"),
    )
    div = F.concat(
        F.lit('<div class="subd"><h2 class="subd_no">'),
        prefix,
        number,
        F.lit("."),
        note,
        F.lit("</h2>"),
        F.when(part % 4 == 0, listing).otherwise(paragraph),
        F.lit("</div>\n"),
    )
    # Line numbers run from 1 to 7 in an order, so a page stays small whatever the number of rows of the order.
    bodies = (
        subdivision_rows(spark, folder)
        .repartition(partitions, "l_orderkey")
        .select(key, line, div.alias("div"))
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "div"))).alias("divs"))
        .select("l_orderkey", F.array_join("divs.div", "").alias("subds"))
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    orders = orders.repartition(partitions, "o_orderkey")
    # Both sides lie by order key in the same number of partitions, so that this join moves nothing.
    joined = orders.join(bodies.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    variant = F.col("o_orderkey") % VARIANTS
    cite = section_cite()
    heading = (
        F.when(variant == 4, cite)
        .when(variant == 5, filled("%d RULES &amp; CO.", "o_orderkey"))
        .otherwise(F.concat(cite, F.lit(" "), F.upper("o_orderpriority"), F.lit(" RULES &amp; CO.")))
    )
    body = F.coalesce(
        "subds", filled("<p>Whole text of order %d, status %s.</p>", "o_orderkey", "o_orderstatus")
    )
    inner = F.concat(F.lit('<h1 class="shn">'), heading, F.lit("</h1>\n"), body)
    for value, markup in BROKEN_SECTIONS.items():
        inner = F.when(variant == value, F.replace(F.lit(markup), F.lit("{cite}"), cite)).otherwise(inner)
    kind = F.when(variant == 1, "other").otherwise("section")
    page = F.concat(
        F.lit('<!DOCTYPE html><html><body><!-- page --><div class="'), kind, F.lit('">'), inner, F.lit("</div></body></html>")
    )
    return joined.select(section_url().alias("url"), page.alias("html"))


def page_partitions(spark: SparkSession, folder: str) -> int:
    """Partitions of about 50,000 pages, but all cores, since pages are small to move and costly to parse."""
    pages = table(spark, folder, "orders").count()
    return max(spark.sparkContext.defaultParallelism, pages // PAGES_PER_PARTITION)


def section_cite():
    return filled("%d.%d", F.col("o_orderkey") % 100, "o_orderkey")


def section_url():
    return F.concat(F.lit(f"https://{SITE_HOST}/statutes/cite/"), section_cite())


def index_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Index pages of 50 order keys each, the kind and the defect turning with the page number.

    Page p also lists the pages 2p+5 and 2p+6, whether or not they exist.
    """
    key = F.col("o_orderkey")
    path = filled("/statutes/cite/%d.%d", key % 100, key)
    href = (
        F.when(key % 3 == 0, F.concat(F.lit(f"//{SITE_HOST}"), path))
        .when(key % 3 == 1, path)
        .otherwise(F.concat(F.lit(f"https://{SITE_HOST}"), path))
    )
    row = F.when(
        F.col("o_orderstatus") == "P",
        filled("<tr><td>%d</td><td>Repealed %s</td></tr>", key, "o_orderpriority"),
    ).otherwise(
        filled(
            '<tr><td><a href="%s">%d</a></td><td> %s A&amp;B </td>%s</tr>',
            href,
            key,
            F.upper("o_orderpriority"),
            F.when(key % 7 == 0, "<td>more</td>").otherwise(""),
        )
    )
    grouped = (
        table(spark, folder, "orders")
        .select(F.floor(key / ORDERS_PER_INDEX_PAGE).alias("page"), key, row.alias("row"))
        .repartition(page_partitions(spark, folder), "page")
        .groupBy("page")
        .agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "row"))).alias("rows"))
        .select("page", F.array_join("rows.row", "").alias("rows"))
    )
    page = F.col("page")
    variant = page % INDEX_VARIANTS
    sub = filled('<tr class="sub"><td>Part %d</td></tr>', page)
    further = F.concat(
        *[
            filled('<tr><td><a href="/statutes/part/%d">more</a></td><td>PART %d</td></tr>', n, n)
            for n in (2 * page + 5, 2 * page + 6)
        ]
    )
    tail = F.when(variant == 3, "<tr><td>lonely</td></tr>").when(
        variant == 4, "<tr><td>plain</td><td>CAPS ONLY</td></tr>"
    )
    rows = F.when(variant == 2, "").otherwise(F.concat(sub, F.col("rows"), further, F.coalesce(tail, F.lit(""))))
    html = (
        F.when(
            variant == 1, F.concat(F.lit('<div><h2>Index</h2><table id="toc_table">'), rows, F.lit("</table></div>"))
        )
        .when(
            page % 3 == 0,
            F.concat(
                F.lit('<div><h2>Table of Chapters</h2><table id="toc_table"><tbody>'), rows, F.lit("</tbody></table></div>")
            ),
        )
        .when(
            page % 3 == 1,
            F.concat(
                filled('<div><h2> Table of Chapters, %d - %dA </h2><table id="chapters_table">', page, page),
                rows,
                F.lit("</table></div>"),
            ),
        )
        .otherwise(
            F.concat(
                filled('<h2 class="chapter_title">CHAPTER %d</h2><div id="chapter_analysis"><table>', page),
                rows,
                F.lit("</table></div>"),
            )
        )
    )
    return grouped.select(
        F.concat(F.lit(f"https://{SITE_HOST}/statutes/part/"), page.cast("string")).alias("url"), html.alias("html")
    )


def rendered_pages(spark: SparkSession, folder: str) -> DataFrame:
    return section_pages(spark, folder).unionByName(index_pages(spark, folder))
