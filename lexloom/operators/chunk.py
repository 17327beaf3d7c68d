"""Statutes and plain documents to citation-prefixed chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_id(chapter: Column, section: Column, number: Column) -> Column:
    return F.concat(chapter, F.lit("."), section, F.when(number != "", F.concat(F.lit("."), number)).otherwise(""))


def chunk_body(
    chapter: Column, section: Column, title: Column, number: Column, heading: Column, content: Column
) -> Column:
    return F.concat(
        F.lit("§ "),
        chapter,
        F.lit("."),
        section,
        F.when(number != "", F.concat(F.lit(", subd. "), number)).otherwise(""),
        F.lit(": "),
        title,
        F.when(heading != "", F.concat(F.lit(" -- "), heading)).otherwise(""),
        F.lit("\n"),
        content,
        F.when(content.endswith("\n"), "").otherwise("\n"),
    )


def statute_chunks(scraped: DataFrame) -> DataFrame:
    """(url, pos, id, body) for every subdivision of every good statute page."""
    rows = scraped.filter(F.col("outcome") == "statute").select(
        "url", "statute", F.posexplode("statute.subdivisions").alias("pos", "sub")
    )
    cite = (F.col("statute.chapter"), F.col("statute.section"))
    sub = F.col("sub")
    return rows.select(
        "url",
        "pos",
        chunk_id(*cite, sub["number"]).alias("id"),
        chunk_body(*cite, F.col("statute.title"), sub["number"], sub["heading"], sub["content"]).alias("body"),
    )


def document_chunks(documents: DataFrame) -> DataFrame:
    """(doc_id, id, body): a document is a statute (language.doc_id, titled by source), a non-empty line a subdivision."""
    lines = documents.select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    ).filter(F.col("line") != "")
    cite = (F.col("lang"), F.col("doc_id").cast("string"))
    number = (F.col("pos") + 1).cast("string")
    return lines.select(
        "doc_id",
        chunk_id(*cite, number).alias("id"),
        chunk_body(*cite, F.col("source"), number, F.lit(""), F.col("line")).alias("body"),
    )
