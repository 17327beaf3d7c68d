"""Page tables: one Arrow pass reads each page once and emits its markers; every rule after that is a column."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from lexloom.functions.markup import ATTRIBUTES, LAST, PARENT, Page
from lexloom.functions.text import after_prefix, is_all_caps, resolve_href, trim_space
from lexloom.params import (
    KIND_CHAPTERS,
    KIND_ERROR,
    KIND_NAMES,
    KIND_SECTIONS,
    KIND_SHORT_CHAPTERS,
    KIND_STATUTE,
    REPEALED_MARK,
    SHORT_TOC_HEADING_PREFIX,
    SITE_HOST,
    SUBDIVISION_PREFIXES,
    TOC_HEADING,
)
from lexloom.session import ship_package

TOC_ROW = pa.struct(
    [("table_kind", pa.int32()), ("class", pa.string()), ("n_td", pa.int32()), ("title", pa.string()), ("href", pa.string())]
)
SUBDIVISION_MARKS = pa.struct(
    [
        ("header", pa.string()),
        ("headnote", pa.string()),
        ("paragraph", pa.string()),
        ("has_table", pa.bool_()),
        ("cells", pa.list_(pa.list_(pa.string()))),
    ]
)
Emitter = Callable[[Page], dict]
Markers = dict[str, tuple[pa.DataType, Callable[[Page], object]]]


def _section(page: Page) -> int:
    return page.first_having("div", "class", "section")


def _in_section(page: Page, tag: str) -> str | None:
    section = _section(page)
    return page.text(page.first(tag, section)) if section >= 0 else None


def _subdivisions(page: Page) -> list[tuple]:
    section = _section(page)
    if section < 0:
        return []
    found = [page.by_tag.get(tag, ()) for tag in ("h2", "span", "table", "tbody", "p")]
    return [_subdivision_marks(page, div, *found) for div in page.having("div", "class", "subd", section)]


def _first_below(found: list[int], node: int, last: int) -> int:
    """The first of these elements that lies below an element whose last one is given; -1 if none."""
    at = bisect_right(found, node)
    return found[at] if at < len(found) and found[at] <= last else -1


def _links(page: Page) -> list[str]:
    links = (page.attribute(node, "href") for node in page.find("a"))
    return [link for link in links if link]


def _toc_heading(page: Page) -> int:
    with_table = {page.parent(node) for node in page.find("table")}
    tried = set()
    for node in page.find("h2") if with_table else ():
        parent = page.parent(node)
        if parent in with_table and parent not in tried:
            tried.add(parent)
            for other in page.find("h2"):
                if page.parent(other) == parent and page.attribute(other, "class") != "subd_no":
                    return other
    return -1


def _toc_rows(page: Page) -> list[tuple]:
    """In the order of TOC_ROW."""
    tables = [(KIND_CHAPTERS, t) for t in page.having("table", "id", "toc_table")]
    tables += [(KIND_SHORT_CHAPTERS, t) for t in page.having("table", "id", "chapters_table")]
    for div in page.having("div", "id", "chapter_analysis"):
        tables += [(KIND_SECTIONS, t) for t in page.children(div, "table")]
    rows = []
    for kind, table in tables:
        for body in page.children(table, "tbody"):
            for row in page.children(body, "tr"):
                cells = page.children(row, "td")
                anchors = page.children(cells[0], "a") if cells else []
                rows.append(
                    (
                        kind,
                        page.attribute(row, "class"),
                        len(cells),
                        page.text(cells[1]) if len(cells) > 1 else None,
                        page.attribute(anchors[0], "href") if anchors else "",
                    )
                )
    return rows


def _subdivision_marks(page: Page, div: int, headers: list, spans: list, tables: list, bodies: list, paragraphs: list) -> tuple:
    """In the order of SUBDIVISION_MARKS; with the elements of the page that may be in it."""
    nodes = page.nodes
    last = nodes[div][LAST]
    header, headnote, cells = _first_below(headers, div, last), None, None
    if header >= 0 and nodes[header][ATTRIBUTES].get("class") != "subd_no":
        header = page.first_having("h2", "class", "subd_no", div)
    if header >= 0:
        ends = nodes[header][LAST]
        for at in range(bisect_right(spans, header), len(spans)):
            note = spans[at]
            if note > ends:
                break
            if nodes[note][PARENT] == header and nodes[note][ATTRIBUTES].get("class") == "headnote":
                headnote = page.text(note)
                break
    table = _first_below(tables, div, last)
    body = _first_below(bodies, table, nodes[table][LAST]) if table >= 0 else -1
    if body >= 0:
        cells = [[page.text(cell) for cell in page.find("td", row)] for row in page.find("tr", body)]
    return page.text(header), headnote, page.text(_first_below(paragraphs, div, last)), table >= 0, cells


# What tells the kind of a page.
KIND_MARKERS: Markers = {
    "toc_heading": (pa.string(), lambda page: page.text(_toc_heading(page))),
    "has_chapter_title": (pa.bool_(), lambda page: page.first_having("h2", "class", "chapter_title") >= 0),
    "has_section": (pa.bool_(), lambda page: _section(page) >= 0),
}
# What the link rules look at.
ROW_MARKERS: Markers = {"toc_rows": (pa.list_(TOC_ROW), _toc_rows)}
# What the statute rules look at.
STATUTE_MARKERS: Markers = {
    "h1": (pa.string(), lambda page: _in_section(page, "h1")),
    "paragraph": (pa.string(), lambda page: _in_section(page, "p")),
    "subds": (pa.list_(SUBDIVISION_MARKS), _subdivisions),
}
OUTLINE_MARKERS: Markers = {
    "h1": (pa.string(), lambda page: page.text(page.first("h1"))),
    "links": (pa.list_(pa.string()), _links),
    "paragraphs": (pa.list_(pa.string()), lambda page: [page.text(node) for node in page.find("p")]),
}


def emitter(markers: Markers) -> tuple[Emitter, pa.Schema]:
    """What read_pages needs to emit these markers and no others; Spark cannot leave any out inside the Python stage."""
    functions = {name: function for name, (_, function) in markers.items()}
    schema = pa.schema([(name, kind) for name, (kind, _) in markers.items()])
    return lambda page: {name: function(page) for name, function in functions.items()}, schema


def column(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow column; lists are put together as their items, and structs, given as tuples, field by field."""
    if pa.types.is_list(kind):
        missing = np.array([value is None for value in values], bool)
        ends = np.cumsum([0 if value is None else len(value) for value in values])
        offsets = pa.array(np.r_[0, ends].astype(np.int32), mask=np.r_[missing, False]) if missing.any() else np.r_[0, ends].astype(np.int32)
        items = list(chain.from_iterable(value for value in values if value is not None))
        return pa.ListArray.from_arrays(offsets, column(items, kind.value_type), type=kind)
    if pa.types.is_struct(kind) and all(type(value) is tuple for value in values):
        fields = zip(*values, strict=True) if values else [()] * kind.num_fields
        return pa.StructArray.from_arrays([column(list(each), field.type) for each, field in zip(fields, kind, strict=True)], fields=list(kind))
    return pa.array(values, kind)


def read_pages(pages: DataFrame, emit: Emitter, markers: pa.Schema, rows_per_batch: int = 256) -> DataFrame:
    """(url, html) rows to (url, markers) rows; the plug point for another extractor is (emit, markers)."""
    ship_package(pages.sparkSession)
    schema = pa.schema([pa.field("url", pa.string()), *markers])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows_per_batch):
                part = batch.slice(start, rows_per_batch)
                rows = [emit(Page(source or "")) for source in part.column("html").to_pylist()]
                columns = [column([row[field.name] for row in rows], field.type) for field in markers]
                yield pa.RecordBatch.from_arrays([part.column("url").cast(pa.string()), *columns], schema=schema)

    return pages.select("url", "html").mapInArrow(run, from_arrow_schema(schema))


def page_outline(pages: DataFrame, wanted: tuple[str, ...] = tuple(OUTLINE_MARKERS)) -> DataFrame:
    """Any page: first heading, links in order, paragraphs in order, or some of these."""
    return read_pages(pages, *emitter({name: OUTLINE_MARKERS[name] for name in wanted}))


def page_links(pages: DataFrame) -> DataFrame:
    """(url, pos, href) for every link of every page."""
    return page_outline(pages, ("links",)).select("url", F.posexplode("links").alias("pos", "href"))


def statute_pages(pages: DataFrame, more: Markers | None = None) -> DataFrame:
    """The page kind and, where the kind is unknown, its error code; with the markers that are asked for, or all."""
    more = ROW_MARKERS | STATUTE_MARKERS if more is None else more
    marks = read_pages(pages, *emitter(KIND_MARKERS | more))
    heading = trim_space(F.col("toc_heading"))
    kind = (
        F.when(heading == TOC_HEADING, KIND_CHAPTERS)
        .when(heading.startswith(SHORT_TOC_HEADING_PREFIX), KIND_SHORT_CHAPTERS)
        .when(heading.isNotNull(), KIND_ERROR)
        .when(F.col("has_chapter_title"), KIND_SECTIONS)
        .when(F.col("has_section"), KIND_STATUTE)
        .otherwise(KIND_ERROR)
    )
    unknown = F.col("page_kind") == KIND_ERROR
    return marks.withColumn("page_kind", kind).withColumn(
        "kind_error",
        F.when(unknown & F.col("toc_heading").isNotNull(), "unknown_toc_heading").when(unknown, "unknown_kind"),
    )


def kind_name(kind: Column) -> Column:
    name = F.lit(None).cast("string")
    for value, text in KIND_NAMES.items():
        name = F.when(kind == value, text).otherwise(name)
    return name


def checked_rows(marked: DataFrame, host: str = SITE_HOST) -> DataFrame:
    """Adds `rows`: the index rows of the page's own kind with their verdict and resolved link."""

    def trimmed(row: Column) -> Column:
        return F.struct(trim_space(row["title"]).alias("title"), row["class"].alias("class"), row["n_td"].alias("n_td"), row["href"].alias("href"))

    def judged(row: Column) -> Column:
        valid = F.coalesce(is_all_caps(row["title"]), F.lit(False))
        return row.withField("valid", valid)

    def verdict(row: Column) -> Column:
        valid = row["valid"]
        code = F.when(row["title"].isNull() & (row["class"] == ""), "bad_toc_row").when(
            valid & (row["href"] == ""), "no_href"
        )
        return F.struct(
            row["title"].alias("title"),
            row["n_td"].alias("n_td"),
            row["href"].alias("href"),
            valid.alias("valid"),
            code.alias("code"),
            F.when(valid, resolve_href(row["href"], host)).alias("link"),
        )

    own = F.filter("toc_rows", lambda row: row["table_kind"] == F.col("page_kind"))
    # In steps, since what a lambda names twice is worked out twice.
    return marked.withColumn("rows", F.transform(F.transform(F.transform(own, trimmed), judged), verdict))


def checked_subdivisions(marked: DataFrame) -> DataFrame:
    """Adds `parts`: each subdivision with its number, heading, content, and the first check it fails."""

    def split_header(sub: Column) -> Column:
        header = sub["header"]
        rest = F.lit(None).cast("string")
        for prefix in reversed(SUBDIVISION_PREFIXES):
            rest = F.when(header.startswith(prefix), after_prefix(header, prefix)).otherwise(rest)
        return F.struct(
            sub["header"].alias("header"),
            trim_space(sub["headnote"]).alias("headnote"),
            rest.alias("rest"),
            F.coalesce(sub["paragraph"], table_text(sub["cells"])).alias("content"),
            (sub["paragraph"].isNull() & ~sub["has_table"]).alias("no_body"),
            (sub["paragraph"].isNull() & sub["cells"].isNull()).alias("no_rows"),
            F.coalesce(sub["paragraph"].isNull() & (F.size(sub["cells"]) == 0), F.lit(False)).alias("empty_table"),
        )

    def split_rest(sub: Column) -> Column:
        dot = F.instr(sub["rest"], ".")
        heading = F.when(dot > 0, trim_space(F.substring(sub["rest"], dot + 1, F.length(sub["rest"]))))
        kept = [sub[name].alias(name) for name in ("header", "headnote", "rest", "content", "no_body", "no_rows", "empty_table")]
        return F.struct(*kept, F.substring_index(sub["rest"], ".", 1).alias("number"), heading.alias("heading"))

    def check(sub: Column) -> Column:
        number, heading = sub["number"], sub["heading"]
        live = sub["header"].isNotNull() & sub["headnote"].isNotNull()
        code = (
            F.when(sub["header"].isNull(), "no_subd_header")
            .when(~live, F.lit(None).cast("string"))
            .when(sub["rest"].isNull(), "bad_subd_prefix")
            .when(heading.isNull(), "bad_subd_number")
            .when(heading != sub["headnote"], "heading_mismatch")
            .when(sub["no_body"], "no_subd_body")
            .when(sub["no_rows"], "no_table_body")
            .when(sub["empty_table"], "empty_table")
            .when(heading == "", "empty_heading")
        )
        return F.struct(
            live.alias("live"),
            code.alias("code"),
            number.alias("number"),
            heading.alias("heading"),
            sub["content"].alias("content"),
        )

    return marked.withColumn("headers", F.transform("subds", split_header)).withColumn(
        "parts", F.transform(F.transform("headers", split_rest), check)
    )


def table_text(cells: Column) -> Column:
    """Rows of trimmed cells as comma-joined lines, unquoted."""
    return F.array_join(
        F.transform(cells, lambda row: F.concat(F.array_join(F.transform(row, trim_space), ","), F.lit("\n"))), ""
    )


def first_code(items: Column) -> Column:
    return F.get(F.filter(F.transform(items, lambda item: item["code"]), lambda code: code.isNotNull()), F.lit(0))


def with_header(marked: DataFrame) -> DataFrame:
    """Adds chapter, section and title from the heading `chapter.section title`; null where a part is missing."""
    words = F.split("h1", " ", 2)
    cite = F.split(F.get(words, F.lit(0)), r"\.", 2)
    return (
        marked.withColumn("title", F.get(words, F.lit(1)))
        .withColumn("chapter", F.get(cite, F.lit(0)))
        .withColumn("section", F.get(cite, F.lit(1)))
    )


def scrape(pages: DataFrame, host: str = SITE_HOST) -> DataFrame:
    """One row per page: url, page_kind, outcome (links, statute, repealed, error), error_code, links, statute.

    A page that fails any check yields nothing but its error code.
    """
    checked = with_header(checked_subdivisions(checked_rows(statute_pages(pages), host)))
    is_index = F.col("page_kind").isin(KIND_CHAPTERS, KIND_SHORT_CHAPTERS, KIND_SECTIONS)
    is_statute = F.col("page_kind") == KIND_STATUTE
    repealed = is_statute & F.col("h1").isNull() & F.coalesce(F.col("paragraph").contains(REPEALED_MARK), F.lit(False))
    whole = F.size("subds") == 0
    code = (
        F.when(F.col("kind_error").isNotNull(), F.col("kind_error"))
        .when(is_index & (F.size("rows") == 0), "no_toc_rows")
        .when(is_index, first_code(F.col("rows")))
        .when(repealed, F.lit(None).cast("string"))
        .when(F.col("h1").isNull(), "no_title")
        .when(whole & F.col("paragraph").isNull(), "no_body")
        .otherwise(
            F.coalesce(
                first_code(F.col("parts")),
                F.when(F.col("title").isNull() | F.col("section").isNull(), "malformed_title"),
            )
        )
    )
    live = F.transform(
        F.filter("parts", lambda sub: sub["live"]),
        lambda sub: F.struct(sub["number"].alias("number"), sub["heading"].alias("heading"), sub["content"].alias("content")),
    )
    only = F.array(F.struct(F.lit("").alias("number"), F.lit("").alias("heading"), F.col("paragraph").alias("content")))
    good = F.col("error_code").isNull()
    statute = F.struct("chapter", "section", "title", F.when(whole, only).otherwise(live).alias("subdivisions"))
    # As rows of an explode, the codes are worked out once for each page: Spark would copy all rules into every later filter.
    judged = checked.select("*", F.explode(F.array(code)).alias("error_code"))
    return (
        judged.withColumn(
            "outcome",
            F.when(~good, "error").when(is_index, "links").when(repealed, "repealed").otherwise("statute"),
        )
        .select(
            "url",
            "page_kind",
            "outcome",
            "error_code",
            F.when(
                F.col("outcome") == "links",
                F.transform(F.filter("rows", lambda row: row["valid"]), lambda row: row["link"]),
            ).alias("links"),
            F.when(F.col("outcome") == "statute", statute).alias("statute"),
        )
    )


def frontier_links(scraped: DataFrame) -> DataFrame:
    """(url, pos, link): links of the good index pages, order and duplicates kept."""
    return scraped.filter(F.col("outcome") == "links").select("url", F.posexplode("links").alias("pos", "link"))


def quarantine(scraped: DataFrame) -> DataFrame:
    return scraped.filter(F.col("outcome") == "error").select("url", "page_kind", "error_code")
