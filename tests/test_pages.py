import pytest
from pyspark.sql import functions as F

from lexloom.operators import extract as ex
from lexloom.operators.chunk import document_chunks, statute_chunks
from lexloom.sources.rendered import filled

SUBD = '<div class="subd"><h2 class="subd_no">{header}</h2>{body}</div>'


def section(inner):
    return f'<html><body><div class="section">{inner}</div></body></html>'


def subdivision(header, body="<p>Text.</p>"):
    return section('<h1 class="shn">7B.05 SOME TITLE.</h1>' + SUBD.format(header=header, body=body))


def note(text):
    return f'<span class="headnote">{text}</span>'


def toc(rows, table_id="toc_table", heading="Table of Chapters"):
    return f'<div><h2>{heading}</h2><table id="{table_id}">{rows}</table></div>'


def scraped(spark, *pages):
    rows = [(str(at), page) for at, page in enumerate(pages)]
    found = ex.scrape(spark.createDataFrame(rows, "url string, html string"))
    return [row for row in sorted(found.collect(), key=lambda row: int(row.url))]


def test_page_kinds(spark):
    pages = [
        toc("<tr><td><a href='/x'>1</a></td><td>A</td></tr>"),
        toc("<tr><td><a href='/x'>1</a></td><td>A</td></tr>", "chapters_table", "Table of Chapters, 1 - 2A"),
        '<h2 class="chapter_title">C</h2><div id="chapter_analysis"><table><tr><td><a href="/x">1</a></td><td>A</td></tr></table></div>',
        section("<h1>1.2 T</h1><p>x</p>"),
        "<p>nothing</p>",
        toc("", heading="Table of Chapters 1"),
        # A subdivision heading next to a table does not make an index page.
        section('<h1>1.2 T</h1><div class="subd"><h2 class="subd_no">Subd. 1.<span class="headnote">H.</span></h2><table><tr><td>a</table></div>'),
    ]
    assert [row.page_kind for row in scraped(spark, *pages)] == [1, 2, 3, 4, -1, -1, 4]


def test_index_rows(spark):
    rows = (
        "<tr><td><a href='//www.revisor.mn.gov/statutes/a'>1</a></td><td> UPPER </td></tr>"
        "<tr class='sub'><td>Part</td></tr>"
        "<tr><td>2</td><td>Repealed</td></tr>"
        "<tr><td><a href='/statutes/b'>3</a></td><td></td></tr>"
        "<tr><td><a href='https://other.example/c'>4</a></td><td>STRAßE</td></tr>"
        "<tr><td><a href='/statutes/b'>3</a></td><td>AGAIN</td></tr>"
    )
    (row,) = scraped(spark, toc(rows))
    assert row.links == [
        "https://www.revisor.mn.gov/statutes/a",
        "https://www.revisor.mn.gov/statutes/b",
        "https://other.example/c",
        "https://www.revisor.mn.gov/statutes/b",
    ]


def test_statute(spark):
    page = section(
        '<h1 class="shn">3C.10 PUBLICATION OF LAWS; A &amp; B.</h1>'
        + SUBD.format(header="Subdivision 1." + note(" First. "), body="<p>One &lt;1&gt;.</p><p>lost</p>")
        + SUBD.format(header="Subd. 2.[Repealed, 1999]", body="<p>gone</p>")
        + SUBD.format(header="Subd 3a." + note("Table."), body="<table><tr><th>h</th></tr><tr><td> a </td><td>$1,162</td></tr></table>")
    )
    (row,) = scraped(spark, page)
    assert row.outcome == "statute"
    assert (row.statute.chapter, row.statute.section, row.statute.title) == ("3C", "10", "PUBLICATION OF LAWS; A & B.")
    assert [tuple(sub) for sub in row.statute.subdivisions] == [
        ("1", "First.", "One <1>."),
        ("3a", "Table.", "\na,$1,162\n"),
    ]


def test_statute_without_subdivisions_and_repealed_statute(spark):
    whole, repealed = scraped(
        spark, section("<h1>1.2 T</h1><p>All of it.</p>"), section("<p>1.3 [Repealed, 2000 c 1]</p>")
    )
    assert [tuple(sub) for sub in whole.statute.subdivisions] == [("", "", "All of it.")]
    assert (repealed.outcome, repealed.error_code, repealed.statute) == ("repealed", None, None)


ERRORS = {
    "unknown_toc_heading": toc("<tr><td>1</td><td>A</td></tr>", heading="Contents"),
    "unknown_kind": "<div class='sections'>x</div>",
    "no_toc_rows": toc(""),
    "bad_toc_row": toc("<tr><td>one</td></tr>"),
    "no_href": toc("<tr><td>1</td><td>A</td></tr>"),
    "no_title": section("<p>text</p>"),
    "malformed_title": section("<h1>Untitled</h1><p>x</p>"),
    "no_body": section("<h1>1.2 T</h1>"),
    "no_subd_header": section('<h1>1.2 T</h1><div class="subd"><p>x</p></div>'),
    "bad_subd_prefix": subdivision("Section 1." + note("H.")),
    "bad_subd_number": subdivision("Subd. 1" + note("H")),
    "heading_mismatch": subdivision("Subd. 1. X" + note("H.")),
    "no_subd_body": subdivision("Subd. 1." + note("H."), "<ul><li>x</ul>"),
    "no_table_body": subdivision("Subd. 1." + note("H."), "<table></table>"),
    "empty_table": subdivision("Subd. 1." + note("H."), "<table><tbody></tbody></table>"),
    "empty_heading": subdivision("Subd. 1." + note(" ")),
}


def test_every_error_code_quarantines_its_page_whole(spark):
    rows = scraped(spark, *ERRORS.values())
    assert [row.error_code for row in rows] == list(ERRORS)
    assert all(row.outcome == "error" and row.links is None and row.statute is None for row in rows)


def test_first_failing_check_names_the_page(spark):
    both = section(
        "<h1>Untitled</h1>"
        + SUBD.format(header="Subd. 1" + note("H"), body="")
        + SUBD.format(header="Part 2." + note("H."), body="")
    )
    empty_heading_without_body = subdivision("Subd. 1." + note(""), "")
    assert [r.error_code for r in scraped(spark, both, empty_heading_without_body)] == ["bad_subd_number", "no_subd_body"]


def test_chunks(spark):
    page = section(
        "<h1>9.1 CAPS.</h1>"
        + SUBD.format(header="Subd. 1." + note("Head."), body="<p>Text\n</p>")
        + SUBD.format(header="Subd. 2b." + note("More."), body="<p>Text</p>")
    )
    pages = spark.createDataFrame([("u", page), ("v", section("<h1>9.2 T.</h1><p>x</p>"))], "url string, html string")
    found = {row.id: row.body for row in statute_chunks(ex.scrape(pages)).collect()}
    assert found == {
        "9.1.1": "§ 9.1, subd. 1: CAPS. -- Head.\nText\n",
        "9.1.2b": "§ 9.1, subd. 2b: CAPS. -- More.\nText\n",
        "9.2": "§ 9.2: T.\nx\n",
    }


def test_document_lines_keep_their_numbers(spark):
    documents = spark.createDataFrame([(5, "a\n\nb", "en", "s")], "doc_id long, text string, lang string, source string")
    assert [tuple(r) for r in document_chunks(documents).orderBy("id").collect()] == [
        (5, "en.5.1", "§ en.5, subd. 1: s\na\n"),
        (5, "en.5.3", "§ en.5, subd. 3: s\nb\n"),
    ]


@pytest.mark.parametrize("job", [ex.page_outline])
def test_null_pages_are_empty_pages(spark, job):
    (row,) = job(spark.createDataFrame([("u", None)], "url string, html string")).collect()
    assert (row.h1, row.links, row.paragraphs) == (None, [], [])


def test_rules_are_worked_out_once_for_a_page(spark):
    """Spark copies what a filter asks for into it: the rules stood in the filters of chunks, links and quarantine once more."""
    pages = spark.createDataFrame([("u", section("<h1>1.2 T</h1><p>x</p>"))], "url string, html string")
    found = ex.scrape(pages)
    for rows in (statute_chunks(found), ex.frontier_links(found), ex.quarantine(found), found.filter("outcome = 'statute'")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("no_subd_header") <= 1 and plan.count("bad_toc_row") <= 1


def test_headers_and_notes_are_looked_for_in_their_own_subdivision(spark):
    other = '<h2 class="other">Subd. 9.</h2>'
    nested = '<h2 class="subd_no">Subd. 2.<b><span class="headnote">Not this.</span></b><span>Nor this.</span>' + note("This.") + "</h2>"
    page = section(
        '<h1>1.2 T</h1><div class="subd">' + other + "</div>"
        '<div class="subd">' + other + nested + "<p>Text.</p></div><p>Outside.</p>"
    )
    emit, _ = ex.emitter({"subds": ex.STATUTE_MARKERS["subds"]})
    assert emit(ex.Page(page))["subds"] == [(None, None, None, False, None), ("Subd. 2.Not this.Nor this.This.", "This.", "Text.", False, None)]


def test_numbers_and_headings_part_at_the_first_dot(spark):
    heads = ["Subd. 1.A.B. " + note("A.B."), "Subd. 2" + note("H."), "Subd. .H." + note("H."), "Subd. 3." + note(" ")]
    marked = ex.checked_subdivisions(ex.statute_pages(spark.createDataFrame([(str(at), subdivision(head)) for at, head in enumerate(heads)], "url string, html string")))
    rows = marked.selectExpr("url", "parts[0].number", "parts[0].heading", "parts[0].code").collect()
    assert sorted(map(tuple, rows)) == [
        ("0", "1", "A.B. A.B.", "heading_mismatch"), ("1", "2H", "", "heading_mismatch"), ("2", "", "H.H.", "heading_mismatch"), ("3", "3", "", "empty_heading")
    ]


def test_templates_are_filled_as_format_string_does(spark):
    rows = spark.createDataFrame([(1, "a"), (None, None)], "n long, s string")
    template = "<%d> & %s, %d."
    assert rows.filter(~filled(template, F.col("n"), "s", "n").eqNullSafe(F.format_string(template, "n", "s", "n"))).isEmpty()
