from lexloom.functions.markup import Page, read_attributes


def tags(source):
    return [node[0] for node in Page(source).nodes]


def texts(source, tag):
    page = Page(source)
    return [page.text(node) for node in page.find(tag)]


def test_text_of_nested_elements_without_comments():
    assert texts("<h1>a <b>b</b><!-- no --> &amp; c</h1>", "h1") == ["a b & c"]


def test_paragraphs_end_where_the_next_block_starts():
    assert texts("<!doctype html><p>one<p>two<div>three</div>four</p>", "p") == ["one", "two", ""]


def test_inline_markup_left_open_does_not_hide_paragraphs():
    assert texts("<p><b>one<br><p>two</p>", "p") == ["one", "two"]


def test_a_table_ends_a_paragraph_only_in_standards_mode():
    assert texts("<!DOCTYPE html><p>a<table><tr><td>b</table>", "p") == ["a"]
    assert texts("<p>a<table><tr><td>b</table>", "p") == ["ab"]


def test_body_and_row_of_a_table_are_implied():
    assert tags("<table><td>a<td>b<tr><td>c</table>") == ["table", "tbody", "tr", "td", "td", "tr", "td"]


def test_cells_outside_tables_are_ignored():
    assert tags("<tr><td>a</td></tr><p>b</p>") == ["p"]


def test_nested_table_stays_in_its_cell():
    page = Page("<table><tr><td><table><tr><td>in</td></tr></table></td><td>out</td></tr></table>")
    outer = page.find("tr")[0]
    assert [page.text(cell) for cell in page.children(outer, "td")] == ["in", "out"]


def test_script_text_is_not_markup():
    assert tags('<script>var t = "</p><h1>";</script><h1>x</h1>') == ["script", "h1"]
    assert texts("<SCRIPT>a</p></Script ><h1>x</h1>", "h1") == ["x"]


def test_list_items_and_headings_end_each_other():
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul>", "li") == ["a", "bc", "c"]
    assert texts("<h1>a<h2>b</h2>", "h1") == ["a"]


def test_attributes():
    assert read_attributes(" CLASS='a b' id=x href=\"/q?a=1&amp;b=2&copy=3\" checked") == {
        "class": "a b",
        "id": "x",
        "href": "/q?a=1&b=2&copy=3",
        "checked": "",
    }
    assert Page('<a title="1 > 2" href="/x">y</a>').attribute(0, "href") == "/x"


def test_broken_markup_does_not_stop_the_reader():
    for source in ("", "<", "a < b", "<p", "<!-- open", "<script>open", "</div></p>", '<a href="x>y', "<table></td></table>"):
        Page(source)


def test_line_ends_are_folded():
    assert texts("<p>a\r\nb\rc</p>", "p") == ["a\nb\nc"]


def read_generally(source):
    """The page as the reader of any markup makes it."""
    page = Page("")
    page._read(source)
    return page


def told(page):
    return [(*node[:4], page.text(at)) for at, node in enumerate(page.nodes)], page.by_tag


def test_plain_pages_are_read_by_their_tags_alone_to_the_same_elements():
    bits = '<p>|</p>|<div class="x">|</div>|<table>|<tr>|<td>|</td>|</table>|<h1>|</h2>|<a href="/x?a=1">|</a>|a &amp;lt; b|<br>|<!-- c -->'
    bits = [*bits.split("|"), "", "&copy;", "<LI>"]
    for at in range(2000):
        source = "<!DOCTYPE html>" + "".join(bits[at * step % len(bits)] for step in (1, 3, 5, 7, 11, 13, 17))
        assert Page("<!DOCTYPE html>")._read_plain(source)
        assert told(Page(source)) == told(read_generally(source))


def test_pages_with_tags_that_cannot_be_told_alone_are_read_generally():
    for source in ('<a title="x>y">z</a>', "a < b", "x >p< y", "<!-- <p> -->", "<script>1 < 2</script>", "<!-->a", "<title>&amp;</title>"):
        assert not Page("")._read_plain(source)
        assert told(Page("<!DOCTYPE html>" + source)) == told(read_generally("<!DOCTYPE html>" + source))
