import html
import re
import time

import pyarrow.parquet as pq
import pytest

from hydrolens.llm import tag_paths
from hydrolens.llm.queries import op4_main_text
from hydrolens.llm.tables import table
from hydrolens.llm.tag_paths import main_text
from tests.helpers import rows


def article(page):
    """Text of the only article of a generated page."""
    body = re.search(r"<article>(.*?)(?:</article>|<footer>)", page, re.DOTALL)[1]
    parts = re.split(r"</?(?:p|h1)\b[^>]*>", re.sub(r"<br>", " ", body))
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", part)).split()) for part in parts)
    return "\n".join(line for line in lines if line)


def test_query_equals_the_articles(spark, sf_dir):
    pages = {p.page_id: p for p in table(spark, sf_dir, "pages").collect()}
    found = op4_main_text(spark, sf_dir).collect()
    assert len(found) == len(pages)
    for row in found:
        assert (row.url, row.text) == (pages[row.page_id].url, article(pages[row.page_id].html))
        assert row.n_chars == len(row.text)


def stripped(page, tags):
    """The page without class, id and role, its elements of these names as plain ones."""
    page = re.sub(rf"<(/?)(?:{tags})\b[^>]*>", r"<\1div>", page)
    return re.sub(r"\s(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", "", page)


@pytest.mark.parametrize("tags", ["article|main", "article|main|nav|header|footer|aside|section|form|menu"])
def test_ratios_find_the_articles_without_names(monkeypatch, tags):
    """Nothing names the parts of these pages; without the ratios no article is right."""
    pages = [p["html"] for p in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).to_pylist()]
    right = sum(main_text(stripped(page, tags)) == article(page) for page in pages)
    assert right >= 0.94 * len(pages)
    monkeypatch.setattr(tag_paths, "KERNEL", (0, 0, 0))  # no scores, so all texts are equal
    assert sum(main_text(stripped(page, tags)) == article(page) for page in pages) == 0


@pytest.mark.parametrize(
    "part",
    ["<a ", "<b>x", "<!", "<", '<a "', "<a '>", "<a \"'> ", "</i>", "<i><p><b>", "<b><li></li>", "<div>", "<svg ", "<td><b>", "<div class=ad>x</div>"],
)
def test_broken_pages_take_time_in_proportion(part):
    def seconds(n):
        start = time.process_time()
        main_text(part * (n // len(part)))
        main_text(part * (n // 2 // len(part)) + "</i></b>" * (n // 16))
        return time.process_time() - start

    seconds(10_000)
    assert seconds(400_000) < 16 * max(seconds(50_000), 0.05)


def test_one_wide_chain_of_inline_elements():
    n = 30_000
    for page in ("<b>" * n + "</i>" * n + "<p>" * n, "<i><p>" + "<b>" * n + "</i>" * n, "<b>" * n + "<li></li>" * n):
        start = time.process_time()
        main_text(page)
        assert time.process_time() - start < 20


@pytest.mark.parametrize("name", ["advert", "cookie-notice", "share", "newsletter subscribe"])
def test_paragraphs_named_as_boilerplate_go(name):
    assert main_text(f"<article><p>{PROSE}</p><p class='{name}'>Buy this now!</p><p class='lead-share'>{PROSE}</p></article>") == f"{PROSE}\n{PROSE}"


def test_blocks_off_the_content_paths_go():
    links = "<div><a>Home</a></div><div><a>About</a></div><div><a>Read more</a> | <a>Share</a></div>"
    assert main_text(f"<article><h2>Head</h2><p>{PROSE * 3}</p><p>{PROSE * 3}</p>{links}{links}</article>").startswith(f"Head\n{PROSE * 3}")
    assert "About" not in main_text(f"<article><h2>Head</h2><p>{PROSE * 3}</p><p>{PROSE * 3}</p>{links}{links}</article>")


PROSE = "This is a sentence, and here is another one; both are long enough."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        (f"<div><ul><li><a>x</a><li><a>y</a></ul><div><p>{PROSE}<p>{PROSE}</div></div>", f"{PROSE}\n{PROSE}"),
        (f"<div id='side-menu'>{PROSE}</div><main><h2>Head</h2><p>{PROSE}</p></main>", f"Head\n{PROSE}"),
        (f"<article><p>A.</p></article><div class=x>{PROSE}</div>", "A."),
        (f"<article><p>{PROSE}</p><div class='comments'><p>{PROSE}</p></div><aside>z</aside></article>", PROSE),
        ("<article><header><h1>T</h1>by me</header><p>x <form>no</form><script>'</p>'</script>y</article>", "T\nx\ny"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<p>un<b>bold</b>word<br>next&nbsp;&#233;", "unboldword next é"),
        ("<p>a < b and <3 and <!-- no --> c", "a < b and <3 and c"),
        ("<div hidden>no</div><p style='display: none'>no</p><p>yes</p>", "yes"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


LONG = f"<article><h1>Head</h1><p>{PROSE}</p><p>{PROSE}</p></article>"
FOUND = f"Head\n{PROSE}\n{PROSE}"


@pytest.mark.parametrize("name", ["content no-sidebar", "has-sidebar", "with-comments", "page-header-fixed", "widget"])
def test_layouts_are_not_boilerplate(name):
    menu = "<ul><li>x</li><li>y</li></ul>"
    assert main_text(f"<body><nav>{menu}</nav><div class='{name}'>{LONG}<div class='sidebar'>{PROSE}</div></div></body>") == FOUND
    assert main_text(f"<div id='{name}'><main><p>{PROSE}</p></main></div>") == PROSE
    assert main_text(f"<div class='{name}'><div><p>{PROSE}</p><p>{PROSE}</p></div></div>") == f"{PROSE}\n{PROSE}"
    assert main_text(f"<div class='{name}'>{LONG}</div>" * 3) != ""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<form><div>{LONG}</div></form>", FOUND),
        (f"<form><main><p>{PROSE}</p></main></form><div>x</div>", PROSE),
        (f"{LONG}<div class='related-posts'><article><p>{PROSE}</p></article></div>", FOUND),
        (f"<article><p>Short.</p><div class='comments'>{LONG * 3}</div></article>", "Short."),
        (f"<div class='no-sidebar'><p>{PROSE}</p><div class='comments'><p>{PROSE * 9}</p></div></div>", PROSE),
        (f"<div><p>{PROSE}</p><p>{PROSE}</p></div><aside><article>more</article></aside>", f"{PROSE}\n{PROSE}"),
        (f"<article><svg viewBox='0 0 1 1'/><p>{PROSE}</p><svg><path/></svg><p>{PROSE}</p></article>", f"{PROSE}\n{PROSE}"),
    ],
)
def test_boilerplate_around_and_beside_articles(page, text):
    assert main_text(page) == text


PARTS = [f"{n}. {PROSE}" for n in "ABCD"]


@pytest.mark.parametrize(
    "page",
    [
        "<body><div><p>{}</p></div><div><p>{}</p><p>{}</p><p>{}</p></div></body>",
        "<main><article><p>{}</p></article><article><p>{}</p><p>{}</p><p>{}</p></article></main>",
        "<body><article><p>{}</p><p>{}</p></article><div>x</div><article><p>{}</p><p>{}</p></article></body>",
        "<main><p>{}</p><article><p>{}</p><p>{}</p><p>{}</p></article></main>",
        "<body><section><p>{}</p></section><div><div><div><p>{}</p><p>{}</p></div></div></div><p>{}</p></body>",
    ],
)
def test_all_parts_of_the_content(page):
    assert main_text(page.format(*PARTS)) == "\n".join(PARTS)


def test_short_articles_do_not_hide_the_content():
    prose = "".join(f"<p>{part}</p>" for part in PARTS)
    assert main_text(f"<div>{prose}</div><div><i>x</i></div><div><i>x</i></div><article>y</article><article>z</article>").startswith("\n".join(PARTS))


def test_ratios_reject_short_paths():
    page = "<div>" + "<ul>" + "<li><a>link</a></li>" * 20 + "</ul>" + f"<section><p>{PROSE}</p><p>{PROSE}</p></section></div>"
    nodes, threshold = tag_paths.scored(tag_paths.texts(page)[0])
    assert [node.text for node in nodes if node.score >= threshold][-2:] == [PROSE, PROSE]
    assert main_text(page) == f"{PROSE}\n{PROSE}"


def test_odd_rows(spark):
    data = [(None, None, None), (1, "u", "<p>x"), (1, "u", "<p>x"), (2, None, "")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    assert rows(tag_paths.extract(pages)) == sorted([(None, None, "", 0), (1, "u", "x", 1), (1, "u", "x", 1), (2, None, "", 0)], key=repr)
    assert tag_paths.extract(pages.limit(0)).count() == 0
