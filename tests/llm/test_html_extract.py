import re
from html import unescape

import pyarrow.parquet as pq
import pytest

from codeloom.llm import html_extract
from codeloom.llm.html_extract import main_text

LONG = "A paragraph of the article that is long enough to surge over the threshold of a window of lines."
SCHEMA = "page_id long, url string, html string, text string"


def test_articles_of_the_test_pages():
    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist():
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = re.sub(r"</?(?:p|h\d|br)\b[^>]*>", "\n", inner)
        lines = (" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in blocks.split("\n"))
        assert main_text(page) == "\n".join(x for x in lines if x)


@pytest.mark.parametrize("furniture", [
    "<nav><p>%s</p></nav>", "<header><div>%s</div></header>", "<footer>%s</footer>", "<aside><p>%s</p></aside>", "<form><label>%s</label></form>", "<div class='ad'>%s</div>",
    "<div id=\"comments\"><p>%s</p></div>", "<div class='cookie-notice'>%s</div>", "<section class=user-comments><p>%s</p></section>", "<div role=navigation>%s</div>", "<script>var a='%s</p>';</script>",
    "<style>p{content:'%s'}</style>", "<!-- %s -->", "<div class='sideBar'>%s</div>", "<div hidden>%s</div>", "<ul class='menu'><li><a href='/'>%s</a></li></ul>", "<template><p>%s</p></template>",
])
def test_furniture_is_left_out(furniture):
    noise = furniture % ("Noise " * 30)
    for page in (f"<body>{noise}<div><h1>Title</h1><p>{LONG}</p><p>Short.</p></div>{noise}</body>", f"<body><article><h1>Title</h1><p>{LONG}</p>{noise}<p>Short.</p></article></body>"):
        assert main_text(page) == f"Title\n{LONG}\nShort."


def test_blocks_references_and_broken_markup():
    assert main_text(f"<p>a &amp; b\n  c&nbsp;d &#233;<p>{LONG}<br>x &lt;y&gt;") == f"a & b c d é\n{LONG}\nx <y>"
    assert main_text(f"<p><b>Bold <i>word</i></b>s</p><p>{LONG}</p>") == f"Bold words\n{LONG}"
    assert main_text(f"<div>{LONG}<ul><li>one<li>two</ul>") == f"{LONG}\none\ntwo"
    assert [main_text(x) for x in (None, "", "<p></p>", "<", "plain")] == ["", "", "", "<", "plain"]
    assert main_text("<article>" + "<p>Hi.</p>" * 3 + "<div class=ad>x</div>" * 5 + "<p>End.</p></article>") == "Hi.\nHi.\nHi.\nEnd."


def test_table(spark):
    pages = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>", "clash"), (2, None, None, ""), (2, None, None, ""), (None, "v", "<p>" + "é " * 100_000 + "</p>", "")], SCHEMA)
    got = sorted((r.page_id or 0, r.url or "", r.n_chars) for r in html_extract.extract(pages).collect())
    assert got == [(0, "v", 199_999), (1, "u", len(LONG)), (2, "", 0), (2, "", 0)]
    assert html_extract.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize("wrapper", ["class='no-sidebar'", "class='content with-sidebar'", "id='page' class='has-banner'", "class='sidebar-layout'", "id=banner class='page header'"])
def test_articles_inside_wrappers_named_by_the_layout(wrapper):
    noise = "<div class='sidebar'><p>Noise of a sidebar.</p></div><div class='related'><article>Teaser</article></div>"
    for tag in ("article", "main"):
        page = f"<body><p>Skip</p><div {wrapper}><{tag}><h1>Title</h1><p>{LONG}</p>{noise}<p>Short.</p></{tag}>{noise}</div></body>"
        assert main_text(page) == f"Title\n{LONG}\nShort."
    assert main_text(f"<div class='no-sidebar'><p>{LONG}</p></div>") == LONG
    for tag in ("nav", "aside", "footer", "form"):
        assert main_text(f"<{tag}><article><p>{LONG}</p></article></{tag}>") == ""
    comment = f"<div id='comments'><article class='comment'><p>{LONG} {LONG}</p></article></div>"
    assert main_text(f"<div><p>{LONG}</p></div>{comment}") == LONG
    assert main_text(f"<article><p>{LONG}</p></article>{comment}") == LONG


def test_title_under_a_div_of_the_class_header():
    assert main_text(f"<article><div class='entry-header'><h1>Title</h1><p>Share</p></div><p>{LONG}</p></article>") == f"Title\n{LONG}"
    assert main_text(f"<article><div class='ad'><h2>Buy</h2></div><p>{LONG}</p></article>") == LONG


def test_links_of_a_marked_article_stay():
    links = "".join(f"<li><a href='/{i}'>Reference {i}</a></li>" for i in range(5))
    page = f"<article><h1><a href='/'>Title</a></h1><p>{LONG}</p><ul>{links}</ul><p>Short.</p><p><a href='/x'>Source</a></p></article>"
    assert main_text(page) == "\n".join(["Title", LONG, *(f"Reference {i}" for i in range(5)), "Short.", "Source"])


def test_short_end_of_a_text_after_furniture():
    end = "A closing paragraph of about sixty characters, no more here."
    advert = "<div class='ad'><p>Buy</p><p>this</p><p>now</p><p>please</p></div>"
    for tail in (advert, "", "<ul>" + "<li><a href='/'>More links of the site</a></li>" * 4 + "</ul><p>Imprint</p>"):
        assert main_text(f"<div><p>{LONG * 9}</p>{advert}<p>{end}</p></div>{tail}") == f"{LONG * 9}\n{end}"


def page_texts():
    """Pages of the test table, and the text between their <article> tags."""
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        lines = (" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.sub(r"</?(?:p|h\d|br)\b[^>]*>", "\n", inner).split("\n"))
        yield page, "\n".join(x for x in lines if x)


@pytest.mark.parametrize("mark", ["", "<div>", "<div class='post'>", "<section class='social-history'>", "<div class='related-work'>", "<main>"])
def test_pages_without_an_article_mark(mark):
    end = mark.split(" ")[0].rstrip(">").replace("<", "</") + ">" if mark else ""
    for page, want in page_texts():
        assert len(want) < 600 or main_text(page.replace("<article>", mark).replace("</article>", end)) == want


def test_windows_decide(monkeypatch):
    """Long text beside a marked article of teasers, and short text outside one, are told apart by their sums."""
    teasers = "".join(f"<article><p>Teaser {i}</p></article>" for i in range(4))
    long_page = f"<div>{''.join(f'<p>{LONG * 9} {i}</p>' for i in range(6))}</div>{teasers}"
    short_page = f"<div><p>Outside.</p></div><article><p>{LONG}</p></article>"
    unmarked = f"<div><p>Short one.</p></div><div><a href='/'>Link</a></div><div>{''.join(f'<p>{LONG} {i}</p>' for i in range(6))}</div>"
    assert LONG * 9 in main_text(long_page) and main_text(short_page) == LONG
    assert main_text(unmarked).startswith(f"{LONG} 0")
    monkeypatch.setattr(html_extract, "SURGE_SHARE", 0.0)
    assert "Outside." in main_text(short_page)
    assert main_text(unmarked).startswith("Short one.")


def test_link_lists_inside_a_text_without_a_mark():
    links = "".join(f"<li><a href='/{i}'>Reference {i}</a></li>" for i in range(6))
    page = f"<ul>{links}</ul><div><h1>Title</h1><p>{LONG}</p><ul>{links}</ul><p>Tail.</p></div><ul>{links}</ul>"
    assert main_text(page) == "\n".join(["Title", LONG, *(f"Reference {i}" for i in range(6)), "Tail."])


def test_title_in_the_header_of_an_article():
    assert main_text(f"<article><header><h1>Title</h1><p>By line</p></header><p>{LONG}</p></article>") == f"Title\n{LONG}"
