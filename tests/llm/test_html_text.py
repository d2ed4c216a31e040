import html
import re
import time

from quorum.llm.catalog import QUERIES
from quorum.llm.common import read
from quorum.llm.html_text import extract, main_text
from tests.llm.conftest import SF

PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1><nav>a b</nav></header>
<div class="cookie-notice">We use cookies and more cookies on this site, long text really</div>
<div id="content"><h1>Title here</h1><p>First paragraph with <a href="x>y">linked</a> words that go on for a while &amp; a bit more.</p>
<p>Short.</p><div class="ad-slot">Buy now buy now buy now</div><p>Second paragraph with a good number of words to read for
everyone.</p></div><form>Name<input></form><section class="comments"><article class="comment"><p>Nice post, I liked it a whole lot
and more and more!!!</p></article></section><aside>Sidebar text that is long enough to be something</aside><footer>Foot</footer></body>"""


def test_page_without_an_article_element():
    assert main_text(PAGE) == ("Title here First paragraph with linked words that go on for a while & a bit more. Short. "
                               "Second paragraph with a good number of words to read for everyone.")


def test_boilerplate_inside_an_article():
    page = ("<nav>menu <div>x</div><article><header><h1>T</h1></header><p class=ad>Buy<p>Real &lt;b&gt; one.<script>p('</p>')</script>"
            "<div class='comments'><p>c1</p><div>c2</div></div><p>T<b>w</b>o.<br>3&nbsp;&#52;</p></article><p>out")
    assert main_text(page) == "T Real <b> one. Two. 3 4"


def test_edges(spark):
    assert main_text(None) == main_text("") == main_text("<nav>only</nav>") == "" and main_text("plain &amp; bare") == "plain & bare"
    assert main_text("<article><p>a<p>b <i>c</i>d <img src='x") == "a b cd"
    long = "<article>" + "<p>word</p>" * 50000 + "</article>"
    assert main_text(long) == " ".join(["word"] * 50000)
    df = spark.createDataFrame([(1, None, None, "t", 1), (1, "u", PAGE, "t", 2)], "page_id long, url string, html string, text string, n_chars int")
    got = extract(df, ["page_id", "url", "text"]).collect()
    assert sorted(r.n_chars for r in got) == [0, len(main_text(PAGE))] and extract(df.limit(0), ["page_id"]).count() == 0


def test_ids_headings_and_formulas_stay_inside_an_article():
    page = ("<article><div class='article-header'><h1 id='form'>T</h1></div><h2 id='related-work' class='related'>Related work</h2>"
            "<section id='search-algorithms'><p>One where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></section>"
            "<div class='share-buttons'>Tweet</div><div id='comments' class='comment-list'>Nice</div></article>")
    assert main_text(page) == "T Related work One where x=2 holds."


def test_long_quoted_values_and_stray_quotes():
    assert main_text(f"<article><p title='{'a>b ' * 5000}'>one</p><p>two</p></article>") == "one two"
    assert main_text('<article><p title="x>one</p><p>two</p></article>') == "one two"
    assert main_text('<article><p>a<!-- <p> > -->b</p><svg/><p>c &#0000000000065; &#' + "9" * 9000 + ";</p></article>") == "ab c A \ufffd"


def test_time_grows_with_the_page_alone():
    for hostile in ('<p x="', "<a", "<!", "<script", "<a x='>'", "</p", "<!--", "=", "<a =", "&#", "<p class='ad", "<div>", "<svg>"):
        start = time.process_time()
        main_text("<article><p>word</p>" + hostile * (2_000_000 // len(hostile)))
        assert time.process_time() - start < 10, hostile


def test_windows_decide_inside_marked_pages():
    long = "A paragraph of the article that has a good number of words, so that its window of lines is a surge."
    menu = "".join(f"<li><a href='/{i}'>Section number {i}</a></li>" for i in range(5))
    teaser = "<article><h2><a href='/t'>Another story</a></h2><p>Short teaser.</p></article>"
    assert main_text(f"{teaser}<article><h1>T</h1><ul>{menu}</ul><p>{long}</p><p>End.</p></article>{teaser}") == f"T {long} End."
    # single lines of links are no dive, and without any surge or any line outside links nothing is left out
    assert main_text(f"<article><h1><a>T</a></h1><p>{long}</p><p><a>Source</a></p></article>") == f"T {long} Source"
    assert main_text(teaser + "<article><p>one</p></article>") == "Another story Short teaser. one"
    assert main_text(f"<article>{menu}</article>") == " ".join(f"Section number {i}" for i in range(5))
    # nested articles are parts of the outer one
    assert main_text(f"<main><article><p>{long}</p></article><article><p>b</p></article></main>") == f"{long} b"


def test_query_equals_the_marked_articles(spark):
    pages = {r.page_id: r.html for r in read(spark, SF, "pages").collect()}
    for r in QUERIES["op3_html_text"](spark, SF).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())
        assert r.text == want and r.n_chars == len(want)
