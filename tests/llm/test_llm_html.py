"""Main text of pages: blocks, the host's repeated runs, and the given pages."""

import html
import re
import time

from pathlode.llm import html_text as h
from pathlode.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def text_of(page):
    return h.kept(h.blocks(page), set())[0]


def test_blocks_and_inline_elements():
    assert text_of("<article><p>a<b>b</b> c<br>d &amp; &lt;x&gt;</p> tail</article>") == "ab c d & <x> tail"
    assert text_of("<article>one<p>two<p>three<ul><li>x<li>y</ul></article>") == "one two three x y"
    assert text_of("<ARTICLE><P TITLE='a>b'>q&nbsp;&nbsp;r</P></ARTICLE>") == "q r"
    assert text_of("<article>a<!-- <p>no</p> -->b<script>if(1<2)'</p>'</script>c</article>") == "abc"
    assert text_of("<article><p>cut") == "cut"
    assert text_of("<article>x < y & z</article>") == "x < y & z"
    assert text_of("<article><table><tr><td>1<td>2<tr><td>3</table></article>") == "1 2 3"


def test_chrome_goes():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <main><article><header><h1>Head</h1></header><p>Body</p><aside>Side</aside>
    <div class="ad-slot">Buy</div><form><label>Mail</label><button>Go</button></form>
    <section id="comments"><article class="comment">First!</article></section></article></main>
    <div id="side-bar">More</div><footer>&copy; me</footer></body></html>"""
    assert text_of(page) == "Head Body"
    assert text_of("<div>loose</div><main>in <i>main</i></main>") == "in main"
    assert text_of("<div class='post-content'>P</div><p>other</p>") == "P"


def test_awkward_pages():
    assert h.blocks(None) == h.blocks("") == []
    assert text_of("no markup at all") == "no markup at all"
    assert text_of("</p></div>stray<b></p>x") == "stray x"
    assert text_of("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert text_of("<p title=\"never closed>q</p> <b>z</b>") == "q z"
    long = "<article>" + "<p>word &amp; more</p>" * 50_000
    assert len(text_of(long).split()) == 150_000


def test_repeated_runs_of_a_host_go(spark):
    shared = "Read all of our other stories about things that happened today"
    rows = [
        (i, f"http://one.example/{i}", f"<div>{shared}</div><div>Only page {i} says this {i * 7} here</div>")
        for i in range(6)
    ]
    rows += [(10, "http://two.example/", f"<div>{shared}</div>")]
    rows += [(11, None, None), (12, None, ""), (13, "http://one.example/0", rows[0][2]), rows[1]]
    # An article keeps what other pages repeat.
    rows += [(20 + i, "http://three.example/", f"<article><p>{shared}</article>") for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "1 AS text", "2 AS mark", "3 AS host"
    )
    got = h.main_text(pages).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    for i in range(6):
        assert text[i] == f"Only page {i} says this {i * 7} here" or i == 0
    assert text[10] == shared and text[11] == text[12] == ""
    assert text[20] == shared
    # The shared line, and the two words after it that all pages have too.
    assert next(r for r in got if r["page_id"] == 3)["n_repeated"] == len(shared.split()) + 2
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert h.main_text(pages.limit(0)).collect() == []


def by_page(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in h.main_text(pages).collect()}


def test_copies_and_quotations_stay_on_open_pages(spark):
    line = "Share all of these stories with your friends by mail today"
    quote = "a passage of more than eight words that a second page quotes in full"
    own = [f"own{i} words{i} of{i} page{i} number{i} that{i} no{i} other{i} has{i}" for i in range(6)]
    # The menu is shorter than a run, and another text follows it on each page.
    page = "<div>Home News {i}</div><div>Home News</div><div>{own}</div><div>{line}</div>"
    rows = [(i, f"http://one.example/{i}", page.format(i=i, own=own[i], line=line)) for i in range(6)]
    rows += [(i, f"http://one.example/{i}", f"<div>Only {i}</div><div>{quote}</div>") for i in (6, 7)]
    rows += [(10, "http://one.example/copy", rows[1][2]), (11, "http://one.example/1?again", rows[1][2])]
    # Only copies: one content, of which nothing is repeated.
    rows += [(20 + i, "http://two.example/", f"<div>{quote}</div>") for i in range(4)]
    text = by_page(spark, rows)
    assert all(text[i] == f"Home News {i} {own[i]}" for i in range(1, 6))
    assert text[10] == text[11] == text[1]
    assert all(text[i].endswith(quote) for i in (6, 7))
    assert all(text[20 + i] == quote for i in range(4))


def test_repeated_blocks_of_articles_go(spark):
    share, quote = "Share this story", "A sentence that just two of the articles have in common here"
    page = "<article><h1>Title {i}</h1><p>{share}</p><p>Text of page {i}</p>{more}</article>"
    rows = [
        (i, f"http://one.example/{i}", page.format(i=i, share=share, more=f"<p>{quote}</p>" * (i < 2)))
        for i in range(6)
    ]
    rows += [(10, "http://one.example/copy", rows[5][2])]
    # On two pages a line may be a quotation, and nothing is left of an article that is a copy.
    rows += [(20 + i, "http://two.example/", page.format(i=i, share=share, more="")) for i in range(2)]
    rows += [(30 + i, "http://three.example/", f"<p>{i}</p><article><p>{quote}</p></article>") for i in range(4)]
    text = by_page(spark, rows)
    assert all(text[i] == f"Title {i} Text of page {i}" + f" {quote}" * (i < 2) for i in range(6))
    assert text[10] == text[5]
    assert text[20] == f"Title 0 {share} Text of page 0"
    assert all(text[30 + i] == quote for i in range(4))


def test_query(spark):
    """The given pages have one marked article, so a plain search finds it too."""
    want = {}
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        inner = re.sub(r"</?(?:p|h1|br)>", " ", inner)
        inner = re.sub(r"</?(?:b|i|a|em|strong|span)>", "", inner)
        assert "<" not in inner
        want[r["page_id"]] = (r["url"], " ".join(html.unescape(inner).split()))
    got = QUERIES["op3_main_text"](spark, FOLDER).collect()
    assert {r["page_id"]: (r["url"], r["text"]) for r in got} == want
    assert len(got) == len(want) and any(r["n_repeated"] for r in got)


def test_ill_formed_long_pages_take_little_time():
    began = time.time()
    assert h.blocks("<a " * 300_000)[0][1].startswith("<a <a")
    assert h.blocks("<div>" * 100_000 + "</b>" * 100_000 + "x") == [(h._OPEN, "x")]
    assert h.blocks("<b>" * 100_000 + "<p>y</p>" * 50_000)[0][1] == "y"
    assert h.blocks("z <p>" + "</" * 100_000) == [(h._OPEN, "z")]
    assert time.time() - began < 30
