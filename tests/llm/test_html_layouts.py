"""Main text of pages of many layouts, most without an article element, and hard cases through Spark."""

import html
import re
import time

import pyarrow.parquet as pq
import pytest

from weft.llm import htmlmain

P = "<p>The first long paragraph, with commas, and more. It goes on, and on.</p><p>The second paragraph, also long; it ends here. Really, it does.</p>"
T = "The first long paragraph, with commas, and more. It goes on, and on.\nThe second paragraph, also long; it ends here. Really, it does."
COMMENT = "<p>Reader {} writes a long, long comment; with many words, and marks. Lots of them, in fact.</p>"
LAYOUTS = {
    "menu below 300 elements": ("<div>" * 300 + "<nav>MENU menu</nav>" + "</div>" * 300 + f"<article>{P}</article>", T),
    "layout class that names a sidebar": (f'<body><div class="layout with-sidebar"><div class="x">{P}</div></div></body>', T),
    "layout and a sidebar": (f'<body><div class="sidebar-left"><div class="x">{P}</div><div class="sidebar"><p>Side, text here.</p></div></div></body>', T),
    "title in a post's header": (f'<article><div class="post-header"><h1>Title</h1></div>{P}</article>', "Title\n" + T),
    "title beside the body": (f'<body><div class=post><div class="post-header"><h1>Title</h1></div><div class=body>{P}</div></div><div>junk, here.</div></body>', "Title\n" + T),
    "header and footer of an article": (f"<article><header><h1>Title</h1></header>{P}<footer>tags</footer></article>", "Title\n" + T),
    "letters that change length in lower case": (f"<article><p>İİİ Istanbul.</p><script>var b=1;</script>{P}</article>", "İİİ Istanbul.\n" + T),
    "linked blocks": (
        f"<article><h2><a href=x>Linked heading</a></h2>{P}<ul><li><a href=y>Linked item</a></li><li>other</li></ul><p><a href=z>Linked paragraph</a></p></article>",
        f"Linked heading\n{T}\nLinked item\nother\nLinked paragraph",
    ),
    "comments inside": (f'<div class="content">{P}<div class="comments-area"><h3>Comments</h3><ol class="commentlist"><li class="comment">{COMMENT}</li></ol></div></div>', T),
    "more comments than article": (
        '<div id="wrap"><h1>T</h1><p>Short article, text of it here.</p><p>And a second one, too.</p></div><section id="comments">'
        + "".join(f'<article class="comment">{COMMENT.format(i)}</article>' for i in range(30)) + "</section>",
        "T\nShort article, text of it here.\nAnd a second one, too.",
    ),
    "menu beside paragraphs": (f"<ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul><h1>Title</h1>{P}<form><input><p>Sign up, now.</p></form>", "Title\n" + T),
    "advert in a line": (f'<article><p>Text, one <span class="ad">BUY</span> more.</p>{P}</article>', "Text, one more.\n" + T),
    "no paragraphs": (
        '<div id="menu"><a href=1>Home</a> <a href=2>News</a></div><div id="content"><div>Alpha text, one. It is long, you know, and has marks.</div>'
        '<div>Beta text, two. It is long as well, with marks.</div></div><div id="footer">© Me</div>',
        "Alpha text, one. It is long, you know, and has marks.\nBeta text, two. It is long as well, with marks.",
    ),
    "tables and quotes": (f"<main><h1>T</h1>{P}<table><tr><td>a<td>b</table><pre>x  y</pre><blockquote>Quote</blockquote></main>", f"T\n{T}\na\nb\nx y\nQuote"),
    "one paragraph": ("<nav>n</nav><div><h2>Sub</h2><p>Only one paragraph, long enough. It has marks, too.</p></div><footer>f</footer>", "Sub\nOnly one paragraph, long enough. It has marks, too."),
    "notices": (f'<div class="cookie-notice"><p>We use cookies, as all do. Please accept, or not.</p></div><div class="entry">{P}</div><div class="newsletter-signup"><p>Subscribe, please.</p></div>', T),
    "title before the content": (f"<body><h1>Title</h1><div id=c>{P}</div><div>other</div></body>", "Title\n" + T),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, want = LAYOUTS[name]
    assert htmlmain.main_text(page) == want


def test_the_given_pages_without_their_article_element():
    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist():
        body = page[page.index("<article>") + 9 : page.index("</article>")].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        plain = page.replace("<article>", '<div class="story">').replace("</article>", "</div>")
        assert htmlmain.main_text(plain) == "\n".join(b for b in blocks if b)


def test_deep_and_long_pages_take_linear_time():
    start = time.process_time()
    assert htmlmain.main_text("<div>" * 100_000 + "deep") == "deep"
    assert htmlmain.main_text("<b>" * 50_000 + "x</u></i>" * 1000).startswith("x")
    assert len(htmlmain.main_text("<p>word, and more.</p>" * 50_000)) == 50_000 * 16 - 1
    assert time.process_time() - start < 30


def test_hard_cases_through_spark(spark):
    rows = [(1, "u", None, "t", 5), (2, None, "", "t", 5), (None, "u", f"<p>{P}", "t", 5), (3, "u", P, None, 5), (3, "u", P, None, 5), (4, "u", "<p>x" * 20_000, "t", 5)]
    schema = "page_id long, url string, html string, text string, n_chars int"
    got = htmlmain.extract(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    long = "\n".join(["x"] * 20_000)
    want = [(1, "u", ""), (2, None, ""), (None, "u", T), (3, "u", T), (3, "u", T), (4, "u", long)]
    assert sorted(map(str, got.collect())) == sorted(f"Row(page_id={i}, url={u!r}, text={t!r}, n_chars={len(t)})" for i, u, t in want)
    assert htmlmain.extract(spark.createDataFrame([], schema)).count() == 0
