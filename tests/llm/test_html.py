import html
import re
import time

import duckdb
import pytest

from meshwork.llm.html_text import Page, extract, main_text

BODY = "<p>First paragraph of the story, long enough to count as text.</p><p>Second one &amp; more of the same, with words.</p>"
WANT = "First paragraph of the story, long enough to count as text.\nSecond one & more of the same, with words."


@pytest.mark.parametrize(
    "around",
    [
        "<html><body><nav><ul><li><a href=a>menu</a></ul></nav><article>{}</article><footer>foot</footer></body></html>",
        "<body><div class='sidebar'><p>many other words that are no story at all, really</p></div><div id=content>{}</div><div class=comments><p>I like it, I really do like it very much</p></div>",
        "<div><header><h2>Site</h2></header><main><form><p>your name</p><input></form>{}<script>var a='</p>';</script></main></div>",
        "<body><div role=banner>hello</div><section>{}<aside>see also</aside><div class='cookie-notice'>we use cookies</div></section>",
        "<!DOCTYPE html><title>t</title><style>p{{}}</style><!-- x -->{}<div class=ad>buy</div>",
        "<body class='has-sidebar'><table><tr><td>{}</td></tr></table><div hidden>no</div><div style='display: none'>no</div>",
        "<article>{}<div id='comments'><article><p>reader comment</p></article></div>",
    ],
)
def test_pages(around):
    assert main_text(around.format(BODY)) == WANT


def test_blocks_and_white_space():
    assert main_text("<article><h1> A\n  title </h1>one<br>two <b>th</b>ree<p>x&nbsp;y<ul><li>i<li>j</ul>end</article>") == "A title\none two three\nx y\ni\nj\nend"
    assert main_text("<article><p><b>open<p>next</article>") == "open\nnext"
    assert main_text("plain &lt;text&gt; &#233; &amp &unknown;") == "plain <text> é & &unknown;"


@pytest.mark.parametrize("cut", ["<article><p>kept text<p>more", "<article><p>kept text<p>more<a href=\"x", "<article><p>kept text<p>more</arti", "<article><p>kept text<p>more<!-- never closed", "<article><p>kept text<p>more<script>var a"])
def test_pages_that_break_off(cut):
    assert main_text(cut) == "kept text\nmore"


@pytest.mark.parametrize("name", ["class='post-content no-sidebar'", "class='content has-sidebar'", "class='entry share-enabled'", "class=no-comments", "id=social-science", "id='related-work'", "class=widget"])
@pytest.mark.parametrize("around", ["<body><nav>menu</nav><div {}>{}</div><div class=sidebar>short</div>", "<article><div {}>{}</div><div class=share>tell all</div></article>", "<body><div {}><div {}>{}</div><div class=comments><p>I like it, I really do.</p></div></div>"])
def test_a_name_does_not_drop_the_bulk_of_the_text(name, around):
    assert main_text(around.format(*[name] * (around.count("{}") - 1), BODY)) == WANT


def test_a_long_advert_beside_an_article_stays_out():
    assert main_text(f"<body><div class=ad>{'buy this now ' * 200}</div><article>{BODY}</article>") == WANT


@pytest.mark.parametrize("around", ["<body><div id=content>{}</div><div class=comments>{}</div>", "<article>{}<section id=comments>{}</section></article>"])
def test_long_replies_stay_out(around):
    replies = "".join(f"<p>Reply {i} by a reader who has much to say on this story.</p>" for i in range(50))
    assert main_text(around.format(BODY, replies)) == WANT


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p title=it's>first text</p><p>second</p>", "first text\nsecond"),
        ('<a href="x"y">link</a><p>one</p><p class="k">two</p>', "link\none\ntwo"),
        ("<p title=it's>one</p><p title='a > b'>two</p>", "one\ntwo"),
        ('<p>one</p><p title="never closed>two</p><p>three</p>', "one\ntwo\nthree"),
        ('<p title = "a > b" data-x==">one</p>', "one"),
        ('<p><a href=/x?q="y>link</a> one</p><p class="k">two</p>', "link one\ntwo"),
        ('<p "=>one</p><p>two</p>', "one\ntwo"),
    ],
)
def test_stray_quotes(page, want):
    assert main_text(page) == want


def test_many_stray_quotes_take_linear_time():
    page = "<p title='" + "<b a=\"x " * 20_000 + ">one</p>"
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 5


def test_every_article_of_a_table(sf_dir):
    """Brute force for pages whose article is plain: regular expressions over the markup."""
    for page_id, page in duckdb.sql(f"SELECT page_id, html FROM '{sf_dir}/pages.parquet'").fetchall():
        start = page.find("<article>")
        if start < 0:
            continue
        part = page[start + 9 :].split("</article>")[0]
        part = re.sub(r"<[^>]*$", "", part)
        part = re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:h1|p)>", "\0", part))
        want = "\n".join(b for b in (" ".join(html.unescape(x).split()) for x in part.split("\0")) if b)
        assert main_text(page) == want, page_id


def test_density_finds_the_story_without_hints():
    links = "<div>" + "".join(f"<a href={i}>a link of some words {i}</a> " for i in range(30)) + "</div>"
    story = "<div>" + "".join(f"<p>Sentence {i} of a story that goes on and on, with plain words and no links.</p>" for i in range(8)) + "</div>"
    text = main_text(f"<body>{links}<div>{story}</div>{links}")
    assert text.startswith("Sentence 0") and text.count("\n") == 7 and "link of" not in text
    page = Page(f"<body>{links}{story}")
    density, total = page.densities(page.gone())
    assert len(density) == len(total) == len(page.tag)


def test_rows(spark):
    rows = [(1, "u", f"<article>{BODY}</article>"), (1, "u", f"<article>{BODY}</article>"), (2, None, None), (None, "v", ""), (3, "w", "<div>" * 3000 + "deep"), (4, "x", "<article><p>" + "word " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "'q' as n_chars")
    out = extract(df).collect()
    assert [(r.page_id, r.n_chars) for r in out if r.page_id in (1, 2, None)] == [(1, len(WANT))] * 2 + [(2, 0), (None, 0)]
    assert {r.page_id: r.text for r in out}[3] == "deep" and {r.page_id: r.n_chars for r in out}[4] == 499_999
    assert extract(df.limit(0)).count() == 0
