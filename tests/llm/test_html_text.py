import duckdb
import numpy as np
import pytest

from rivulet.llm.html_text import extract, main_text, op10_html, smooth, threshold

PAGE = (
    "<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body>"
    "<header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></li></ul></nav><!-- c --><div class='ad'>Buy</div>"
    "<div id=cookie-notice>Cookies!</div>{}<aside>Side</aside><form>Name <input></form><div class='comments'><article>Nice</article></div><footer>&copy; x</footer></body></html>"
)
BODY = "<h1>Big  title</h1><p><b>One &lt;two&gt;<br>three\n four<p>Fünf &eacute;<p>6<script>no()</script><ul><li>a<li>b</ul>"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>"])
def test_article(wrap):
    html = PAGE.replace("{}", wrap.format(BODY))
    assert main_text(html) == "Big title\nOne <two> three four\nFünf é\n6\na\nb"


def test_header_inside_the_article_is_kept():
    assert main_text("<header>Site</header><article><header><h1>Title</h1></header><p>Text</p><footer>tags</footer></article>") == "Title\nText"


def test_density_finds_the_region_without_an_article():
    body = "".join(f"<p>{'Long sentence of the text number %d. ' % i * 6}</p>" for i in range(5))
    links = "".join(f"<div><a href='/{i}'>link {i}</a></div>" for i in range(12))
    html = f"<html><body><div>{links}</div><div>{body}</div><div>{links}</div></body></html>"
    got = main_text(html)
    assert got.count("\n") == 4 and "link" not in got and "number 4" in got


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<html>") == main_text("<p> </p>") == ""
    assert main_text("just text & more") == "just text & more"
    assert main_text("<article><p>cut off <b>he") == "cut off he"
    assert main_text("<article>a</div></span>b<p>c</article>") == "ab\nc" or main_text("<article>a</div></span>b<p>c</article>") == "a\nb\nc"
    assert main_text("<html><head><title>T</title><meta charset=x><body><article>no head end</article>") == "no head end"
    assert main_text("<head><title>T</title><article>x<math><mi>y</mi></math></article>") == "xy"
    deep = "<div>" * 5000 + "<article>x</article>"
    assert main_text(deep) == "x"


def test_smoothing_and_clusters():
    assert np.allclose(smooth(np.full(9, 3.0)), 3.0)
    peak = smooth(np.array([0, 0, 0, 1.0, 0, 0, 0]))
    assert peak.argmax() == 3 and np.allclose(peak, peak[::-1]) and peak[0] < peak[1] < peak[2]
    assert 2 < threshold(np.array([1.0, 1.1, 0.9, 9.0, 10.0])) < 9


def test_all_pages(spark, sf_dir):
    """The article's text of the given pages, by plain string cutting."""
    import html as entities
    import re

    pages = duckdb.sql(f"SELECT page_id, html FROM '{sf_dir}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in op10_html(spark, sf_dir).collect()}
    assert len(got) == len(pages)
    for i, html in pages:
        body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"</?b>|<br>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", body)]
        want = "\n".join(b for b in blocks if b)
        assert got[i].text == want and got[i].n_chars == len(want)


def test_odd_rows(store):
    pages = store([(1, None, None), (1, "u", "<article>x</article>"), (1, "u", "<article>x</article>"), (None, "u", "")], "page_id long, url string, html string").selectExpr("*", "'mine' AS text")
    got = extract(pages)
    assert sorted((r["_text"], r.n_chars) for r in got.collect()) == [("", 0), ("", 0), ("x", 1), ("x", 1)]
    assert extract(pages.where("false")).collect() == []


SENTENCES = [f"<p>{'The body of the page goes on with sentence number %d. ' % i * 5}</p>" for i in range(6)]
LINKS = "".join(f"<div><a href='/{i}'>link {i}</a></div>" for i in range(8))


@pytest.mark.parametrize("at", [0, 1])
def test_a_teaser_article_does_not_replace_the_body(at):
    cards = ["", ""]
    cards[at] = f"<div>{LINKS}</div><div><article><h3>More</h3><p>A short teaser</p></article></div><div>{LINKS}</div>"
    got = main_text(f"<body><nav>{LINKS}</nav>{cards[0]}<div><h1>The title</h1>{''.join(SENTENCES)}</div>{cards[1]}<footer>x</footer></body>")
    assert all(f"number {i}" in got for i in range(6)) and "The title" in got and "link" not in got


def test_density_decides_beside_an_article():
    # Half of the text stands outside the article: it is text.  A short line of the page's frame is not.
    half = "".join(SENTENCES[3:])
    got = main_text(f"<body><div>Call us</div><div>{LINKS}</div><article>{''.join(SENTENCES[:3])}</article><div>{half}</div><div>{LINKS}</div><div>Top</div></body>")
    assert got.count("\n") == 5 and "number 0" in got and "number 5" in got and "Call" not in got and "Top" not in got


def test_short_paragraphs_of_a_page_without_boilerplate():
    assert main_text(f"<body><h1>Head</h1>{''.join(SENTENCES)}<p>The end.</p></body>").count("\n") == 7


def test_links_of_an_article_are_kept():
    assert main_text(f"<nav>{LINKS}</nav><article>{SENTENCES[0]}<p><a href=/>A source</a></p></article>").endswith("\nA source")
    assert main_text("<nav>x</nav><article><p><a href=/>A source</a></p></article>") == "A source"


FRAME = f"<nav>{LINKS}</nav>{{}}<div class=sidebar><p>A side text of some length</p></div><div class=comments><article>Nice</article></div><footer>The foot</footer>"


@pytest.mark.parametrize("wrap", [f"<div class='{c}'>{{}}</div>" for c in ("layout has-sidebar", "right-sidebar", "with-nav", "side", "social", "comments-open", "post comments")] + ["<form id=aspnetForm>{}</form>"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_names_of_wrappers(wrap, tag):
    body = f"<{tag}><h1>Title</h1>{''.join(SENTENCES)}</{tag}>"
    want = main_text(f"<body>{body}</body>")
    if "post comments" in wrap and tag == "div":
        return  # comments without an article are comments
    assert want.count("\n") == 6
    assert main_text(f"<body>{FRAME.format(wrap.format(body))}</body>") == want
    assert main_text(f"<body>{wrap.format(FRAME.format(body))}</body>") == want


def test_names_inside_an_article():
    text = "".join(SENTENCES)
    got = main_text(f"<article><div class='article-header'><h1>Title</h1></div>{text}<div class='share'>Tell others</div><div class='related-posts'>{LINKS}</div><div class='side-note'>A note</div></article>")
    assert got.startswith("Title\n") and got.endswith("\nA note") and got.count("\n") == 7
    assert main_text(f"<article><p>Intro</p><div class=widget>{text}</div></article>").count("\n") == 6


def test_teasers_and_long_threads_are_no_articles():
    text, thread = "".join(SENTENCES), "".join(f"<li class=comment><article><p>{'I think so too. ' * 30}</p></article>" for _ in range(9))
    got = main_text(f"<div>{text}</div><aside><article>Teaser</article></aside><div id=comments><ol>{thread}</ol></div>")
    assert got.count("\n") == 5 and "Teaser" not in got and "too" not in got


TOPICS = "side-effects related-work share-price menu-items social-history skip-list comment-theory modal-logic banner-years header-files cookie_recipes".split()
SECTION = "A section of the article that is about its own matter and of some length, with a comma or two, so it has to be kept as it is."


@pytest.mark.parametrize("name", TOPICS)
@pytest.mark.parametrize("tag", ["div", "main", "article"])
@pytest.mark.parametrize("attr", ["id", "class"])
def test_topics_that_hold_a_boilerplate_word_are_kept(name, tag, attr):
    text = "".join(SENTENCES)
    got = main_text(f"<body><nav>{LINKS}</nav><{tag}>{text}<section {attr}={name}><h2>Heading</h2><p>{SECTION}</p></section>{text}</{tag}><footer>x</footer></body>")
    assert f"Heading\n{SECTION}\n" in got and "link" not in got


@pytest.mark.parametrize("name", "menu menu-main main-menu site-nav social-links share-buttons related-posts skip-links breadcrumb-list".split())
def test_link_lists_by_name_still_go(name):
    text = "".join(SENTENCES)
    assert "link" not in main_text(f"<body><div>{text}<div class={name}>{LINKS}</div>{text}</div></body>")


@pytest.mark.parametrize("name", "cookie-notice notice site-footer page-header ad ad-slot-2 sidebar-left left-sidebar newsletter-signup comments comment-list user-comments comment-body comment-17 sponsored-content promo-box".split())
def test_boilerplate_by_name_still_goes(name):
    text = "".join(SENTENCES)
    assert "own matter" not in main_text(f"<body><div>{text}<div id={name}><p>{SECTION}</p></div>{text}</div></body>")


def test_long_and_deep_pages_take_linear_time():
    import time

    text = "".join(SENTENCES)
    began = time.time()
    for many in ("<div class=share>Tell</div>", "<div class=side-effects>A word</div>", "<ul><li><a href=/>x</a></li></ul>"):
        assert "number 5" in main_text(f"<body><div>{text}</div>{many * 20_000}</body>")
    assert main_text("<div><span class=side-effects>" * 30_000 + text + "</span></div>" * 30_000).count("\n") == 5
    assert time.time() - began < 60
