import time
import html
import re

from laneward.llm.extract import main_text, main_texts


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


ARTICLE = "<h1>Head &amp; line</h1><p>First <b>bold</b>\n  text &eacute;&#33;</p><p>Second.<br>More</p>"
WANT = "Head & line\nFirst bold text é!\nSecond. More"


def test_article_without_its_surroundings():
    noise = (
        "<nav><ul><li><a href='/'>Home</a></ul></nav><header>Site</header><div class='cookie-notice'>We use cookies</div>"
        "<form><input value=x><button>Go</button></form><aside>Side</aside><!-- c -->"
    )
    tail = "<div id=comments><p>I disagree with all of this very long text</p></div><footer>&copy; x</footer><script>if (a<b) {}</script>"
    assert main_text(page(noise + f"<article>{ARTICLE}</article>" + tail)) == WANT
    assert main_text(page(noise + f"<main><section>{ARTICLE}<div class=ad>Buy</div></section></main>" + tail)) == WANT


def test_densest_subtree_without_landmarks():
    text = "word " * 60
    body = f"<div class=menu><a>x</a></div><div><h1>T</h1><p>{text}</p><p>short</p><p>{text}</p></div><div><a href=1>l</a> <a>m</a></div>"
    assert main_text(page(body)) == "\n".join(("T", text.strip(), "short", text.strip()))


def test_broken_markup():
    assert main_text(page("<article><p><b>one.<br><p>two</p><p>three</article>")) == "one.\ntwo\nthree"
    assert main_text("<body><article><p>cut off &am") == "cut off &am"
    assert main_text("<body><article><p>cut off</p><a href='x") == "cut off"
    assert main_text("a < b &lt; c") == "a < b < c"
    assert main_text("<div>" * 3000 + "deep") == "deep"
    for empty in (None, "", "<", "<p", "<script>a", "<!-- x", "</"):
        assert main_text(empty) in ("", "<", "</")
    assert len(main_text(page("<article><p>" + "x" * 300_000 + "</article>"))) == 300_000


def test_end_tags_left_out():
    head = "<!DOCTYPE html><html><head><meta charset=utf-8><title>T</title> <link href=x><style>p{}</style><script>1</script>\n"
    for start in ("<body>", "", "<div>"):
        assert main_text(f"{head}{start}<article>{ARTICLE}") == WANT
        assert main_text(f"{head}{start}<nav><a href=/>Home</a></nav><article>{ARTICLE}</article></body></html>") == WANT
    assert main_text(f"{head}Only <b>text</b>") == "Only text"
    assert main_text(f"{head}<p>one<p>two") == "one\ntwo"
    assert main_text(f"<head><title>T</title></head>{ARTICLE}") == WANT


def test_hints_keep_the_article():
    wrappers = ("with-sidebar", "has-sidebar", "no-comments", "no-ads", "content-sidebar-wrap", "sidebar", "comments", "promo banner")
    for hint in wrappers:
        for inner in (f"<article>{ARTICLE}</article>", f"<main>{ARTICLE}</main>", f"<main><article>{ARTICLE}</article></main>"):
            assert main_text(page(f"<div class='{hint}'><div>{inner}</div></div><p>Other</p>")) == WANT, hint
    for title in ("<header class='entry-header'>{}</header>", "<div class='article-header'>{}</div>", "<div class=header>{}</div>", "<div id=notice-1-a>{}</div>"):
        assert main_text(page("<article>" + title.format("<h1 class=banner id=comments>T</h1>") + "<p>Text</p></article>")) == "T\nText"
    for name in ("related-work", "social-history", "notice-of-appeal", "comments-on-the-draft"):
        assert main_text(page(f"<article><p>A</p><section id={name}><h2 id={name}>B</h2><p>C</p></section></article>")) == "A\nB\nC"
    assert main_text(page("""<article><p data-x='<i class="ad" '>A</p></article>""")) == "A"


def test_hints_still_drop():
    for hint in ("ad", "ad-slot-3", "cookie-notice", "site_footer", "comment-list", "related-posts", "share-buttons", "main-nav", "newsletter-signup"):
        assert main_text(page(f"<article>{ARTICLE}<div class='x {hint}'>Buy <b>now</b></div></article>")) == WANT, hint
    comment = "<article class=comment-body><p>I disagree with all of this very long text</p></article>"
    teaser = "<article><a href=1>Read more about this</a></article>"
    for other in (f"<div id=comments>{comment}{comment}</div>", f"<div id=comments>{teaser}{teaser}</div>", f"<div class=related>{teaser}{teaser}</div>"):
        assert main_text(page(f"<main><article>{ARTICLE}</article>{other}</main>")) == WANT
        assert main_text(page(f"<article>{ARTICLE}</article>{other}")) == WANT
    text = "word " * 60
    assert main_text(page(f"<div><p>{text}</p><p>{text}</p></div><div id=comments>{comment}{comment}</div>")) == f"{text.strip()}\n{text.strip()}"


def test_drawings_formulas_and_listings():
    for drawing in ("<svg viewBox='0 0 1 1'/>", "<svg><g/><svg><text>x</text></svg><text>y</text></svg>", "<svg><style/><title/><script/></svg>", "<svg><g>",
                    "<svg><foreignObject><p>x</p></foreignObject><text>y</text></svg>", "<math/>", "<template>a<template>b</template>c</template>"):
        assert main_text(page(f"<article>{drawing}{ARTICLE}</article>")) == WANT, drawing
    got = main_text(page("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p><object data=a><p>In &amp; out</p></object><xmp><b> &amp; </b></xmp>End</article>"))
    assert got == "So x=1 holds.\nIn & out\n<b> &amp; </b>\nEnd"
    text = "word " * 60
    formula = "<math><mrow>" + "<mi>x</mi><mo>+</mo>" * 60 + "</mrow></math>"
    body = f"<div><p>{text}</p><p>{text}{formula}</p><p>{text}</p></div><div><a href=1>l</a></div>"
    assert main_text(page(body)) == "\n".join((text.strip(), text + "x+" * 60, text.strip()))
    assert main_text("<body><article><p>a</p><xmp>b < c") == "a\nb < c"


def test_attribute_values_of_any_length():
    for size in (70_000, 3_000_000):
        for quote, other in ("\"'", "'\""):
            value = f"<p class={other}ad{other}>not text</p>" * (size // 20)
            assert main_text(page(f"<article><p data-x={quote}{value}{quote}>a</p><p>b</p></article>")) == "a\nb"


def test_all_pages_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    sources = {r.page_id: r.html for r in pages.collect()}
    got = main_texts(pages.withColumnRenamed("url", "text").selectExpr("page_id", "text AS url", "html", "1 AS text"))
    for r in got.collect():
        article = sources[r.page_id].partition("<article>")[2].partition("</article>")[0]
        blocks = re.split(r"</?(?:p|h1)>", article)
        lines = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in blocks]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


def test_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>x</p>"), (2, "u", "")]
    got = main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "x", 1), (1, "", 0), (1, "", 0), (2, "", 0)]
    assert main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LONG = "Words of a sentence that is long enough to be dense, and one more clause. " * 6


def test_all_articles_and_what_stands_beside_them():
    two = f"<body><nav><a href=x>menu</a></nav><article><p>{LONG}one</p></article><article><p>{LONG}two</p></article></body>"
    assert main_text(two).count("\n") == 1 and main_text(two).endswith("two")
    beside = f"<body><div><h1>Title</h1><p>Introduction.</p><article><p>{LONG}</p></article><p><a href=x>more links here</a></p></div></body>"
    assert main_text(beside) == f"Title\nIntroduction.\n{LONG.strip()}"


def test_hidden_text_and_notices():
    page = f"<article><p>{LONG}</p><p hidden>a</p><div style='color:red; Display : none'>b</div><p class='hidden-x' title='hidden'>c</p>{{}}</article>"
    assert main_text(page.format("")) == f"{LONG.strip()}\nc"
    for notice in ("<div class='usercomment'><p>d</p></div>", "<div class='alert alert-warning'>e</div>"):
        assert main_text(page.format(notice)) == f"{LONG.strip()}\nc"


def test_deep_pages_take_linear_time():
    began = time.process_time()
    deep = main_text("<article>" + "<font>" * 100_000 + LONG + "</b>" * 50_000 + "</article>")
    assert deep == LONG.strip() and time.process_time() - began < 4
