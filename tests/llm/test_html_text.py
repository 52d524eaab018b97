from feedlake.llm.html_text import extract_text, main_text

LONG = "The story of the river and of the people that live by it is long, and it was told in this town for many years by those who knew it best. "


def test_article_alone_stays():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body>"
        "<header>Site</header><nav><ul><li><a href=/a>a</a></ul></nav><!-- <p>gone</p> --><div class='ad'>Buy now.</div>"
        "<aside>See also</aside><article><h1>Head &amp; tail</h1><p>One<b>bold</b>\n  two&nbsp;&#233;&lt;x&gt;<p>Short.<br>line"
        "<form><input><p>Mail</form><div id='comments'><p>I like it</p></div></article><div class=cookie-notice>Cookies</div>"
        "<footer>&copy; x</footer></body></html>"
    )
    assert main_text(page) == "Head & tail\nOnebold two é<x>\nShort. line"


def test_rules_without_article():
    link = "<p><a href=1>The best of the web and of the world in a long line of links that is made of words</a></p>"
    page = f"<body><p>Menu</p>{link}<h2>Rivers</h2><p>{LONG * 2}</p><p>Be.</p><p>{LONG * 2}</p>{link}<p>Legal</p>"
    assert main_text(page) == f"Rivers\n{(LONG * 2).strip()}\nBe.\n{(LONG * 2).strip()}"


def test_teaser_articles_do_not_hide_the_story():
    story = "".join(f"<p>{LONG * 2}</p>" for _ in range(3))
    cards = "<article class=card><h3>Boats</h3><p>Ten boats.</p></article>" * 3
    want = "\n".join([(LONG * 2).strip()] * 3)
    page = f"<body><nav><a href=/>Home</a></nav><div id=content><h1>Rivers</h1>{story}</div><nav><a href=/>More</a></nav>{cards}</body>"
    assert main_text(page) == f"Rivers\n{want}"


def test_names_and_tags_are_evidence():
    story, want = f"<p>{LONG * 2}</p><p>Be.</p><p>{LONG * 2}</p>", f"{(LONG * 2).strip()}\nBe.\n{(LONG * 2).strip()}"
    for box in ("div class=content-with-sidebar", "div id=header-and-page", "form id=aspnetForm", "aside"):
        end = box.split()[0]
        assert main_text(f"<{box}>{story}</{end}><div class=ad>Buy now.</div>") == want, box
        assert main_text(f"<{box}><article>{story}</article></{end}><footer>Legal</footer>") == want, box
    # Believed: what they hold is a small part of the page's text.
    said = f"<div class=comments><h2>Said</h2><p>{LONG * 2}</p></div>"
    assert main_text(f"<article>{story * 3}</article>{said}") == "\n".join([want] * 3)
    assert main_text(f"<article>{story * 3}{said}</article>") == "\n".join([want] * 3)
    assert main_text(f"<article>{story}</article><div hidden><p>{LONG * 9}</p></div>") == want
    # Text beside an article is still read.
    assert main_text(f"<article>{story}</article><div><p>{LONG * 3}</p></div>") == f"{want}\n{(LONG * 3).strip()}"


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<") == ""
    assert main_text("<nav><p>a</nav>") == ""
    assert main_text("<article><p>cut &am") == "cut &am"
    assert main_text("<article><p>text<script>var x = '") == "text"
    assert main_text("<article><p>a</b></i></div>c<p") == "a\nc" or main_text("<article><p>a</b></i></div>c<p").startswith("a")


def test_open_head_and_links():
    story, want = f"<p>{LONG * 2}</p>" * 2, "\n".join([(LONG * 2).strip()] * 2)
    for head in (
        "<head><title>T</title><body>", "<html><head><meta charset=utf-8><title>T</title>", "<head><title>T<body>",
        "<head><noscript><img src=x><body>", "<head><link rel=x><script>var a = '<p>';</script><div>", "<head><title>T<div>",
        "<head><style>p{}</style></head><body>",
    ):
        assert main_text(head + story) == want, head
    assert main_text(f"<head><title>T</title>{LONG * 2}") == (LONG * 2).strip()
    for link in (
        "<p><a href=/>Home</p>", "<p><a href=/>Home<p>", "<div><a href=/>Home</div>", "<a href=/>Home", "<a name=top>",
        "<div><a href=/>Home<p><a href=/b>Back",
    ):
        assert main_text(f"<body>{link}{story}") == want, link
    # A link around blocks that does end holds them all.
    assert main_text(f"<body><a href=/><div>Home</div>{story}</a>{story}") == want


def test_rows(spark):
    big = "<article>" + "<p>word " * 20_000
    rows = [(1, "u", None), (2, None, "<article><p>x"), (2, None, "<article><p>x"), (None, "v", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "7 AS text", "8 AS other")
    got = extract_text(pages)
    assert got.columns == ["page_id", "url", "other", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.n_chars) for r in got.collect()) == [(0, 5 * 20_000 - 1), (1, 0), (2, 1), (2, 1)]
    assert extract_text(pages.where("page_id > 9")).count() == 0


def test_all_article_paragraphs_of_the_table(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = {r.page_id: r.text for r in extract_text(pages).collect()}
    for page in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", page.html, re.S)[1]
        parts = [html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", p))) for p in re.split(r"</?(?:p|h1)>", inner)]
        parts = [re.sub(r"\s+", " ", p).strip() for p in parts]
        assert texts[page.page_id] == "\n".join(p for p in parts if p)
