"""Main text of whole tables against another reading of the markup, and pages that need the distribution."""

from html.parser import HTMLParser

import pytest

from spotflow.llm import html

BODY = "A sentence of the body of this page. " * 6
INLINE = {"b", "i", "em", "strong", "a", "span", "code", "small", "sub", "sup", "u"}


class Article(HTMLParser):
    """The text of article elements by the parser of the standard library: what is in headings and paragraphs,
    without scripts, styles, asides, forms, navigation and comments."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.apart = 0
        self.blocks = [""]

    def handle_starttag(self, tag, attrs):
        marks = dict(attrs).get("class") or ""
        if self.apart or tag in ("nav", "aside", "form", "footer", "script", "style") or marks in ("ad", "comments"):
            self.apart += tag not in ("br", "img", "hr", "input", "p", "li")
        if tag == "article":
            self.inside += 1
        if tag not in INLINE:
            self.blocks.append("")

    def handle_endtag(self, tag):
        if self.apart:
            self.apart -= tag not in ("p", "li")
        if tag == "article":
            self.inside -= 1
        if tag not in INLINE:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.apart:
            self.blocks[-1] += data

    def text(self):
        return " ".join(" ".join(b.split()) for b in self.blocks if b.strip())


def test_whole_table_equals_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).select("page_id", "text").collect()}
    wrong = []
    for r in pages.collect():
        p = Article()
        p.feed(r.html or "")
        p.close()
        if got[r.page_id] != p.text():
            wrong.append((r.page_id, got[r.page_id][:80], p.text()[:80]))
    assert len(got) == pages.count() and not wrong, wrong[:3]


def found(page):
    return html.main_lines(html.lines_of(page))


@pytest.mark.parametrize("name", ["social-impact", "comment-free", "has-sidebar", "promo-code-guide", "notice-period"])
def test_names_that_merely_contain_a_mark(name):
    assert found(f"<article><p>{BODY}</p><div class='{name}'><p>Kept.</p></div><p>{BODY}</p></article>") == [BODY.strip(), "Kept.", BODY.strip()]


@pytest.mark.parametrize("name", ["comments", "comments-section", "user-comments", "share-buttons", "ad-slot", "site-nav", "newsletter-signup", "related-posts", "cookie-banner", "sidebar", "commentList"])
def test_names_that_are_marks(name):
    assert found(f"<article><p>{BODY}</p><div class='{name}'><p>{BODY}</p></div></article><div id={name}><p>{BODY}</p></div>") == [BODY.strip()]


def test_short_paragraphs_between_surge_and_dive():
    page = f"<body><h1>Title</h1><p>{BODY}</p><p>Short.</p><p>Tiny.</p><p>Ok.</p><p>{BODY}</p></body>"
    assert found(page) == ["Title", BODY.strip(), "Short.", "Tiny.", "Ok.", BODY.strip()]


def test_whole_table_without_articles_gives_the_same_text(spark):
    """The article elements turned into plain containers: windows and containers alone find the same lines."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    wrong = []
    for r in pages:
        plain = (r.html or "").replace("<article>", "<div>").replace("</article>", "</div>")
        assert "<article" not in plain
        if found(plain) != found(r.html or ""):
            wrong.append(r.page_id)
    assert not wrong, (len(wrong), wrong[:5])


def blocks_by_hand(weights, window=3, surge=120, dive=25):
    """Lines between surge and dive, from the definition."""
    ahead = [sum(weights[i : i + window]) for i in range(len(weights))]
    out, on = [], False
    for i, w in enumerate(weights):
        on = ahead[i] > dive if on else bool(w) and ahead[i] >= surge
        out.append(on and w > 0)
    return out


def test_dense_lines_equal_the_definition():
    import random

    rng = random.Random(4)
    for _ in range(2000):
        weights = [rng.choice([0, 0, 5, 20, 60, 130, 400]) for _ in range(rng.randint(0, 14))]
        assert html._dense(weights) == blocks_by_hand(weights) if weights else True


LONG = " ".join(["word"] * 60)


@pytest.mark.parametrize("tag", ["article", "div", "section", "main"])
def test_the_same_rule_in_every_container(tag):
    def page(inner):
        return f"<body><div>Home About Contact</div><{tag}>{inner}</{tag}><div><p>Buy this now, it is very cheap and very good for you.</p></div></body>"

    assert found(page(f"<p>{LONG}</p><p>a</p>")) == [LONG, "a"]  # a last short paragraph
    assert found(page(f"<h1>Title</h1><p>b</p><p>{LONG}</p>")) == ["Title", "b", LONG]
    links = [f"Smith and others, A study of things, volume {i}" for i in range(4)]
    listed = "".join(f"<p><a href='#'>{t}</a></p>" for t in links)
    assert found(page(f"<p>{LONG}</p><h2>References</h2>{listed}")) == [LONG, "References", *links]
    menu = "".join(f"<p><a href='#'>More {i}</a></p>" for i in range(4))
    assert found(page(f"<p>{LONG}</p>{menu}")) == [LONG]
    assert found(page(f"<p>{LONG}</p>{menu}<p>{LONG}</p>")) == [LONG, *[f"More {i}" for i in range(4)], LONG]


def test_boxes_beside_the_text():
    side = "<div><p>A box with some words beside the text, of one line and a half or so, no more, to be left out.</p><p>And one more line of words in it.</p></div>"
    text = "".join(f"<p>{LONG}</p>" for _ in range(3))
    assert found(f"<body><div>Home About Contact</div>{side}<div>{text}</div>{side}</body>") == [LONG] * 3
    assert found(f"<body>{side}<article>{text}</article>{side}</body>") == [LONG] * 3
    assert found(f"<article><p>{LONG}</p></article><article><p>{LONG}</p></article>") == [LONG] * 2
    assert found(f"<body><div><p>{LONG}</p></div><div><p>{LONG}</p></div></body>") == [LONG] * 2


def test_a_teaser_in_an_article_does_not_hide_the_text():
    assert BODY.strip() in found(f"<article><p>teaser</p></article><div><p>{BODY}</p><p>{BODY}</p></div>")
