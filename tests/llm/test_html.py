"""Gold texts of pages laid out in many ways, and the query's rows against the same function applied page by page."""

import itertools
import random

import pytest

from sparkquarry.llm import html_extract
from sparkquarry.llm.queries import op9_html_extraction

LONG = "A sentence, with marks and words enough to be text. Another one follows, as it does in articles."
COMMENTS = f"<article class='comment'><p>{LONG * 3}</p></article>"
LAYOUTS = {
    "remark in a class": (f'<body><div class="content has-sidebar"><h2>T</h2><p>{LONG}</p></div><div class="sidebar"><p>Side, text.</p></div></body>', f"T\n{LONG}"),
    "article named after tags": (f'<body><nav><a>x</a></nav><article class="post tags-ai"><h1>T</h1><p>{LONG}</p></article></body>', f"T\n{LONG}"),
    "entry header": (f'<body><article><div class="entry-header"><h1>T</h1></div><p>{LONG}</p></article></body>', f"T\n{LONG}"),
    "entry header, no article": (f'<body><div class=post><div class="entry-header"><h1>T</h1></div><p>{LONG}</p></div></body>', f"T\n{LONG}"),
    "header of page and article": (f"<body><header><p>Site, of names.</p></header><article><header><h1>T</h1></header><p>{LONG}</p></article></body>", f"T\n{LONG}"),
    "longer comments": (f'<body><article><h1>T</h1><p>{LONG}</p></article><div id="comments">{COMMENTS}</div></body>', f"T\n{LONG}"),
    "comments inside": (f'<body><article><h1>T</h1><p>{LONG}</p><section class="post-comments">{COMMENTS}</section></article></body>', f"T\n{LONG}"),
    "advert": (f'<body><div class="ad">Buy, now. {LONG}</div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></body>', f"T\n{LONG}\n{LONG}"),
    "odd quotes": (f'<body><article><h1 data-x=">">T</h1><p title="5" tall">{LONG}</p><p title=a"b>{LONG}</p><a href=\'x"\'>y</a></article></body>', f"T\n{LONG}\n{LONG}\ny"),
    "names that begin or end like others": (f'<body><article><h1>T</h1><div class="share-price"><p>{LONG}</p></div><p class="header">{LONG}</p><div class="banner-ads-history"><p>{LONG}</p></div></article></body>', "\n".join(["T", *[LONG] * 3])),
    "names outside of an article": (f'<body><div class="cookie-recipes"><h2>T</h2><p>{LONG}</p><p>{LONG}</p></div><div class="cookie-notice"><p>{LONG}</p></div></body>', f"T\n{LONG}\n{LONG}"),
    "names inside of an article": (f'<body><article><h1>T</h1><p>{LONG}</p><div class="share-buttons">Share it</div><ul class="tags"><li>a</li></ul><p>{LONG}</p></article></body>', f"T\n{LONG}\n{LONG}"),
    "comments by heading": (f'<body><article><h1>T</h1><p>{LONG}</p><div><h3>3 Comments</h3><p>{LONG}</p><div><p>{LONG}</p></div></div></article></body>', f"T\n{LONG}"),
    "comments by heading, then more": (f'<body><article><h1>T</h1><p>{LONG}</p><h2>Comments (2)</h2><h3>a</h3><p>{LONG}</p><h2>More</h2><p>{LONG}</p></article></body>', f"T\n{LONG}\nMore\n{LONG}"),
    "unclosed": (f"<body><div id=c><h1>T<p>{LONG}<ul><li>a<li>b</ul><p>{LONG}", f"T\n{LONG}\na\nb\n{LONG}"),
    "none": ("<body><nav><a>x</a></nav><div class=cookie-banner>We use cookies, many.</div><footer>c</footer></body>", ""),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, want = LAYOUTS[name]
    assert html_extract.main_text(page) == want


def made(draw: random.Random) -> tuple[str, str]:
    """A page of random parts around an article, with and without its tag, and the article's text."""

    def sentence():
        return " ".join(draw.choices(["lorem", "ipsum", "dolor", "sit", "amet", "&amp;", "elit"], k=draw.randrange(6, 20))).capitalize() + draw.choice(".!?")

    def paragraph():
        return f"{sentence()} {sentence()}, {sentence()}"

    open_, close = draw.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div class=story>", "</div>"), ("<main><article class=a>", "</article></main>")])
    parts = [("h1", sentence())] + [("p", paragraph()) for _ in range(draw.randrange(3, 9))]
    body = "".join(f"<{tag}>{text}" + draw.choice(["", f"</{tag}>"] if tag == "p" else [f"</{tag}>"]) for tag, text in parts)
    extras = [
        "<nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav>", f"<aside><p>{paragraph()}</p></aside>", f"<div class=ad>{paragraph()}</div>", f"<form><p>{sentence()}</p></form>",
        f"<div id=cookie-notice>{sentence()}</div>", "<script>if (a<b) c('</p>')</script>", f"<div class=sidebar-left><p>{paragraph()}</p></div>",
    ]
    draw.shuffle(extras)
    n = draw.randrange(len(extras))
    page = f"<html><head><title>x</title></head><body>{''.join(extras[:n])}{open_}{body}{close}<section class=comments><p>{paragraph()}</p></section>{''.join(extras[n:])}<footer>{sentence()}</footer></body></html>"
    return page, "\n".join(text.replace("&amp;", "&") for _, text in parts)


def test_made_pages():
    for i in range(300):
        page, want = made(random.Random(i))
        assert html_extract.main_text(page) == want, page


def test_rows(spark):
    long = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    rows = [(1, "u", LAYOUTS["entry header"][0]), (1, "u", LAYOUTS["entry header"][0]), (2, None, None), (None, "v", ""), (3, "w", long)]
    pages = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, url string, html string, text string, id string, n_chars int")
    got = html_extract.extract_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(i, u, html_extract.main_text(h or "")) for i, u, h in rows]
    key = lambda r: (r[0] or 0, r[1] or "")
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(((i, u, t, len(t)) for i, u, t in want), key=key)
    assert max(len(t) for *_, t in want) == 20_000 * (len(LONG) + 1) - 1
    assert html_extract.extract_text(pages.limit(0)).count() == 0


def test_query_finds_the_paragraphs_of_the_pages(spark):
    """The pages' articles are their article elements; their text by a plain parser of the standard library."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        BREAKS = ("p", "h1", "h2", "h3", "li", "ul", "ol", "div", "blockquote", "pre", "section", "article", "table", "tr", "td")
        INLINE_OUT = ("script", "style", "nav", "footer", "form", "aside", "header")

        def __init__(self):
            super().__init__()
            self.depth, self.out, self.lines = 0, 0, [""]

        def handle_starttag(self, tag, attrs):
            self.depth += tag in ("article", "main")
            if self.out or tag in self.INLINE_OUT or dict(attrs).get("class") in ("ad", "comments"):
                self.out += tag not in ("br", "img", "input", "hr", "p", "li")
            if tag in self.BREAKS:
                self.lines.append("")
            if tag == "br":
                self.lines[-1] += " "

        def handle_endtag(self, tag):
            self.depth -= tag in ("article", "main")
            self.out = max(0, self.out - (tag not in ("br", "img", "input", "hr", "p", "li")))
            if tag in self.BREAKS:
                self.lines.append("")

        def handle_data(self, data):
            if self.depth and not self.out:
                self.lines[-1] += data

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = {r["page_id"]: r for r in op9_html_extraction(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        plain = Plain()
        plain.feed(page or "")
        lines = [" ".join(x.split()) for x in plain.lines]
        assert got[i]["text"] == "\n".join(x for x in lines if x), page
        assert got[i]["n_chars"] == len(got[i]["text"])


def test_paths_are_scored_and_thresholded():
    rows = [(("a",), 400, 8, 0)] * 3 + [(("b",), 20, 0, 20)] * 9 + [(("a",), 300, 5, 10)]
    scores = html_extract.path_scores(rows)
    assert scores[("a",)] > scores[("b",)]
    assert list(itertools.islice(scores, 2)) == [("a",), ("b",)]


def test_time_is_linear_in_depth():
    import time

    deep = lambda n: "<div class=a>word, " * n + "</div>" * n
    html_extract.main_text(deep(500))
    began = time.process_time()
    assert html_extract.main_text(deep(20_000)).count("word") == 20_000
    assert time.process_time() - began < 5
    inline = "<article>" + "<p>" + "<b>x</i></b></span>, " * 50_000 + "</article>"
    assert html_extract.main_text(inline).count("x") == 50_000
    assert time.process_time() - began < 10
