"""Main text of awkward pages."""

import pytest

from measureloom.llm import html_text
from measureloom.llm.html_text import extract, main_text

BODY = "<p>The first paragraph of the article is long enough to weigh more than what is around it.</p>" \
       "<p>The second one adds a <a href=x>link</a> &amp; goes on for a while, as paragraphs do.</p>"
TEXT = "The first paragraph of the article is long enough to weigh more than what is around it.\n" \
       "The second one adds a link & goes on for a while, as paragraphs do."


@pytest.mark.parametrize("page", [
    f"<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article>{BODY}</article><footer>&copy; me</footer></body></html>",
    f"<body><header><h1>Site</h1></header><div id=content>{BODY}</div><div class='sidebar'><p>Other things to read</p></div>",
    f"<div class='cookie-notice'>We use cookies</div><main>{BODY}<form><p>Send</p></form></main><script>var a='<p>x</p>'</script>",
    f"<div><div class=post>{BODY}<div id=comments><h2>Comments</h2><p>{'Nice words here. ' * 9}</p></div></div></div>",
    f"<article>{BODY.replace('</p>', '')}<aside><p>{'Related things. ' * 20}</p></aside></article>",
    f"<article><!-- ad --><style>p {{}}</style>{BODY}<div class=adBox-ad>Buy</div><noscript>no</noscript></article>",
    f"<ARTICLE>{BODY}</ARTICLE><div role=contentinfo>info</div>",
    f"<html><head><title>T</title></head><body class='nav-open'><article class='post sidebar-none'>{BODY}</article>",
])
def test_article_alone(page):
    assert main_text(page) == TEXT


def test_blocks_blanks_and_references():
    page = "<article><h1> A&nbsp;title\n here </h1><p>x<b>y</b>z<br>next &lt;tag&gt; &#233;&#x41; &unknown; &am</p><ul><li>one<li>two</ul>" \
           "<table><tr><td>l</td><td>r</td></table>tail</article>"
    assert main_text(page) == "A title here\nxyz next <tag> éA &unknown; &am\none\ntwo\nl\nr\ntail"


def test_pages_without_markup_or_text():
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<script>a") == main_text("<!-- x") == ""
    assert main_text("plain words") == "plain words"
    assert main_text("<nav>only</nav>") == ""


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + "<p>deep</p>") == "deep"
    assert main_text("<article>" + "<p>word</p>" * 50_000 + "</article>").count("\n") == 49_999


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", f"<article>{BODY}</article>", "x"), (1, None, None, "y"), (None, "v", "", "z")],
                               "page_id bigint, url string, html string, text string")
    got = sorted(map(str, (tuple(r) for r in extract(df).collect())))
    assert got == sorted(map(str, [(1, "u", TEXT, len(TEXT)), (1, None, "", 0), (None, "v", "", 0)]))
    assert extract(df.limit(0)).count() == 0


STORY = "".join(f"<p>Part {k} of the story goes on for a good while, with words enough to weigh on any scale of density.</p>" for k in range(12))
TEASER = "<p>" + "A teaser of another story, shorter than what it stands beside. " * 6 + "</p>"
LINKS = "<ul>" + "".join(f"<li><a href=/{k}>Place {k}</a></li>" for k in range(40)) + "</ul>"


def test_density_finds_the_article_without_names_or_article_elements(monkeypatch):
    page = f"<body><div>{LINKS}</div><div><div>{STORY}</div></div><div>{LINKS}</div></body>"
    assert main_text(page) == main_text(f"<body>{STORY}</body>")
    monkeypatch.setattr(html_text, "select", lambda body: [body])
    assert "Place 3" in main_text(page)


def test_the_story_stays_beside_an_article_element():
    assert "Part 11 of the story" in main_text(f"<body><div>{STORY}</div><article>{TEASER}</article></body>")


@pytest.mark.parametrize("name", ["social-history", "post notice-board", "content with-sidebar", "recommended", "cookie-recipes"])
def test_names_yield_to_text(name):
    assert main_text(f"<body><div class='{name}'>{STORY}</div><p>Short.</p></body>").startswith("Part 0 of the story")
    assert main_text(f"<body><div class='{name}'>{TEASER}</div><article>{STORY}</article></body>") == main_text(STORY)


@pytest.mark.parametrize("name", ["comments", "ad", "sponsored"])
def test_some_names_never_yield(name):
    assert main_text(f"<body><div class='{name}'>{STORY * 3}</div><div>{TEASER}</div></body>").startswith("A teaser")
    assert main_text(f"<body><div class='{name}'>{STORY}</div></body>") == ""


def test_densities_against_plain_code():
    """Counts, densities, sums and the best node of every subtree, each worked out from the subtree anew."""
    import math
    import random

    rng = random.Random(3)

    def part(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["words ", "more words here ", "<a href=x>a link</a>", "<b>bold</b> ", "<br>", "<img>"])
        tag = rng.choice(["div", "p", "section", "span", "ul", "a"])
        return f"<{tag}>" + "".join(part(depth - 1) for _ in range(rng.randrange(1, 5))) + f"</{tag}>"

    for _ in range(30):
        nodes, texts = html_text.parse("".join(part(5) for _ in range(4)))
        texts = html_text.settle(nodes, texts)
        html_text.measure(nodes)
        under = {}

        def walk(node):
            under[id(node)] = [node] + [y for c in node.children for y in walk(c)]
            return under[id(node)]

        walk(nodes[0])
        linked = lambda n: n is not None and (n.tag == "a" or linked(n.parent))
        size = lambda raw: len("".join(raw.split()))

        def counts(node):
            mine = {id(y) for y in under[id(node)]}
            inside = [(n, size(raw)) for n, _, raw in texts if id(n) in mine]
            below = under[id(node)][1:]
            return (sum(k for _, k in inside), len(below), sum(k for n, k in inside if linked(n)), sum(y.tag == "a" for y in below))

        whole = counts(nodes[0])
        share = whole[2] / whole[0] if whole[0] else 0.0

        def density(node):
            c, t, lc, lt = counts(node)
            if not c:
                return 0.0
            base = math.log(c / ((c - lc) or 1) * lc + share * c + math.e)
            return c / (t or 1) * math.log(max(c / (lc or 1) * (t or 1) / (lt or 1), 1.0)) / math.log(max(base, 1.0001))

        for node in nodes:
            assert (node.chars, node.tags, node.link_chars, node.link_tags) == counts(node)
            assert node.density == pytest.approx(density(node))
            assert node.total == pytest.approx(sum(density(c) for c in node.children))
            assert node.best.total == max(y.total for y in under[id(node)])


def test_time_grows_with_the_page_only():
    import time

    start = time.perf_counter()
    for page in ("<div>" * 8000 + "<p>x y z</p>" * 8000, "<div>" * 20_000 + "</x>" * 20_000, "<a>" * 10_000 + "<b>w</b>" * 10_000,
                 "<div class=social>" * 8000 + "words " * 8000):
        main_text(page)
    assert time.perf_counter() - start < 5
