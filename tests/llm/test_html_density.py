"""Main text of pages: densities against their definition, furniture words, deep and broken pages."""

import math
import random
import time

import pytest

from shelfwise.llm import html_text as H

BODY = "<h1>Head line</h1>" + "".join(f"<p>Paragraph number {i} has some words to read and more of them.</p>" for i in range(6))
WANT = "Head line\n\n" + "\n\n".join(f"Paragraph number {i} has some words to read and more of them." for i in range(6))


@pytest.mark.parametrize("around", [
    '<div class="content-wrap menu-open">{}</div>', '<div class="with-sidebar">{}</div>', '<div class="page search">{}</div>',
    '<div class="post share">{}</div>', '<div class="post share"><article>{}</article></div>', "<main>{}</main>", "<article>{}</article>", "{}",
    '<div class="comments-open">{}</div>',
])
def test_furniture_words_on_the_element_that_holds_the_text(around):
    page = f"<html><body><nav><a href=x>one</a></nav><div class=ad>Buy this.</div>{around.format(BODY)}<div class='comments'><p>nice</p></div><footer>f</footer></body></html>"
    assert H.main_text(page) == WANT


def test_headline_of_an_article_and_a_second_article():
    page = "<body><article><div class='post-header'><h2>Deep head</h2></div><p>First text here is long enough to be read.</p></article><article><p>Second text here is long enough to be read.</p></article></body>"
    assert H.main_text(page).split("\n\n") == ["Deep head", "First text here is long enough to be read.", "Second text here is long enough to be read."]


def test_quotes_in_attributes():
    assert H.main_text("<body><p title=it's>one's text</p><p>it's two</p></body>") == "one's text\n\nit's two"
    assert H.main_text('<body><p title="a>b" class=\'c>d\'>text</p><p x="open>rest</p></body>').startswith("text")
    assert H.main_text("<p>a <math><mi>x</mi></math> b</p>") == "a x b"


def random_page(pick, depth=0):
    out = []
    for _ in range(pick.randrange(1, 4)):
        kind = pick.choice(["text", "p", "div", "a", "b", "ul"]) if depth < 5 else "text"
        words = " ".join(pick.choice(["word", "longer", "a", "text&amp;more"]) for _ in range(pick.randrange(9)))
        out.append(words if kind == "text" else f"<{kind}>{random_page(pick, depth + 1)}</{kind}>")
    return " ".join(out)


def below(node):
    return [c for c in node.children if isinstance(c, H.Node)]


def inner(node):
    return [x for c in below(node) for x in (c, *inner(c))]


def text(node):
    return "".join("".join(c.split()) if isinstance(c, str) else text(c) for c in node.children)


def links(node, inside=False):
    inside = inside or node.name == "a"
    return sum((len("".join(c.split())) if inside else 0) if isinstance(c, str) else links(c, inside) for c in node.children)


def test_densities_are_those_of_the_definition():
    pick = random.Random(2)
    for _ in range(120):
        root = H.parsed("<body>" + random_page(pick) + "</body>")
        nodes = H._nodes(root)
        H._measure(nodes)
        share = links(root) / max(1, len(text(root)))
        for node in nodes:
            c, t = len(text(node)), max(1, len(inner(node)))
            lc, lt = links(node), sum(x.name == "a" for x in inner(node))
            want = 0.0
            if c:
                base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
                want = c / t * math.log(max(c / max(1, lc) * t / max(1, lt), 1.0) + 1e-9) / math.log(max(base, 1.0) + 1.0)
            assert (node.chars, node.link_chars) == (c, lc)
            assert math.isclose(node.density, want, abs_tol=1e-12)
        for node in nodes:
            assert math.isclose(node.total, sum(x.density for x in below(node) if x.name in H._BLOCK), abs_tol=1e-9)


@pytest.mark.parametrize("page", [
    lambda n: "<div>" * n + "x", lambda n: "<div>" * n + "x" + "</b>" * n, lambda n: "<p><span>" * n + "x" + "</i><div>y</div>" * n,
    lambda n: "<ul><li>" * n + "x" + "<li>y" * n, lambda n: "<b>" * n + "x" + "</i>" * n + "</div>" * n,
])
def test_time_grows_with_the_page(page):
    took = []
    for n in (3000, 12000):
        start = time.process_time()
        assert "x" in H.main_text(page(n))
        took.append(time.process_time() - start)
    assert took[1] < 10 * max(took[0], 0.1)
