"""Blocks of pages against a slow walk over a tree that the parser of the standard library helps to build."""

import random
from html.parser import HTMLParser

import pytest

from concord.llm import html

ARTICLE = ("The rivers of the north are long and they run to the sea in the winter, as it was said by all of them. " * 4)[:410]


class Tree(HTMLParser):
    """Nodes are [name, attributes, children]; texts are strings. Optional end tags are put in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", "", []]
        self.open = [self.root]

    def handle_starttag(self, name, attrs):
        if self.open[-1][0] in html.DROPPED:
            return
        if name not in html.INLINE:
            k = len(self.open) - 1
            while k and self.open[k][0] in html.INLINE:
                k -= 1
            top = self.open[k][0]
            if top == "p" or name in html.ENDED_BY.get(top, ()):
                del self.open[k:]
        node = [name, self.get_starttag_text()[1 + len(name) : -1], []]
        self.open[-1][2].append(node)
        if name not in html.VOID:
            self.open.append(node)

    def handle_startendtag(self, name, attrs):
        self.handle_starttag(name, attrs)
        if name == "svg" and self.open[-1][0] == "svg":
            self.open.pop()

    def handle_endtag(self, name):
        inside = self.open[-1][0] in html.DROPPED
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == name:
                del self.open[k:]
                return
            if inside:
                return

    def handle_data(self, data):
        if self.open[-1][0] not in html.DROPPED:
            self.open[-1][2].append(data)


def walked(page):
    """`text, heading, aside, in an article` of the blocks."""
    tree = Tree()
    tree.feed(page)
    tree.close()
    found, run = [], []

    def close():
        text = " ".join("".join(x for x, _ in run).split())
        if text:
            found.append((text, *next(state for x, state in run if x.strip())))
        run.clear()

    def walk(node, heading, aside, article):
        for child in node[2]:
            if isinstance(child, str):
                run.append((child, (heading, aside, article)))
                continue
            name, attributes = child[0], child[1]
            marked = bool(attributes) and name not in html.WHOLE and html._is_aside(attributes)
            if name in html.INLINE and not marked:
                if name == "br":
                    run.append((" ", (heading, aside, article)))
                walk(child, heading, aside, article)
                continue
            close()
            if name not in html.DROPPED:
                outside = name in html.ASIDE or name == "header" and not article
                walk(child, heading or name in html.HEADING, aside or outside or marked, article or name in html.MAIN)
            close()

    walk(tree.root, False, False, False)
    close()
    return found


def as_walked(page):
    return [(b.text, b.heading, b.aside, b.main > 0) for b in html.blocks(page)[0]]


def test_blocks_of_all_pages(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    assert pages
    for page in pages:
        if page:
            assert as_walked(page) == walked(page)


def test_blocks_of_made_pages_without_end_tags():
    random.seed(21)
    text = lambda: random.choice(["some text &amp; more", "a  b", "x", "The line\nof it", ""])

    def element(depth):
        if depth == 0:
            return text()
        inner = lambda: "".join(element(depth - 1) for _ in range(random.randint(1, 3)))
        kind = random.randint(0, 9)
        mark = random.choice(["", "", "", ' class="sidebar"', " id=nav", " hidden"])
        if kind == 0:
            return f"<p{mark}>{text()}" + random.choice(["", "</p>"])
        if kind == 1:
            return "<ul>" + "".join(f"<li{mark}>{inner()}" + random.choice(["", "</li>"]) for _ in range(2)) + "</ul>"
        if kind == 2:
            return f"<table><tr><td{mark}>{text()}<td>{text()}<tr><th>{text()}</table>"
        if kind == 3:
            return f"<dl><dt>{text()}<dd{mark}>{text()}<dt>{text()}</dl>"
        if kind == 4:
            return random.choice(["<script src=/x/>var a='<p>';</script>", "<style>p{}</style>", "<!-- <nav> -->", "<br>", "<hr>", "<svg/>"])
        if kind == 5:
            return f"<b>{text()}</b> {text()}"
        name = random.choice(["div", "section", "article", "nav", "header", "footer", "aside", "h2", "main"])
        return f"<{name}{mark}>{inner()}</{name}>"

    for _ in range(400):
        head = random.choice(["", "<head><title>t</title>", "<html lang=en><head><meta charset=x></head>", '<body class="page sidebar">'])
        page = head + "".join(element(random.randint(0, 3)) for _ in range(4))
        assert as_walked(page) == walked(page), page


@pytest.mark.parametrize(
    "start",
    [
        "<html><head><title>x</title>",
        "<head><meta charset=x>",
        '<html><head></head><body class="single comments-open has-sidebar">',
        '<body class="page sidebar">',
        "<script src=/x/>var leaked=1;</script>",
        '<p class="notice">Short notice<p>',
        "<svg/>",
    ],
)
def test_legal_pages_give_their_article(start):
    assert html.main_text(f"{start}<p>{ARTICLE}</p>") == ARTICLE
