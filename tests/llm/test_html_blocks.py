"""Reading broken and unusual pages, and labelling hand-marked pages of templates that were not trained on."""

import time

import pytest

from gleaner.llm import block_labeller
from gleaner.llm.html_blocks import blocks


def texts(page):
    return [b.text for b in blocks(page)]


@pytest.mark.parametrize("unit", ['<b"', "<a ", "<", "<a '\"", '<a ">" ', "<a \"'", "<script>", "<div>x", "<!--", "<!", "<p>", "</p>", "<svg><g>", "<li>x", "<td>", "&amp", "<title>a"])
def test_broken_pages_take_time_in_proportion(unit):
    began = time.time()
    blocks(unit * (1_000_000 // len(unit)))
    assert time.time() - began < 20


def test_odd_markup():
    assert texts("a<p>b<p title='>'>c</p>d") == ["a", "b", "c", "d"]
    assert texts('<p class="x>one</p><p>two') == ["one", "two"]  # a quote that never closes
    assert texts("<p>one</p><p>two<a href='") == ["one", "two"]  # a page that ends inside a tag
    assert texts("<p>1 < 2 and 3 > 2</p>") == ["1 < 2 and 3 > 2"]
    assert texts("<p>a<!-- b <p> --><!x><?y?>c") == ["ac"]
    assert texts("<script>if (a < b) x()</script><style>p{}</style><p>t<textarea>no</textarea>") == ["t"]
    assert texts("<p>a<script>x = 1;<p>b</p>") == ["a", "b"]  # never closed: up to the next tag
    assert texts("<title>t<p>kept</p>") == ["kept"]


def test_formulas_drawings_and_objects_are_text():
    page = "<p>Mass <math><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow></math> and <svg><title>no</title><text>label</text><path d='M0'/></svg> end <object data=x>fallback</object>.</p><noscript>enable it</noscript>"
    assert texts(page) == ["Mass E=m and label end fallback.", "enable it"]


# Hand-made pages; the blocks that begin with * are their main text.
TEMPLATES = [
    ("<table><tr><td class=navbar>{}</td><td class=main><h1>{}</h1><p>{}</p><p>{}</p></td></tr></table><div id=bottom>{}</div>",
     ["Start Archive Imprint Links", "*The bridge over the northern arm reopens", "*After eleven months of work the old bridge carries traffic again, and the council says that the last of the scaffolding will be gone before the winter.", "*Engineers replaced forty bearings and every joint of the deck. The cost rose twice, first for steel, then for a crack that nobody had drawn on any plan.", "All rights reserved. Contact us about cookies."]),
    ("<body><div class=topbar>{}</div><div role=main class=post><h2 class=headline>{}</h2><div>{}</div><blockquote>{}</blockquote><div>{}</div></div><div class=related>{}</div><div class='comment-list'><p>{}</p></div></body>",
     ["Sign in Subscribe Search", "*How bees choose a home", "*A swarm that leaves its hive hangs for a day or two from a branch while its scouts look at hollow trees, chimneys and boxes for many kilometres around.", "*Each scout dances for the place that she has seen, and the better it was, the longer she dances.", "*When enough scouts stand at one entrance at the same time, the swarm takes wing. No bee has seen more than a few of the places, and yet it mostly picks the best.", "You may also like: ten facts about honey", "Great read!! thanks for sharing, greetings from Jane"]),
    ("<nav><a href=/>{}</a><a href=/b>{}</a></nav><main><article><header><h1>{}</h1></header><section><p>{}</p><ul><li>{}</li><li>{}</li></ul></section></article><aside>{}</aside></main><footer>{}</footer>",
     ["Home", "News", "*Packing for a week in the hills", "*Take less than you think you need. A rucksack that weighs more than a sixth of its bearer makes every slope longer, and what you lack can be bought in the valley.", "*two shirts of wool, which dry over night and smell less than cotton", "*a map on paper, because batteries fail when it is cold", "Advertisement: boots for every season, free delivery", "Privacy policy Terms of use Newsletter"]),
    ("<div class=wrapper><div class=menu><ul><li><a href=1>{}</a></li><li><a href=2>{}</a></li></ul></div><div class=entry-content><p>{}</p><h3>{}</h3><p>{}</p></div><form><label>{}</label></form><div class=site-info>{}</div></div>",
     ["About", "Categories", "*The first clocks in towers had no hands. They struck the hours, and whoever wanted to know more had to wait or to ask the guard.", "*From bells to dials", "*A hand for the hours came first, and for three hundred years that was enough. The second hand was made for astronomers and for physicians who counted the pulse.", "Leave your email address", "Powered by a theme, copyright 2019"]),
]


def test_templates_not_trained_on():
    labeller = block_labeller.load(block_labeller.packaged())
    right = said = true = 0
    for page, marked in TEMPLATES:
        (text,) = block_labeller.extract([page.format(*[m.lstrip("*") for m in marked])], labeller)
        want, got = {m[1:] for m in marked if m[0] == "*"}, set(text.split("\n")) - {""}
        right, said, true = right + len(want & got), said + len(got), true + len(want)
    print(f"precision {right}/{said}, recall {right}/{true}")
    # Measured: all of 10 blocks right, 10 of 14 found; it misses headings and paragraphs of list-like pages.
    assert right >= 0.9 * said and right >= 0.7 * true
