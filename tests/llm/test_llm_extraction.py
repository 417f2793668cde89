"""Pages whose wrappers look like menus, and articles of several parts."""

from __future__ import annotations

import time

import pytest

from slicewise.llm.extraction import main_text

P = "Paragraph {}, with commas, and a fair length so that it counts for something here."
LONG = "".join(f"<p>{P.format(i)}</p>" for i in range(30))
WANT = [P.format(i) for i in range(30)]
SHORT = ["A short section, of one paragraph.", "Another short one, with some words."]


@pytest.mark.parametrize("start", [
    '<div class="layout has-sidebar">', '<div class="no-sidebar">', '<div class="menu-open">', '<div class="content share-enabled">', "<form action=x>",
    '<div class="page-widget">', '<div id=nav-wrapper>'])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<div>{}</div>", "{}"])
def test_wrapper_is_not_cut(start, inner):
    end = "</form>" if "form" in start else "</div>"
    page = f"<body>{start}<nav><a href=x>Home</a></nav>{inner.format(LONG)}<div class=sidebar><p>Links, more, and more.</p></div>{end}<footer>F, f.</footer></body>"
    assert main_text(page).split("\n\n") == WANT


def test_comments_beside_an_article_stay_cut():
    replies = "".join(f"<article><p>{P.format(i)}</p></article>" for i in range(20, 40))
    page = f"<body><article>{LONG}</article><div class=comments>{replies}</div><aside><article><p>More, here.</p></article></aside></body>"
    assert main_text(page).split("\n\n") == WANT


def test_short_sections():
    a, b = (f"<div class=section><p>{t}</p></div>" for t in SHORT)
    big = f"<div class=section>{LONG}</div>"
    assert main_text(f"<body><div>{a}{big}{b}</div></body>").split("\n\n") == [SHORT[0], *WANT, SHORT[1]]
    assert main_text(f"<body><nav>n</nav><div>{big}{a}{b}</div></body>").split("\n\n") == [*WANT, *SHORT]


def test_siblings_between_and_loose_text():
    page = f"<body><div><h2>Head</h2><div class=x>{SHORT[0]}</div><div>{LONG}</div>Loose <b>text</b> here.<ul><li><a href=x>link</a></ul><p>{P.format(99)}</p></div></body>"
    assert main_text(page).split("\n\n") == ["Head", SHORT[0], *WANT, "Loose text here.", P.format(99)]


def test_sibling_articles():
    page = f"<body><nav>n</nav><article><p>{SHORT[0]}</p></article><article>{LONG}</article><article><p>{SHORT[1]}</p></article><footer>f</footer></body>"
    assert main_text(page).split("\n\n") == [SHORT[0], *WANT, SHORT[1]]


MENU = "<ul class=links><li><a href=a>Alpha page</a></li><li><a href=b>Beta page</a></li><li><a href=c>Gamma</a></li></ul>"


@pytest.mark.parametrize("page,want", [
    (f"<body><div class=posts><div><p>{WANT[0]}</p><p>{WANT[1]}</p></div>{MENU}<div><p>{WANT[2]}</p></div></div></body>", WANT[:3]),
    (f"<article>{LONG}{MENU}<p>{P.format(77)}</p></article>", [*WANT, P.format(77)]),
    (f"<article><p>{WANT[0]}</p><ul><li>One item, with a <a href=x>link</a> in it</li><li>Two</li></ul></article>", [WANT[0], "One item, with a link in it", "Two"]),
    (f"<article><h2 class='widget-title'>Section heading</h2>{LONG}</article>", ["Section heading", *WANT]),
    (f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1><p>A lead.</p></header>{LONG}</article></body>", ["Title", "A lead.", *WANT]),
    (f"<article><header><a href=x>Home</a></header>{LONG}</article>", WANT),
    (f"<article><header class=masthead><h1>Site</h1></header>{LONG}</article>", WANT),
    (f"<article>{LONG}<p hidden>Not shown.</p><div style='color:red; display: none'>Nor this.</div></article>", WANT),
    (f"<article>{LONG}<p title='not hidden here'>Shown, and read.</p></article>", [*WANT, "Shown, and read."]),
    (f"<article>{LONG}<p>Press the <label>red</label> key.</p><label>Mail</label></article>", [*WANT, "Press the red key."]),
    (f"<body>{MENU}</body>", ["Alpha page", "Beta page", "Gamma"]),
])
def test_parts_inside_the_article(page, want):
    assert main_text(page).split("\n\n") == want


DEEP = 40_000


@pytest.mark.parametrize("page", [
    "<div>" * DEEP + "<p>x" * DEEP, "<i>" * DEEP + "</x>" * DEEP * 5, "<p><button>" + "<i>" * DEEP + "<hr>" * DEEP, "<blockquote>" * DEEP,
    "<div class=nav>" * DEEP + "text, of some length", "<table>" + "<tr><td>" * DEEP, "<article>" + "<header>" * DEEP + "<h1>x</h1>",
    "<div><p>a, b</p>" + "<div>" * DEEP + "</div>" * DEEP + "<div>" + "<blockquote>" * DEEP])
def test_deep_pages_take_linear_time(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 15  # about one second; quadratic ways take many minutes


def test_end_tags_close_what_is_open():
    page = "<article><p>one<div>two<i>b</div>three</i></x></p>four<table><tr><td>c1<td>c2<tr><td>c3</table><ul><li>l1<ul><li>l2</ul><li>l3</ul></article>"
    assert main_text(page).split("\n\n") == ["one", "twob", "three", "four", "c1", "c2", "c3", "l1", "l2", "l3"]
