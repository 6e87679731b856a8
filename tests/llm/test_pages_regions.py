"""Main text that lies in several regions, in containers with telling class names, and behind unclosed elements."""

import pytest

from labelloom.llm import pages

A = "The first part has a sentence of some length, with enough words to be read as text."
B = "The second part has another sentence, a little shorter, that belongs to the text."
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>l{i}</a></li>" for i in range(12)) + "</ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div><p>{A}</p></div><div><p>{B}</p></div>",
        f"<body><section><h2>x</h2><p>{A}</p></section><section><p>{B}</p></section>",
        f"<table><tr><td>{A}</td><td>{B}</td></tr></table>",
        f"<table><tr><td>{A}<td>{B}</table>",
        f"<article><p>{A}</p></article><article><p>{B}</p></article>",
        f"<div class='content has-sidebar'><p>{A}</p><section id=related-work><p>{B}</p></section></div>",
        f"<div><p class=notice>hidden<p>{A}</p><p>{B}</p></div>",
        f"<ul><li class=share>hidden<li>{A}<li>{B}</ul>",
        f"<dl><dt class=ad>hidden<dd>{A}<dd>{B}</dl>",
        f"<table><tr><td class=menu>hidden<td>{A}<tr class=ad><td>hidden<tr><td>{B}</table>",
        f"<body><div class=x>{LINKS}</div><div><p>{A}</p></div><div><p>{B}</p></div><div>{LINKS}</div>",
    ],
)
def test_content_of_every_region(page):
    text = pages.main_text(page)
    assert A in text and B in text and "hidden" not in text and "l5" not in text


def test_short_parts_of_articles_stay():
    assert pages.main_text(f"<main><h1>T</h1><article><p>{A * 9}</p></article></main>") == f"T\n{A * 9}"
    assert pages.main_text(f"<article><p>{A * 9}</p></article><article><p>No.</p></article>") == f"{A * 9}\nNo."
    nested = f"<ul><li>{A}<ul><li>in<li>{B}</ul><li>out</ul>"
    assert pages.main_text(nested).split("\n") == [A, "in", B, "out"]


def test_class_names():
    for name in ("ad", "cookie-notice", "site-footer", "share_buttons", "comment-list"):
        assert pages.is_boilerplate("div", [("class", f"x {name}")], False)
    for name in ("has-sidebar", "related-work", "no-comments", "address", "top-left"):
        assert not pages.is_boilerplate("div", [("class", f"x {name}")], False)


@pytest.mark.parametrize(
    "name", ["comments-section", "user-comments", "ad-container", "cookie-wrapper", "main-nav", "nav", "comment-list-inner"]
)
def test_holders_of_boilerplate_inside_main(name):
    page = f"<main><h1>T</h1><p>{A}</p><div class='{name}'><p>hidden words of some length here</p></div><p>{B}</p></main>"
    assert pages.main_text(page) == f"T\n{A}\n{B}"
    assert pages.main_text(page.replace("class", "id")) == f"T\n{A}\n{B}"


def test_holders_alone_say_nothing():
    for name in ("section", "container", "main", "user", "wrapper", "content-wrapper", "main-content", "article-section"):
        assert pages.main_text(f"<main><div class='{name}'><p>{A}</p></div></main>") == A


def test_remarks_as_articles():
    page = f"<article class=post><p>{A}</p></article><article class='comment'><p>{B}</p></article><article id=reply><p>{B}</p></article>"
    assert pages.main_text(page) == A
    assert pages.main_text(f"<article class='notice header'><p>{A}</p></article>") == A


def test_forms():
    fields = "<label>hidden</label><p>hidden text of the form</p><button>hidden</button>"
    served = f"<body><form action=x><nav>hidden</nav><div><p>{A}</p><p>{B}</p></div><footer>hidden</footer></form>"
    assert pages.main_text(served) == f"{A}\n{B}"
    assert pages.main_text(f"<form><article><p>{A}</p><label>hidden</label></article></form>") == A
    assert pages.main_text(f"<article><p>{A}</p><form>{fields}<footer>hidden</footer></form><p>{B}</p></article>") == f"{A}\n{B}"
    assert pages.main_text(f"<div><p>{A}</p></div><form>{fields}</form>") == A
    assert pages.main_text(f"<form>{fields}</form>") == ""


def test_formula_in_a_sentence():
    formula = "<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x hidden</annotation></math>"
    assert pages.main_text(f"<p>So {formula} holds, {A}</p>") == f"So x=1 holds, {A}"
