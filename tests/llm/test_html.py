from __future__ import annotations

import pytest

from siftworks.llm.html_text import extract_text, page_text

PARA = (
    "It was the best of times and it was the worst of times, in the age of wisdom and in the age of foolishness, "
    "and so it went on for the reader who is in the mood for a long paragraph with all of its words."
)
MENU = "<nav><ul><li><a href='/a'>The</a></li><li><a href='/b'>of the and</a></li></ul></nav>"


@pytest.mark.parametrize(
    ("html", "wanted"),
    [
        (f"<html><body>{MENU}<article><h1>A title</h1><p>{PARA}</p><p>Short.</p></article><footer>&copy; it and the rest</footer>", f"A title {PARA} Short."),
        (f"<article><p><b>{PARA}<br><p>Two  \n words.</article>", f"{PARA} Two words."),
        ("<article><h1>Only</h1><p>Few words.</p></article>", "Only Few words."),
        (f"<div class='side-bar sidebar'>{PARA}</div><div><p>{PARA}</p><p>{PARA}</p></div><div id=cookieBox>{PARA}</div>", f"{PARA} {PARA}"),
        (f"<main><p>{PARA}</p><section class='comments'><p>{PARA}</p><article>{PARA}</article></section></main>", PARA),
        (f"<script>var t='</p>{PARA}'</script><style>p{{}}</style><!-- {PARA} --><article>{PARA} &lt;b&gt; &eacute;&#233;</article>", f"{PARA} <b> éé"),
        (f"<header><p>{PARA}</p></header><article><header><h1>T</h1></header><p>{PARA}</p><form><p>{PARA}</p></form></article>", f"T {PARA}"),
        (f"<div class=ad><p>{PARA}<article><p>{PARA}</article>", PARA),
        (f"<article><p title='a > b'>{PARA}</p><p>5 < 6 and 7 > 6</p></article>", f"{PARA} 5 < 6 and 7 > 6"),
        (f"<head><title>T</title><meta content=x><body><article>{PARA}", PARA),
        ("<ul><li><a href=x>one</a><li><a href=y>two</a></ul>", ""),
        ("", ""),
        (None, ""),
        ("<", ""),
    ],
)
def test_pages(html, wanted):
    assert page_text(html) == wanted


def test_hostile_markup_takes_linear_time():
    assert page_text("<a title=\"" * 20_000 + "<" * 20_000) is not None
    assert page_text("<div>" * 3_000 + PARA) == PARA
    assert page_text(f"<article><p>{PARA * 2_000}</p></article>") == PARA * 2_000


def test_table(frame):
    rows = [(1, "u", f"<article>{PARA}</article>", "x"), (1, "u", f"<article>{PARA}</article>", "x"), (2, None, None, "x"), (None, "v", "", "x")]
    pages = frame(rows, "page_id long, url string, html string, text string")
    found = extract_text(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(
        [(1, "u", PARA, len(PARA))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str
    )
    assert extract_text(pages.where("false")).collect() == []
