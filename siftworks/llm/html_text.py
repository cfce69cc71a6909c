"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass looks at each block by
itself: link density, length and the share of stop words make it good, bad, nearly
good or short; blocks in menus, footers, forms, adverts and the like are bad by their
place. In the second pass short and nearly good blocks take the label of the nearest
decided neighbours before and after them; the border of an article counts as a good
neighbour inside it, the border of the page as a bad one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LINK_DENSITY = 0.33
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.08, 0.15

# The commonest closed-class words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an the of and or to in on at is are was were be been has have had it its this that these those with as by for from "
    "not but he she they we you his her their our your which who will would can could there than then when so if no do does "
    "der die das den dem des ein eine einen einem einer und oder zu zur zum im von mit auf für ist sind war nicht als auch "
    "sich es er sie wir ihr aus bei nach wie über unter aber noch nur wird werden hat haben dass wenn "
    "le la les un une du et ou à au aux en dans sur pour par est sont était ne pas que qui ce cette ces il elle ils elles "
    "nous vous se sa son ses leur plus avec sans mais comme il y "
    "el los las unos unas del y o al con por para es son era no se su sus lo como más pero este esta estos que en una".split()
)
# Words in class and id names, and roles, of what is no article text.
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar "
    "navigation topnav breadcrumb breadcrumbs footer masthead comment comments disqus respond replies cookie cookies consent "
    "gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations widget widgets toolbar pager pagination copyright legal disclaimer search skip hidden "
    "teaser teasers outbrain taboola paywall responses discussion reactions feedback sitemap submenu".split()
)
ASIDE_STARTS = ("comment", "sidebar", "cookie", "advert", "navi", "breadcrumb", "footer", "newsletter", "subscri", "sponsor", "disqus")
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
ASIDE_TAGS = frozenset(
    "nav footer aside form menu dialog button select option svg math noscript template object audio video canvas map head "
    "frameset label datalist".split()
)
BLOCK_TAGS = frozenset(
    "p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre section article main "
    "header footer nav aside form fieldset figure figcaption hr address details summary body html center head br menu dialog "
    "button select option legend".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|title|textarea|iframe|noembed|noframes|xmp)\b[^>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>\"']+|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    inside: bool  # in the article by its tags
    aside: bool  # in something that is no article text
    heading: bool


def _is_aside(name: str, rest: str, inside: bool) -> bool:
    if name in ASIDE_TAGS:
        return True
    if name == "header" and not inside:
        return True
    if name in ("html", "body", "main"):
        return False
    for key, *values in _NAMED.findall(rest) if rest else ():
        value, key = "".join(values), key.lower()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "role" and value.lower() in ASIDE_ROLES:
            return True
        if key in ("class", "id") and any(
            x in ASIDE_NAMES or x.startswith(ASIDE_STARTS) for x in map(str.lower, _PART.findall(value))
        ):
            return True
    return False


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order; scripts, styles, comments and markup are gone."""
    found: list[Block] = []
    texts: list[str] = []
    open_: list[tuple[str, bool, bool]] = []  # tag, inside the article, aside
    linked = link_depth = 0
    inside = aside = heading = seen_article = False
    at = 0

    def close() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(texts)).split())
        if text:
            found.append(Block(text, min(linked, len(text)), inside, aside, heading))
        texts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            texts.append(text)
            if link_depth and not text.isspace():
                linked += len(text)

    for token in _TOKEN.finditer(html):
        add(html[at : token.start()])
        at = token.end()
        if token["data"] is not None:
            add(token["data"].replace("&", "&amp;"))
        if token["name"] is None:
            continue
        name, rest, ending = token["name"].lower(), token["rest"], bool(token["end"])
        if name == "a":
            link_depth = 0 if ending else 1
            continue
        if name in BLOCK_TAGS:
            close()
            heading = name in HEADINGS and not ending
            link_depth = 0
        if ending:
            places = [k for k, (tag, _, _) in enumerate(open_) if tag == name]
            if places:
                close()
                del open_[places[-1] :]
        elif name not in VOID_TAGS and not rest.rstrip().endswith("/"):
            if name in BLOCK_TAGS and open_ and open_[-1][0] == "p":
                open_.pop()  # a block inside a paragraph ends it
            outer_inside, outer_aside = open_[-1][1:] if open_ else (False, False)
            own = _is_aside(name, rest, outer_inside)
            if name == "body" or name in ("article", "main") and not own and not seen_article:
                outer_aside = False  # what came before was never closed
            if name in ("article", "main") and not own and not outer_aside:
                seen_article = outer_inside = True
            if name in BLOCK_TAGS or own:
                if own and name not in BLOCK_TAGS:
                    close()
                open_.append((name, outer_inside, outer_aside or own))
        _, inside, aside = open_[-1] if open_ else ("", False, False)
    add(html[at:])
    close()
    return found


def _first_pass(block: Block) -> str:
    if block.aside:
        return "bad"
    length = len(block.text)
    if block.linked > MAX_LINK_DENSITY * length:
        return "bad"
    if block.heading:
        return "short"
    words = _LETTERS.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if length < SHORT:
        return "bad" if block.linked and not block.inside else "short"
    if stops >= STOP_HIGH:
        return "good" if length > LONG or block.inside or not block.linked else "near"
    if stops >= STOP_LOW:
        return "near"
    return "short" if block.inside else "bad"


def main_blocks(found: list[Block]) -> list[Block]:
    """The blocks of the article, by both passes."""
    labels = [_first_pass(b) for b in found]
    whole = any(b.inside for b in found)
    kept = []
    for i, block in enumerate(found):
        label = labels[i]
        if label in ("near", "short"):
            sides = []
            for step in (-1, 1):
                k = i + step
                # blocks of other places are no neighbours: an article's border is met first
                while 0 <= k < len(found) and found[k].inside == block.inside and labels[k] in ("near", "short"):
                    k += step
                if 0 <= k < len(found) and found[k].inside == block.inside and not (block.inside and found[k].aside):
                    sides.append(labels[k])
                else:
                    sides.append("good" if block.inside else "bad")
            after = sides[1] == "good"
            good = sides == ["good", "good"] or "good" in sides and (label == "near" or block.heading and after)
            good = good or label == "near" and not whole and len(block.text) >= SHORT
            label = "good" if good else "bad"
        if label == "good" and (block.inside or not whole):
            kept.append(block)
    return kept


def page_text(html: str | None) -> str:
    """Main text of a page: its blocks joined by one space, empty if there is none."""
    return " ".join(b.text for b in main_blocks(blocks(html or "")))


def extract_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages (page_id, url, html)``.

    Null and empty pages have the empty text. Ids and urls are kept as they are, null or
    repeated; other columns are ignored; an empty table gives an empty table. Pages are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(x.as_py()) for x in batch.column("html")]
            yield pa.record_batch(
                {
                    "page_id": batch.column("page_id"),
                    "url": batch.column("url"),
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(x) for x in texts], pa.int64()),
                }
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
