"""Main text of web pages by two-pass block rules.

A scan of the tags cuts a page into blocks. The first pass classes each block by length, link
density and stop-word density; the second lets short or undecided blocks inherit from their nearest
decided neighbours. Where markup names a region as furniture (menus, headers, footers, forms, adverts,
comments and the like) or as the article, that is one more feature of its blocks: it moves the limits
of the first pass and says which neighbours speak for a block in the second.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Very frequent words of the four languages handled. Fixed values.
STOP_WORDS = {
    "en": "the of and to in a is that it for was on are as with be by this from at or an not have they which you were her his she he we but had has their all one there been if more when who will no out so what",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux cette mais comme on tout nous sa fait été aussi leur bien",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos",
}
_STOPS = frozenset(w for words in STOP_WORDS.values() for w in words.split())

_VOID_CONTENT = ("script", "style", "noscript", "template", "textarea", "select", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head", "title", "option", "datalist", "button")
_RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")
_FURNITURE = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset", *_VOID_CONTENT))
_BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption head title".split())
_NO_END = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar alert".split())
#: Words in class or id attributes that name furniture.
_NAMES = re.compile(
    r"(?:^|[^a-z])(ads?|adverts?|advertisement|advertising|advertorial|adbox|adslot|banner|billboard|breadcrumbs?|byline-links|comments?|commentlist|disqus|respond|replies|reader-comments|cookies?|consent|gdpr|notice|notices|notification|alert|disclaimer|footer|footnav|masthead|site-header|page-header|topbar|navbar|nav|navigation|menu|submenu|sidebar|side-bar|widget|widgets|related|recommended|recommendations|promo|promoted|promotion|sponsor|sponsored|sponsors|social|share|sharing|share-buttons|newsletter|subscribe|subscription|signup|sign-up|login|log-in|search|searchbox|popup|modal|overlay|pagination|pager|toolbar|tags|tag-list|copyright|legal|teaser|outbrain|taboola|skip-link|feedback)(?:$|[^a-z])"
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WHITE = re.compile(r"\s+")
_WORDS = re.compile(r"\w+")

#: Of those the ones that parts of an article bear too: they speak less strongly.
_LOOSE = frozenset("social legal copyright feedback search tags share sharing widget related teaser disclaimer feature alert overlay".split())

#: Limits of the rules: characters of a short and of a long block, link density, stop-word densities.
LENGTH_LOW, LENGTH_HIGH, LINKS_HIGH, STOPS_LOW, STOPS_HIGH = 70, 200, 0.33, 0.06, 0.12


@dataclass(slots=True)
class Block:
    text: str
    links: int  #: characters within links
    furniture: bool  #: in a region that its markup names as furniture
    named: bool  #: so by its element, its role or a name that article text never bears
    inside: bool  #: in an article or main element
    heading: bool
    label: str = ""


def _furniture(tag: str, attrs: str, inside: bool) -> int:
    """How strongly an element is named as furniture: 2, 1 (by a loose name alone) or 0."""
    if tag in _FURNITURE:
        return 0 if tag == "header" and inside else 2
    if not attrs or tag in ("html", "body", "article", "main"):
        return 0
    most = 0
    for name, a, b, c in _ATTR.findall(attrs):
        name = name.lower()
        value = a or b or c
        if name in ("class", "id"):
            names = _NAMES.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().replace("_", "-"))
            if names:
                most = max(most, 1 if set(names) <= _LOOSE else 2)
        elif name == "role" and value.lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
    return most


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, white space within each turned into one space."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # tag, furniture from here, article from here
    bad = named = good = links = heading = 0
    parts: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = _WHITE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, min(linked, len(text)), bad > 0, named > 0, good > 0, heading > 0))
            parts, linked = [], 0

    def pop() -> None:
        nonlocal bad, named, good, links, heading
        tag, f, g = stack.pop()
        bad -= f > 0
        named -= f > 1
        good -= g
        links -= tag == "a"
        heading -= tag in ("h1", "h2", "h3", "h4", "h5", "h6")

    at, n, low = 0, len(page), None
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            token = m[0]
            if token[0] == "<" and len(token) > 1:
                continue
            text = _html.unescape(token)
            parts.append(text)
            if links:
                linked += len(_WHITE.sub(" ", text).strip())
            continue
        tag = tag.lower()
        if m[1]:
            if tag in _BLOCK:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in ("article", "main", "body", "table", "td") and tag not in ("article", "main", "body", "html", "div", "section", "table", "tr", "tbody"):
                    break  # a stray end tag closes nothing beyond its container
            continue
        if tag in _BLOCK:
            close()
            if tag != "br":
                # a new block ends open paragraphs, and its like among list items, cells and options
                ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
                while stack and (stack[-1][0] == "p" or stack[-1][0] in ends):
                    pop()
        if tag in _NO_END or m[3].endswith("/") and tag in ("svg", "math", "path", "iframe"):
            continue
        if tag in _RAW:
            if low is None:
                low = page.lower()
            end = low.find(f"</{tag}", at)
            at = n if end < 0 else page.find(">", end) + 1 or n
            continue
        f, g = _furniture(tag, m[3], good > 0), tag in ("article", "main")
        stack.append((tag, f, g))
        bad += f > 0
        named += f > 1
        good += g
        links += tag == "a"
        heading += tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    close()
    return out


def first_pass(block: Block, trusted: bool) -> str:
    """The class of a block by itself: bad, good, near or short.

    Length, link density and stop-word density decide. Where the block stands moves the limits: within
    an article that holds the page's text (``trusted``) half the stop words are enough and beside it
    twice the length is asked for; in a region that is named as furniture only a long run of text with
    few links stays open, for its neighbours to decide."""
    n = len(block.text)
    words = _WORDS.findall(block.text.lower())
    links, stops = block.links / n, sum(map(_STOPS.__contains__, words)) / max(1, len(words))
    inside = trusted and block.inside
    if block.furniture:
        return "near" if block.inside and n > 2 * LENGTH_HIGH and stops >= STOPS_HIGH and links <= LINKS_HIGH / 2 and not block.named else "bad"
    if links > LINKS_HIGH or "\xa9" in block.text and n < LENGTH_HIGH:
        # a sentence that is a link stays open within the article
        return "near" if inside and "\xa9" not in block.text and stops >= STOPS_LOW and n >= LENGTH_LOW else "bad"
    if n < LENGTH_LOW:
        return "short"
    if trusted and not block.inside:
        return "near" if stops >= STOPS_HIGH and n > 2 * LENGTH_HIGH else "bad"
    if stops >= (STOPS_HIGH / 2 if inside else STOPS_HIGH):
        return "good" if inside or n > LENGTH_HIGH else "near"
    return "near" if inside or stops >= STOPS_LOW else "bad"


def second_pass(blocks: list[Block], first: list[str], trusted: bool) -> list[str]:
    """Short and undecided blocks take the class of their nearest decided neighbours in the same part of
    the page (the article, what surrounds it): a near block is good beside a good one, a short one takes
    the nearer neighbour's class, a heading that of what follows. The page's ends count as bad; an
    article's ends say nothing."""
    out = list(first)
    parts = [[i for i, b in enumerate(blocks) if b.inside == side and not (side and b.furniture and first[i] == "bad")] for side in (True, False)] if trusted else [list(range(len(blocks)))]
    for rows in parts:
        edge = None if trusted and rows and blocks[rows[0]].inside else "bad"
        before, last = {}, (edge, -1)
        for at, i in enumerate(rows):
            before[i] = last
            last = (first[i], at) if first[i] in ("good", "bad") else last
        after, last = {}, (edge, len(rows))
        for at in range(len(rows) - 1, -1, -1):
            after[rows[at]] = last
            last = (first[rows[at]], at) if first[rows[at]] in ("good", "bad") else last
        for at, i in enumerate(rows):
            if first[i] in ("good", "bad"):
                continue
            (left, a), (right, b) = before[i], after[i]
            sides = {left, right} - {None}
            if not sides:
                out[i] = "good"  # an article of short blocks alone
            elif first[i] == "near":
                out[i] = "good" if "good" in sides else "bad"
            elif blocks[i].heading:
                out[i] = "good" if (right or left) == "good" else "bad"
            elif len(sides) == 1:
                out[i] = sides.pop()
            else:
                # between text and furniture: the nearer one, a tie goes to whole sentences
                near = left if at - a < b - at else right if b - at < at - a else "good" if blocks[i].text.endswith((".", "!", "?")) else "bad"
                out[i] = near
    return out


def classify(blocks: list[Block]) -> list[Block]:
    """Labels each block good or bad, by the two passes described above. What the page marks as its
    article is trusted if it holds at least half of the text that the first pass finds good without it."""
    plain = [first_pass(b, False) for b in blocks]
    weight = lambda inside: sum(len(b.text) for b, x in zip(blocks, plain, strict=True) if b.inside == inside and x == "good")
    trusted = any(b.inside and not b.furniture for b in blocks) and weight(True) >= weight(False)
    first = [first_pass(b, True) for b in blocks] if trusted else plain
    labels = second_pass(blocks, first, trusted)
    if "good" not in labels:
        # nothing decided good: undecided blocks of some length are the text, else what follows the first heading
        start = next((i for i, b in enumerate(blocks) if b.heading), len(blocks))
        labels = ["good" if x == "near" or i >= start and x == "short" else y for i, (x, y) in enumerate(zip(first, labels, strict=True))]
    for b, label in zip(blocks, labels, strict=True):
        b.label = "good" if label == "good" else "bad"
    return blocks


def main_text(page: str | None) -> str:
    """The good blocks of a page joined by empty lines; empty if there are none."""
    return "\n\n".join(b.text for b in classify(blocks_of(page or "")) if b.label == "good")


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every column of ``pages`` but the html, plus ``text``.

    Null and empty pages give an empty text. Rows are independent, so nothing is shuffled and one
    page is held at a time; unclosed tags and broken markup never raise.
    """
    keep = [c for c in pages.columns if c not in (html, "text")]
    names = [f"c{i}" for i in range(len(keep))]  # columns travel under numbers: no name can clash
    sent = pages.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)), F.col(html).alias("page"))
    schema = sent.drop("page").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                b = whole.slice(first, 256)
                texts = [main_text(x.as_py()) for x in b.column("page")]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(texts, pa.string())], [*names, "text"])

    return sent.mapInArrow(run, schema).select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "text")


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars. Null and empty pages have an empty text of 0 characters; repeated rows
    each give a row, null ids and urls are kept, an empty table gives none, other columns are not read."""
    return extract_pages(pages.select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("bigint"))
