"""Main text of web pages by two passes of block rules.

A scanner cuts a page into blocks of text and leaves out what markup itself
calls something else: scripts, forms, menus, notices, comments and the like.
The first pass decides blocks by the density of stop words, their length and
their share of link text; short or middling blocks stay open.  In the second
pass an open block takes the label of the nearest decided neighbour.  On a page
in a language without a stop list, length and link text alone decide.

Both passes take all blocks.  Where a page marks its article, the mark speaks
for what the rules leave open inside it, and few stop words say nothing against
a block there; link text does.  A mark that holds less text than the rules find
outside of all marks marks something else, such as teasers, and is passed over.
"""

from __future__ import annotations

import html
import re
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.llm.batches import map_slices, texts

# Elements by what they do to text.
UNSEEN = frozenset("script style noscript template svg math iframe object canvas head title textarea select".split())
RAW = frozenset("script style textarea title".split())
ASIDE = frozenset("nav footer aside form dialog menu button".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 legend".split())
TEXTUAL = frozenset("address blockquote caption dt figcaption option p pre summary".split())
CONTAINERS = BLOCK - HEADINGS - TEXTUAL
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
# Words in a class, id or role that mark a part as no article text.
MARKS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disclaimer disqus footer login masthead menu modal nav navbar navigation newsletter notice notices pager "
    "pagination popup promo promotion recommended related reply replies respond search share sharing sidebar signup social "
    "sponsor sponsored subscribe toolbar widget contentinfo complementary".split()
)
# Parts of such names that say nothing about the content.
FILLING = frozenset(
    "area article articles block body bottom box card container content dfp div google gpt inner item items left link links list "
    "outer post posts right section site slot stories story thread top unit user wrap wrapper".split()
)
NOT_MARKING = frozenset("has with no without".split())
# Frequent words of the languages that pages come in.
STOP_WORDS = frozenset(
    "a about all an and are as at be been but by for from had has have he her his i if in is it its not of on or she that "
    "the their them they this to was we were which will with would you "
    "aber als am auch auf aus bei das dass dem den der des die durch ein eine einen einer er es für hat ich im ist kann mit "
    "nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn werden wie wir zu zum zur "
    "au aux avec ce ces cette comme dans de du elle en est et être il ils je la le les leur mais ne nous on ou où par pas "
    "plus pour qu que qui sa se ses son sont sur tout un une vous "
    "al como con cuando del desde donde el ella entre era esta este esto hay la las lo los más me mi muy no nos o para pero "
    "por porque se ser si sin sobre su sus también todo una uno y ya".split()
)

SHORT_CHARS = 70
LINKS = 0.5
#: So many blocks of link text in a row are a list of links, also in an article.
LINK_ROW = 3
STOPS_HIGH, STOPS_LOW = 0.3, 0.1
#: From this density over a whole page on, its language has a stop list.
STOPS_PAGE = 0.2
#: Letters of other scripts that say as much as one of a dense one.
DENSE_CHARS = 3
GOOD, BAD, OPEN = 1, -1, 0
OUT, DOUBTED = 1, 2

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S
)
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true)", re.I)
LETTERS = re.compile(r"[^\W\d_]+")
LANG = re.compile(r"<html\b[^>]*?\slang\s*=\s*[\"']?\s*(?:en|de|fr|es)\b", re.I)
# Scripts whose letters stand for syllables or words, so that a sentence has few of them.
DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")


def _marked(attributes: str, name: str = "div", in_article: bool = False) -> int:
    """OUT where an element's role, class or id calls it no article text, DOUBTED where part of a name does, or 0.

    Classes and ids say nothing about headings and inline elements, as headings
    get theirs from their words.  One part of a class is enough for containers
    outside of articles; elsewhere, and in ids, all parts of a name that say
    anything have to be marks.
    """
    if "=" not in attributes and "hidden" not in attributes.lower():
        return 0
    if HIDDEN.search(attributes):
        return OUT
    textual = name in TEXTUAL
    holds = name in CONTAINERS or "-" in name
    found = 0
    for kind, *values in NAMED.findall(attributes):
        kind = kind.lower()
        for said in " ".join(values).lower().split():
            parts = {p for p in re.split(r"[^a-z]+", said) if p}
            if parts & NOT_MARKING or not parts & MARKS:
                continue
            if kind == "role":
                return OUT
            if not holds and (not textual or in_article or kind == "id"):
                continue
            if not parts - MARKS - FILLING or (kind == "class" and holds and name != "article" and not in_article):
                return OUT
            found = DOUBTED
    return found


class Block:
    """A stretch of text between block elements."""

    __slots__ = ("text", "linked", "inside", "label", "words", "stops", "short")

    def __init__(self, text: str, linked: int, inside: bool):
        self.text, self.linked, self.inside, self.label = text, linked, inside, OPEN
        words = LETTERS.findall(text.lower())
        self.words, self.stops = len(words), sum(w in STOP_WORDS for w in words)
        self.short = len(text) < SHORT_CHARS and len(text) + (DENSE_CHARS - 1) * len(DENSE.findall(text)) < SHORT_CHARS

    def is_linked(self) -> bool:
        return self.linked > LINKS * len(self.text)

    def density(self) -> float:
        return self.stops / max(1, self.words)

    def decide(self, listed: bool) -> None:
        """By the rules alone; ``listed``: the language of the page has a stop list."""
        if self.is_linked():
            self.label = BAD
        elif self.short:
            self.label = OPEN
        elif not listed or self.density() >= STOPS_HIGH:
            self.label = GOOD
        elif self.density() < STOPS_LOW:
            self.label = BAD


def blocks_of(page: str) -> list[Block]:
    """Blocks outside of parts that markup rules out, in page order."""
    found: list[Block] = []
    parts: list[tuple[str, bool]] = []  # text and whether it is link text
    stack: list[tuple[str, int]] = []  # open elements and whether each rules its content out, or out of the article
    places: dict[str, list[int]] = {}  # where in the stack the elements of a name are
    blocks: list[int] = []  # and where blocks are
    count = {"out": 0, "doubted": 0, "a": 0, "main": 0}

    def flush() -> None:
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                linked = sum(len(" ".join(t.split())) for t, in_link in parts if in_link)
                found.append(Block(text, linked, count["main"] > 0 and not count["doubted"]))
            parts.clear()

    def say(raw: str) -> None:
        if raw and not count["out"]:
            parts.append((html.unescape(raw), count["a"] > 0))

    def close(until: int) -> None:
        while len(stack) > until:
            name, out = stack.pop()
            places[name].pop()
            if name in BLOCK:
                blocks.pop()
            count["out"] -= out == OUT
            count["doubted"] -= out == DOUBTED
            count["a"] -= name == "a"
            count["main"] -= name in MAIN

    at, size = 0, len(page)
    while at < size:
        token = TOKEN.search(page, at)
        if token is None:
            say(page[at:])
            break
        say(page[at : token.start()])
        at = token.end()
        name = (token.group(2) or "").lower()
        if not name:
            continue
        if name in BLOCK:
            flush()
        if token.group(1):
            if places.get(name):
                close(places[name][-1])
            continue
        if name == "br":
            say(" ")
            continue
        attributes = token.group(3)
        if name in VOID or (attributes.endswith("/") and name not in BLOCK):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            if end is None:
                break
            at = page.find(">", end.start()) + 1 or size
            continue
        if name == "body":  # ends a head that was left open
            close(next(iter(places.get("head", ())), len(stack)))
        elif name in BLOCK:  # a block ends an open paragraph, with what is open inside it
            if blocks and stack[blocks[-1]][0] == "p":
                close(blocks[-1])
        out = OUT if name in UNSEEN or name in ASIDE or (name == "header" and not count["main"]) else 0
        if not out and name not in ("html", "body", "main"):
            out = _marked(attributes, name, count["main"] > 0)
        places.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            blocks.append(len(stack))
        stack.append((name, out))
        count["out"] += out == OUT
        count["doubted"] += out == DOUBTED
        count["a"] += name == "a"
        count["main"] += name in MAIN
    flush()
    return found


def _has_stop_list(page: str, blocks: list[Block]) -> bool:
    """Whether stop words can tell text on this page: by their share of it, or by its named language and one block full of them."""
    plain = [b for b in blocks if not b.is_linked()]
    if sum(b.stops for b in plain) >= STOPS_PAGE * sum(b.words for b in plain):
        return True
    return any(not b.short and b.density() >= STOPS_HIGH for b in plain) and LANG.search(page) is not None


def _heed_marks(blocks: list[Block]) -> None:
    """What the marks of articles change about the labels of the first pass."""
    marked = sum(len(b.text) for b in blocks if b.inside and not b.is_linked())
    if marked < sum(len(b.text) for b in blocks if not b.inside and b.label == GOOD):
        for block in blocks:
            block.inside = False
        return
    for linked, row in groupby(blocks, lambda b: b.inside and b.is_linked()):
        row = list(row)
        for block in row:
            if linked:
                block.label = OPEN if len(row) < LINK_ROW and block.short else BAD
            elif block.inside and not block.short:
                block.label = GOOD


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    listed = _has_stop_list(page, blocks)
    for block in blocks:
        block.decide(listed)
    _heed_marks(blocks)
    decided = [i for i, b in enumerate(blocks) if b.label != OPEN]
    first = [b.label for b in blocks]
    after = 0
    for i, block in enumerate(blocks):
        if first[i] != OPEN:
            continue
        while after < len(decided) and decided[after] < i:
            after += 1
        near = []
        if after > 0:
            near.append((i - decided[after - 1], first[decided[after - 1]]))
        if after < len(decided):
            near.append((decided[after] - i, first[decided[after]]))
        if not near:
            block.label = GOOD if block.inside else BAD
        elif len(near) == 2 and near[0][0] == near[1][0] and near[0][1] != near[1][1]:
            block.label = GOOD if block.inside else BAD
        else:
            block.label = min(near)[1]
    return "\n\n".join(b.text for b in blocks if b.label == GOOD)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id``, ``url``, ``text`` and ``n_chars``, its code points.

    Null and empty pages, and pages without main text, give an empty text.
    Repeated rows repeat; null ids and urls stay null; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(page) for page in texts(batch, "html")]
        return pa.RecordBatch.from_pydict(
            {
                "page_id": batch.column("page_id"),
                "url": batch.column("url"),
                "text": pa.array(found, pa.string()),
                "n_chars": pa.array([len(t) for t in found], pa.int64()),
            }
        )

    base = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_slices(base, run, "page_id bigint, url string, text string, n_chars bigint")
