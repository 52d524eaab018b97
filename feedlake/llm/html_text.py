"""Main text of web pages by two passes of block rules, with tags and names as evidence."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from feedlake.llm.common import map_texts
from feedlake.session import ship

ship(__name__)

#: Frequent function words of four languages.
STOP_WORDS = frozenset(
    "the of and to in a is that for it was on are as with be by at this from or an not have but they you his her "
    "de la le et les des un une du en que est pour qui dans par sur pas au avec il elle ce se ne son "
    "der die und den von zu das mit sich ist im nicht ein eine als auch auf für dem es er sie "
    "el los las y del con por su al lo como para más se no una esta".split()
)

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav noscript ol option p pre section "
    "select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template head title svg math iframe object canvas audio video select".split())
#: What may stand in a head; anything else ends it.
HEAD_TAGS = frozenset("base basefont bgsound html link meta noframes noscript script style template title".split())
#: Containers that rarely hold main text.
OUTSIDE_TAGS = frozenset("nav header footer aside form menu dialog button textarea".split())
INSIDE_TAGS = frozenset("article main".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Words in class or id of containers that seldom hold main text.
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs sidebar aside header masthead footer cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond reply "
    "replies discussion related recommended share sharing social widget pagination pager tags toolbar copyright "
    "disclaimer".split()
)
NAME_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
SPACE = re.compile(r"\s+")

SHORT_CHARS = 70
LONG_CHARS = 200
LINK_DENSITY = 0.35
STOP_LOW = 0.15
STOP_HIGH = 0.3

GOOD, BAD, SHORT, NEAR = "good", "bad", "short", "near"

#: What a block's text alone is worth: 2 is good, 1 near, 0 short, less is bad.
SCORES = {GOOD: 2, NEAR: 1, SHORT: 0, BAD: -1}
#: What is added for standing in a believed article or beside it, and in a believed outside container.
INSIDE, BESIDE = 3, -1
BY_TAG, BY_NAME = -3, -2
#: An outside container is not believed if it holds this share of the page's good text.
TAG_SHARE, NAME_SHARE = 1 / 2, 1 / 3
#: Articles are believed if they hold this share of it.
ARTICLE_SHARE = 1 / 2


@dataclass
class Block:
    text: str
    link_chars: int
    #: Outside containers around the block: a number in the page, and the weight against it.
    outside: tuple[tuple[int, int], ...]
    inside: bool
    heading: bool


@dataclass
class _Open:
    tag: str
    outside: tuple[tuple[int, int], ...]
    raw: bool
    inside: bool


class _Link:
    """An open link: the size of the stack at its start, its characters in the current block."""

    def __init__(self, depth: int):
        self.depth, self.chars = depth, 0
        self.blocks: list[tuple[Block, int]] = []


class _Blocks(HTMLParser):
    """Cuts a page into blocks at block tags; text in raw elements is dropped.

    A link without an end tag ends with the first block that has text of it, a head without
    one at the first thing that may not stand in it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = [_Open("", (), False, False)]
        self.blocks: list[Block] = []
        self.containers = 0
        self.pieces: list[str] = []
        self.link_chars = 0
        self.link: _Link | None = None
        self.heading = False

    def end_block(self):
        text = SPACE.sub(" ", "".join(self.pieces)).strip()
        if text:
            top = self.stack[-1]
            self.blocks.append(Block(text, self.link_chars, top.outside, top.inside, self.heading))
            if self.link and self.link.chars:
                self.link.blocks.append((self.blocks[-1], self.link.chars))
        if self.link:
            self.link.chars = 0
        self.pieces, self.link_chars = [], 0

    def _end_link(self):
        """Ends a link that has no end tag here."""
        for block, chars in self.link.blocks[1:]:
            block.link_chars -= chars
        if self.link.blocks:
            self.link_chars -= self.link.chars
        self.link = None

    def _pop(self, i: int):
        del self.stack[i:]
        if self.link and self.link.depth > i:
            self._end_link()

    def _end_head(self, tag: str = ""):
        """Ends an open head before a tag or text that may not stand in it."""
        if tag == "body":
            i = next((i for i, x in enumerate(self.stack) if x.tag == "head"), 0)
        else:
            i = len(self.stack) - 1
            if self.stack[i].tag == "title" and tag in BLOCK_TAGS:
                i -= 1
            if self.stack[i].tag != "head" or tag in HEAD_TAGS:
                return
        if i > 0:
            self._pop(i)

    def handle_starttag(self, tag, attrs):
        self._end_head(tag)
        if tag == "br":
            self.pieces.append(" ")
            return
        if tag in BLOCK_TAGS:
            self.end_block()
        if tag in VOID_TAGS:
            return
        if tag == "a":
            if self.link:
                self._end_link()
            if any(name == "href" for name, _ in attrs):
                self.link = _Link(len(self.stack))
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            self._close_implied(tag)
        if re.fullmatch("h[1-6]", tag):
            self.heading = True
        if tag in BLOCK_TAGS or tag in RAW_TAGS or tag in OUTSIDE_TAGS:
            top = self.stack[-1]
            outside, raw = top.outside, top.raw or tag in RAW_TAGS
            if attrs and tag not in ("html", "body"):
                raw = raw or any(name == "hidden" for name, _ in attrs)
            against = BY_TAG if tag in OUTSIDE_TAGS else _against(attrs) if tag not in ("html", "body") else 0
            if against:
                self.containers += 1
                outside = (*outside, (self.containers, against))
            self.stack.append(_Open(tag, outside, raw, top.inside or tag in INSIDE_TAGS))

    def _close_implied(self, tag):
        if self.stack[-1].tag == tag:
            self._pop(len(self.stack) - 1)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.end_block()
        if tag == "a":
            self.link = None
        if re.fullmatch("h[1-6]", tag):
            self.heading = False
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._pop(i)
                return

    def handle_data(self, data):
        if self.stack[-1].tag == "head" and not data.isspace():
            self._end_head()
        if self.stack[-1].raw:
            return
        self.pieces.append(data)
        if self.link:
            self.link_chars += len(data)
            self.link.chars += len(data)


def _against(attrs) -> int:
    """Weight of an element's role and names against its text."""
    weight = 0
    for name, value in attrs:
        if name == "role" and (value or "").lower() in OUTSIDE_ROLES:
            weight = min(weight, BY_TAG)
        if name in ("class", "id", "aria-label") and any(p.lower() in OUTSIDE_NAMES for p in NAME_PART.findall(value or "")):
            weight = min(weight, BY_NAME)
    return weight


def page_blocks(html: str) -> list[Block]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.end_block()
    if parser.link:
        parser._end_link()
    return parser.blocks


def text_label(block: Block) -> str:
    """Good, bad, short or near by link density, stop words and length alone."""
    if _linked(block):
        return BAD
    tokens = block.text.lower().split()
    density = sum(t.strip(".,;:!?\"'()*#$%&|") in STOP_WORDS for t in tokens) / len(tokens)
    if "\xa9" in block.text and len(block.text) < LONG_CHARS:
        return BAD
    if len(block.text) < SHORT_CHARS:
        return BAD if block.link_chars else SHORT
    if density >= STOP_HIGH:
        return GOOD if len(block.text) > LONG_CHARS else NEAR
    if density >= STOP_LOW:
        return NEAR
    return BAD


def _linked(block: Block) -> bool:
    return block.link_chars > LINK_DENSITY * len(block.text)


def first_pass(blocks: list[Block]) -> list[str]:
    """Good, bad, or to be decided by the neighbours (short: too little text, near: doubtful).

    Every block is scored by its text. Tags and names only add to or take from the score, and
    the page's good text decides which are believed: an outside container that holds much of
    it is not, and articles are only if they hold most of it. On a page without good text
    outside containers are believed, and articles go by the share of the text left.
    """
    by_text = [text_label(b) for b in blocks]
    good = [len(b.text) if label == GOOD else 0 for b, label in zip(blocks, by_text)]
    total = sum(good)
    held: dict[int, int] = {}
    for b, n in zip(blocks, good):
        for container, _ in b.outside:
            held[container] = held.get(container, 0) + n
    against = []
    for b in blocks:
        # Weights do not add up: one believed container, the worst, is enough.
        against.append(min((
            w for c, w in b.outside if not total or held[c] < (TAG_SHARE if w == BY_TAG else NAME_SHARE) * total
        ), default=0))
    if not any(n for n, w in zip(good, against) if not w):
        good = [0 if _linked(b) else len(b.text) for b in blocks]
    inside = sum(n for b, n, w in zip(blocks, good, against) if b.inside and not w)
    left = sum(n for n, w in zip(good, against) if not w)
    believed = inside > 0 and inside >= ARTICLE_SHARE * left
    labels = []
    for b, label, w in zip(blocks, by_text, against):
        score = SCORES[label] + w
        if believed:
            score += INSIDE if b.inside and not w else BESIDE
        labels.append(BAD if _linked(b) or score < 0 else (SHORT, NEAR, GOOD)[min(score, 2)])
    return labels


def second_pass(labels: list[str], headings: list[bool]) -> list[bool]:
    """True for main text.

    A doubtful block looks at the nearest decided block on each side; a page's edge counts
    as bad. Two that agree decide. If they differ, a near block is good, and a short one is
    good only next to the good block or as a heading above it.
    """
    n = len(labels)
    before, after = [(BAD, n + 1)] * n, [(BAD, n + 1)] * n
    last = (BAD, -1)
    for i, label in enumerate(labels):
        before[i] = (last[0], i - last[1])
        if label in (GOOD, BAD):
            last = (label, i)
    last = (BAD, n)
    for i in range(n - 1, -1, -1):
        after[i] = (last[0], last[1] - i)
        if labels[i] in (GOOD, BAD):
            last = (labels[i], i)
    keep = []
    for i, label in enumerate(labels):
        if label in (GOOD, BAD):
            keep.append(label == GOOD)
        elif before[i][0] == after[i][0]:
            keep.append(before[i][0] == GOOD)
        elif label == NEAR:
            keep.append(True)
        else:
            good = before[i] if before[i][0] == GOOD else after[i]
            bad = after[i] if before[i][0] == GOOD else before[i]
            keep.append(good[1] < bad[1] or (headings[i] and after[i][0] == GOOD))
    return keep


def main_text(html: str | None) -> str:
    """Blocks of main text in page order, one per line; empty if there are none."""
    blocks = page_blocks(html or "")
    keep = second_pass(first_pass(blocks), [b.heading for b in blocks])
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, and ``text`` and ``n_chars`` (its code points).

    Null or empty html, and pages without main text, give the empty text. Broken and cut off
    markup is read as far as it goes. A column of ``pages`` with the name of an added one is
    left out. Rows are independent; an empty table gives none.
    """
    outputs = {"text": "string", "n_chars": "bigint"}
    keep = [c for c in pages.columns if c != html and c.lower() not in outputs]

    def setup():
        def work(htmls):
            texts = [main_text(x) for x in htmls]
            return texts, [len(t) for t in texts]

        return work

    return map_texts(pages, keep, [html], outputs, setup)
