"""Main text of web pages from flat text blocks.

A page becomes a flat list of text blocks. Each has its number of words and
its link density and those of its neighbours. Tags form the blocks, and discard those that they set apart or hint at as no article; a decision tree that is trained on the
small tables ``UNMARKED`` and ``MARKED`` tells article blocks from the rest by words and densities: where no tag marks the article, and, inside one that is marked, lists of nothing
but links from its text. Inline elements that are set apart or hint discard their own text, not that of the block around them.

Cases: null and empty html, and pages without article blocks, give the empty text; unclosed, misnested and
truncated markup is read as far as it goes; very long pages take time in proportion to their length; repeated rows are
extracted each for itself, and so nothing ties; columns beside page_id, url and html are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.common import small_batches
from ripplet.llm.tree import DecisionTree

#: As in the HTML standard a quote opens a value right after its equals sign only; a value that never ends is no value.
TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)?|[^=>])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
#: Elements whose text is no text of the page.
SKIPPED = frozenset("script style noscript template textarea title select option button iframe svg canvas object audio video math".split())
RAW = frozenset("script style textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an end tag ends even inside blocks that are open still.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
APART = frozenset("nav aside footer form menu dialog fieldset search".split())
MAIN = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names as has-sidebar or sidebar-layout say how a page is laid out.
LAYOUT = re.compile(r"(?:has|with|without|no)[-_].*|.*[-_]layout", re.S)
#: Words that leave the id of a section a hint: related-posts, but not related-work.
BESIDE = frozenset("area articles bar block box buttons container content form links list news posts section stories thread us wrap wrapper".split())
_SECTIONS, _TABLE = ("tbody", "thead", "tfoot"), frozenset(["table"])
#: What a start tag closes without an end tag, and what keeps elements around it open, as in the HTML standard.
CLOSED = (
    {"li": (("li",), BLOCKS - {"address", "div", "p", "li"})}
    | dict.fromkeys(("dt", "dd"), (("dt", "dd"), BLOCKS - {"address", "div", "p", "dt", "dd"}))
    | dict.fromkeys(("td", "th"), (("td", "th"), _TABLE))
    | {"tr": (("tr", "td", "th"), _TABLE)}
    | dict.fromkeys(_SECTIONS, ((*_SECTIONS, "tr", "td", "th"), _TABLE))
)
#: What an end tag does not reach beyond.
SCOPE = {"li": frozenset("ul ol table td th caption".split())} | dict.fromkeys(("td", "th", "tr", *_SECTIONS), _TABLE)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal newsletter subscribe "
    "subscription signup login sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs comment comments reply replies respond disqus discussion share sharing "
    "social related recommended footer masthead toolbar pagination pager copyright legal".split()
)

#: Of the tree.
DEPTH = 9
# words, link density, words before, link density before, words after, link density after, heading -> article
#: The labelled table: blocks as counted on pages, with and without navigation, adverts and footers, where no tag marks the article, and a few of link lists.
UNMARKED = (
    (1, 1.00, 0, 0.00, 1, 1.00, 0, 0), (1, 1.00, 1, 1.00, 1, 1.00, 0, 0), (1, 1.00, 1, 1.00, 9, 0.00, 0, 0), (1, 1.00, 1, 1.00, 8, 0.00, 0, 0), (1, 1.00, 1, 1.00, 11, 0.00, 0, 0),
    (1, 1.00, 1, 1.00, 10, 0.00, 0, 0), (1, 1.00, 1, 1.00, 5, 0.00, 0, 0), (5, 0.00, 1, 1.00, 11, 0.00, 0, 0), (4, 0.00, 1, 1.00, 11, 0.00, 0, 0), (4, 0.00, 1, 1.00, 9, 0.00, 0, 0),
    (8, 0.00, 1, 1.00, 13, 0.00, 0, 0), (5, 0.00, 1, 1.00, 8, 0.00, 0, 0), (10, 0.00, 1, 1.00, 9, 0.00, 0, 0), (5, 0.00, 1, 1.00, 1, 0.00, 0, 0), (12, 0.00, 1, 1.00, 9, 0.00, 0, 0),
    (8, 0.00, 1, 1.00, 11, 0.00, 0, 0), (11, 0.00, 0, 0.00, 6, 0.00, 0, 0), (7, 0.00, 0, 0.00, 5, 0.00, 0, 0), (9, 0.00, 0, 0.00, 6, 0.00, 0, 0), (5, 0.00, 0, 0.00, 12, 0.00, 0, 0),
    (9, 0.00, 13, 0.00, 10, 0.00, 1, 1), (8, 0.00, 12, 0.00, 8, 0.00, 1, 1), (2, 0.00, 11, 0.00, 2, 0.00, 1, 1), (1, 0.00, 11, 0.00, 1, 0.00, 1, 1), (9, 0.00, 8, 0.00, 10, 0.00, 1, 1),
    (11, 0.00, 12, 0.00, 11, 0.00, 1, 1), (11, 0.00, 4, 0.00, 59, 0.00, 1, 1), (10, 0.00, 1, 1.00, 19, 0.00, 1, 1), (8, 0.00, 1, 1.00, 8, 0.00, 1, 1), (10, 0.00, 1, 1.00, 163, 0.00, 1, 1),
    (10, 0.00, 1, 1.00, 76, 0.00, 1, 1), (6, 0.00, 1, 1.00, 6, 0.00, 1, 1), (9, 0.00, 1, 1.00, 103, 0.00, 1, 1), (11, 0.00, 1, 1.00, 148, 0.00, 1, 1), (10, 0.00, 0, 0.00, 117, 0.00, 1, 1),
    (10, 0.00, 0, 0.00, 44, 0.00, 1, 1), (7, 0.00, 0, 0.00, 150, 0.00, 1, 1), (9, 0.00, 0, 0.00, 233, 0.00, 1, 1), (12, 0.00, 0, 0.00, 121, 0.00, 1, 1),
    (110, 0.00, 12, 0.00, 23, 0.00, 0, 1), (4, 0.00, 4, 0.00, 13, 0.00, 0, 1), (9, 0.00, 9, 0.00, 21, 0.00, 0, 1), (7, 0.00, 7, 0.00, 8, 0.00, 0, 1), (85, 0.00, 8, 0.00, 7, 0.00, 0, 1),
    (9, 0.00, 9, 0.00, 17, 0.00, 0, 1), (11, 0.00, 7, 0.00, 31, 0.00, 0, 1), (3, 0.00, 3, 0.00, 0, 0.00, 0, 1), (57, 0.00, 10, 0.00, 0, 0.00, 0, 1), (117, 0.00, 10, 0.00, 0, 0.00, 0, 1),
    (233, 0.00, 9, 0.00, 0, 0.00, 0, 1), (30, 0.00, 5, 0.00, 8, 0.00, 0, 1), (42, 0.00, 9, 0.00, 64, 0.00, 0, 1), (185, 0.00, 52, 0.00, 100, 0.00, 0, 1),
    (24, 0.00, 40, 0.00, 20, 0.00, 0, 1), (71, 0.00, 20, 0.00, 141, 0.00, 0, 1), (73, 0.00, 2, 0.00, 98, 0.00, 0, 1), (163, 0.00, 50, 0.00, 45, 0.00, 0, 1),
    (16, 0.00, 11, 0.00, 10, 0.00, 0, 1), (35, 0.00, 25, 0.00, 71, 0.00, 0, 1), (24, 0.00, 116, 0.00, 220, 0.00, 0, 1), (37, 0.00, 41, 0.00, 80, 0.00, 0, 1),
    (27, 0.00, 32, 0.00, 116, 0.00, 0, 1), (1, 0.00, 5, 0.00, 11, 0.00, 0, 1), (1, 0.00, 37, 0.00, 40, 0.00, 0, 1), (2, 0.00, 170, 0.00, 41, 0.00, 0, 1),
    (3, 0.00, 83, 0.00, 27, 0.00, 0, 1), (3, 0.00, 11, 0.00, 32, 0.00, 0, 1), (3, 0.00, 48, 0.00, 114, 0.00, 0, 1), (3, 0.00, 3, 0.00, 12, 0.00, 0, 1), (71, 0.00, 19, 0.00, 13, 0.00, 0, 1),
    (10, 0.00, 26, 0.00, 13, 0.00, 0, 1), (81, 0.00, 9, 0.00, 8, 0.00, 0, 1), (20, 0.00, 7, 0.00, 8, 0.00, 0, 1), (96, 0.00, 65, 0.00, 9, 0.00, 0, 1), (73, 0.00, 74, 0.00, 8, 0.00, 0, 1),
    (8, 0.00, 43, 0.00, 13, 0.00, 0, 1), (5, 0.00, 39, 0.00, 10, 0.00, 0, 1), (5, 0.00, 80, 0.00, 0, 0.00, 0, 1), (73, 0.00, 4, 0.00, 0, 0.00, 0, 1), (163, 0.00, 155, 0.00, 0, 0.00, 0, 1),
    (9, 0.00, 52, 0.00, 0, 0.00, 0, 1), (3, 0.00, 44, 0.00, 0, 0.00, 0, 1), (7, 0.00, 159, 0.00, 0, 0.00, 0, 1), (8, 0.00, 23, 0.00, 0, 0.00, 0, 1), (35, 0.00, 56, 0.00, 0, 0.00, 0, 1),
    (13, 0.00, 8, 0.00, 0, 0.00, 0, 0), (13, 0.00, 89, 0.00, 0, 0.00, 0, 0), (8, 0.00, 14, 0.00, 0, 0.00, 0, 0), (13, 0.00, 86, 0.00, 0, 0.00, 0, 0), (8, 0.00, 12, 0.00, 0, 0.00, 0, 0),
    (8, 0.00, 10, 0.00, 0, 0.00, 0, 0), (8, 0.00, 8, 0.00, 0, 0.00, 0, 0), (16, 0.00, 12, 0.00, 0, 0.00, 0, 0), (12, 0.00, 50, 0.00, 0, 0.00, 0, 0), (11, 0.00, 128, 0.00, 0, 0.00, 0, 0),
    (60, 0.05, 9, 0.00, 80, 0.00, 0, 1), (35, 0.10, 40, 0.00, 50, 0.05, 0, 1), (25, 0.00, 30, 0.00, 2, 1.00, 0, 1), (40, 0.25, 50, 0.00, 60, 0.10, 0, 1),
    (18, 0.00, 45, 0.02, 22, 0.00, 0, 1), (12, 0.00, 80, 0.00, 3, 1.00, 0, 1), (120, 0.00, 60, 0.00, 0, 0.00, 0, 1), (3, 1.00, 2, 1.00, 3, 1.00, 0, 0), (1, 1.00, 40, 0.00, 1, 1.00, 0, 0),
    (6, 0.70, 5, 0.80, 6, 0.60, 0, 0), (20, 0.90, 3, 1.00, 4, 1.00, 0, 0), (30, 0.60, 60, 0.00, 30, 0.70, 0, 0), (3, 0.00, 2, 1.00, 2, 1.00, 0, 0), (5, 0.00, 1, 1.00, 3, 0.00, 0, 0),
    (2, 0.00, 0, 0.00, 2, 1.00, 0, 0), (5, 0.00, 2, 1.00, 1, 1.00, 1, 0), (8, 0.60, 50, 0.00, 3, 1.00, 0, 0), (50, 0.80, 70, 0.00, 60, 0.00, 0, 0), (80, 0.00, 1, 1.00, 60, 0.00, 0, 1),
    (45, 0.00, 2, 1.00, 70, 0.00, 0, 1), (150, 0.00, 1, 1.00, 0, 0.00, 0, 1), (35, 0.00, 3, 1.00, 40, 0.00, 0, 1), (40, 0.00, 1, 0.00, 55, 0.00, 0, 1), (8, 0.00, 1, 0.00, 60, 0.00, 0, 1),
    (3, 0.00, 0, 0.00, 0, 0.00, 0, 1), (8, 0.00, 0, 0.00, 0, 0.00, 0, 1), (20, 0.05, 0, 0.00, 0, 0.00, 0, 1), (150, 0.00, 0, 0.00, 0, 0.00, 0, 1),
    (5, 0.00, 2, 0.00, 30, 0.00, 0, 1), (12, 0.00, 1, 0.00, 9, 0.00, 0, 1), (9, 0.00, 5, 1.00, 10, 0.00, 0, 0), (12, 0.00, 4, 1.00, 9, 0.00, 0, 0), (7, 0.00, 6, 0.83, 11, 0.00, 0, 0),
)


#: Blocks inside an element that marks the article: its headings, paragraphs and lists, with and without links, and lists of nothing but links.
MARKED = (
    (10, 0.00, 1, 1.00, 76, 0.00, 1, 1), (9, 0.00, 1, 1.00, 103, 0.00, 1, 1), (12, 0.00, 0, 0.00, 121, 0.00, 1, 1), (2, 0.00, 11, 0.00, 2, 0.00, 1, 1), (3, 1.00, 50, 0.00, 60, 0.00, 1, 1),
    (5, 1.00, 0, 0.00, 90, 0.00, 1, 1), (4, 1.00, 2, 1.00, 70, 0.02, 1, 1), (4, 1.00, 3, 1.00, 2, 1.00, 1, 1), (6, 0.00, 2, 1.00, 2, 1.00, 1, 1), (110, 0.00, 12, 0.00, 23, 0.00, 0, 1),
    (4, 0.00, 4, 0.00, 13, 0.00, 0, 1), (1, 0.00, 5, 0.00, 11, 0.00, 0, 1), (3, 0.00, 3, 0.00, 12, 0.00, 0, 1), (2, 0.00, 0, 0.00, 0, 0.00, 0, 1), (233, 0.00, 9, 0.00, 0, 0.00, 0, 1),
    (3, 0.00, 1, 1.00, 1, 1.00, 0, 1), (8, 0.00, 2, 1.00, 60, 0.00, 0, 1), (13, 0.00, 8, 0.00, 0, 0.00, 0, 1), (60, 0.05, 9, 0.00, 80, 0.00, 0, 1), (40, 0.25, 50, 0.00, 60, 0.10, 0, 1),
    (12, 0.33, 12, 0.25, 11, 0.30, 0, 1), (9, 0.45, 10, 0.50, 12, 0.40, 0, 1), (10, 0.50, 60, 0.00, 11, 0.55, 0, 1), (14, 0.55, 3, 1.00, 12, 0.50, 0, 1), (6, 1.00, 70, 0.00, 80, 0.00, 0, 1),
    (2, 1.00, 40, 0.00, 55, 0.02, 0, 1), (12, 0.80, 60, 0.00, 45, 0.00, 0, 1), (7, 1.00, 30, 0.10, 9, 0.20, 0, 1), (5, 1.00, 90, 0.00, 0, 0.00, 0, 1), (4, 1.00, 0, 0.00, 0, 0.00, 0, 1),
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 0), (3, 1.00, 2, 1.00, 3, 1.00, 0, 0), (8, 1.00, 9, 1.00, 7, 1.00, 0, 0), (15, 1.00, 14, 1.00, 16, 1.00, 0, 0), (6, 0.83, 5, 0.80, 6, 0.85, 0, 0),
    (1, 1.00, 40, 0.00, 1, 1.00, 0, 0), (3, 1.00, 60, 0.05, 4, 1.00, 0, 0), (8, 1.00, 90, 0.00, 7, 1.00, 0, 0), (2, 1.00, 0, 0.00, 1, 1.00, 0, 0), (5, 0.90, 3, 0.00, 6, 0.90, 0, 0),
    (1, 1.00, 1, 1.00, 30, 0.00, 0, 0), (4, 1.00, 3, 1.00, 70, 0.02, 0, 0), (7, 1.00, 8, 1.00, 0, 0.00, 0, 0), (2, 1.00, 2, 1.00, 5, 0.00, 0, 0), (6, 0.90, 5, 0.90, 60, 0.00, 0, 0),
)


@lru_cache(maxsize=1)
def tree() -> DecisionTree:
    """Its root asks whether the page marks the block as in its article; each side is trained on its table."""
    sides = [np.array(rows) for rows in (UNMARKED, MARKED)]
    out, marked = (DecisionTree(t[:, :-1], t[:, -1], DEPTH) for t in sides)
    out.root = (sides[0].shape[1] - 1, 0.5, out.root, marked.root)
    return out


def _hinted(name: str, classes: str, own_id: str) -> bool:
    """Whether class or id hint at what is no article. Ids of headings are anchors, and those of sections are, if they have other words as well."""
    if not classes and not own_id:
        return False
    words = set(re.split(r"[^a-z]+", own_id)) - {""}
    if name in HEADINGS or name == "section" and not words <= HINTS | BESIDE:
        words = set()
    for c in classes.split():
        if not LAYOUT.fullmatch(c):
            words.update(re.split(r"[^a-z]+", c))
    return not HINTS.isdisjoint(words)


class _Page:
    """Reads one page into blocks: (text, words, link words, in main, set apart, hinted, heading)."""

    def __init__(self) -> None:
        self.blocks: list[tuple] = []
        self.open: list[tuple[str, int, int, int, int]] = []  # element, its own marks as below, and the hints that a <main> suspends
        self.places: dict[str, list[int]] = {}  # of the open elements, by name
        self.inner: list[int] = []  # places of the open blocks
        self.main = self.apart = self.hints = 0  # how many open elements are in main, set apart, hinted
        self.runs: list[tuple[str, int, int, int, int]] = []  # text, in a link, and the marks where it stands
        self.link = 0
        self.heading = 0

    def flush(self) -> None:
        """The text since the last block as one block: runs that inline elements set apart or hint at go alone, unless all are such.

        A link reaches no further than the first block with text, so one that is never closed costs no more.
        """
        if self.runs:
            runs = [r for r in self.runs if not (r[3] or r[4])] if any(r[0].strip() and not (r[3] or r[4]) for r in self.runs) else self.runs
            words = " ".join("".join(r[0] for r in runs).split())
            if words:
                first = next(r for r in runs if r[0].strip())
                self.blocks.append((words, words.count(" ") + 1, sum(len(r[0].split()) for r in runs if r[1]), *first[2:], self.heading))
                self.link = 0
            self.runs = []

    def put(self, text: str) -> None:
        if text:
            self.runs.append((text, int(self.link > 0), int(self.main > 0), int(self.apart > 0), int(self.hints > 0)))

    def last(self, names: Iterable[str]) -> int:
        """Place of the innermost open element of these names, or -1."""
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=-1)

    def push(self, name: str, main: int, apart: int, hint: int) -> None:
        self.places.setdefault(name, []).append(len(self.open))
        if name in BLOCKS:
            self.inner.append(len(self.open))
        suspended = self.hints if main == 2 else 0
        self.open.append((name, int(main > 0), apart, hint, suspended))
        self.main, self.apart, self.hints = self.main + int(main > 0), self.apart + apart, self.hints + hint - suspended

    def drop(self, k: int) -> None:
        """End the element at place ``k``; what is open inside it stays."""
        name, main, apart, hint, suspended = self.open[k]
        if name:
            self.places[name].pop()
            self.open[k] = ("", 0, 0, 0, 0)
            self.main, self.apart, self.hints = self.main - main, self.apart - apart, self.hints - hint + suspended

    def close(self, k: int) -> None:
        """Close the open elements from place ``k`` on; each is closed once."""
        for x in range(len(self.open) - 1, k - 1, -1):
            self.drop(x)
        while self.inner and self.inner[-1] >= k:
            self.inner.pop()
        del self.open[k:]

    def start(self, name: str, attributes: str) -> None:
        own = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(ATTRIBUTE.finditer(attributes)))} if attributes.strip("/ \t\n\r") else {}
        if name in BLOCKS:
            self.flush()
            self.heading = int(name in HEADINGS)
            closed, around = CLOSED.get(name, ((), ()))
            if found := [self.places[x][-1] for x in closed if self.places.get(x)]:
                bound = self.last(around)
                if found := [k for k in found if k > bound]:
                    self.close(min(found))
            if self.inner and self.open[self.inner[-1]][0] == "p":
                self.close(self.inner[-1])
        elif name == "br":
            self.put(" ")
            return
        if name in VOID:
            return
        if name == "a":
            self.end("a")  # a link holds no other
            self.link = 1
        role = own.get("role", "").lower()
        main = 2 if name == "main" or role == "main" else int(name == "article" or role == "article")
        apart = int(name in APART or role in ROLES or name == "header" and not self.main and not main or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower())
        hint = int(main != 2 and name not in {"html", "body", "article"} and _hinted(name, own.get("class", "").lower(), own.get("id", "").lower()))
        if name in BLOCKS or main or apart or hint or self.places.get(name):
            self.push(name, main, apart, hint)

    def end(self, name: str) -> None:
        if name == "a":
            self.link = 0
        k = self.last((name,))
        if name in BLOCKS:
            self.flush()
            self.heading = 0
            if k > self.last(SCOPE.get(name, ())):
                self.close(k)
        elif k >= 0:
            if not self.inner or k > self.inner[-1]:
                self.close(k)
            elif name in FORMATTING:
                self.drop(k)

    def read(self, page: str) -> list[tuple]:
        at, n = 0, len(page)
        endless: set[str] = set()  # elements whose end tag was looked for in vain
        while at < n:
            m = TOKEN.search(page, at)
            if not m:
                self.put(html.unescape(page[at:]))
                break
            if m.start() > at:
                self.put(html.unescape(page[at : m.start()]))
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                self.end(name)
            elif name in SKIPPED and not m[3].endswith("/"):
                over = None if name in endless else re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I | re.A).search(page, at)
                if over is None and name not in RAW:
                    endless.add(name)
                    continue  # never closed: only its tag goes
                at = over.start() if over else n
            else:
                self.start(name, m[3])
        self.flush()
        return self.blocks


def blocks(page: str) -> list[tuple]:
    return _Page().read(page)


def main_text(page: str) -> str:
    """Article blocks in page order, two line ends between them.

    Tags discard what they set apart, and what lies outside where a page marks its article; the tree decides on the rest. What is
    discarded still counts as a neighbour.
    """
    found = blocks(page)
    density = [b[2] / b[1] for b in found]
    marked = any(b[3] for b in found)
    kept = []
    for k, (text, words, _, main, apart, hint, heading) in enumerate(found):
        if apart or hint or main < marked:
            continue
        before = (found[k - 1][1], density[k - 1]) if k else (0, 0.0)
        after = (found[k + 1][1], density[k + 1]) if k + 1 < len(found) else (0, 0.0)
        if tree().predict((words, density[k], *before, *after, heading, main)):
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; no shuffle."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
