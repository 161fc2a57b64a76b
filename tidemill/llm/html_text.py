"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The parser's events are cut into lines at block elements. A line has its text, the number of tags in it and the element
that holds it. Scripts, controls and hidden elements give no lines. Tags, roles, classes and ids that name furniture (a
menu, a footer, a form) decide after parsing (``furniture``), as they may wrap the article too, or not be closed. The ratio of text to tags of the lines is smoothed
with a Gaussian, and the lines from the threshold up are the content cluster. The content region is the smallest element
that holds all lines of that cluster, links aside. Article and main elements are preferred: if they hold half or more of
the cluster's text, the region is the union of all of them that have lines of it, and text outside them is not main
text. All lines of the region are the main text, so a short paragraph between long ones stays; without an article or main,
whole lists of links, and links and copyright notices at the region's ends, are not part of it (``trimmed``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import table

SIGMA = 1.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre
    search section summary table tbody td tfoot th thead title tr ul""".split())
SKIPPED = frozenset("""audio canvas datalist embed head iframe input map noscript object option script select style svg
    template textarea title video""".split())
#: Furniture by tag; the first ones hold no main text without an article, whatever their size.
MENUS = frozenset("menu nav search".split())
FURNITURE = MENUS | frozenset("aside dialog fieldset footer form header".split())
#: Text of these is part of a sentence inside the elements named after them, else of a control.
CONTROLS = frozenset("button label legend".split())
SENTENCES = frozenset("p h1 h2 h3 h4 h5 h6 blockquote figcaption".split())
SKIPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
SKIPPED_NAMES = frozenset("""ad ads adbox advert advertisement advertising adverts adsense banner breadcrumb breadcrumbs
    comment comments commentlist consent cookie cookies disqus footer gdpr masthead menu menubar modal nav navbar
    navigation newsletter notice notices notification pagination popup promo promotion related respond share sharing
    sidebar signup social sponsor sponsored subscribe subscription toolbar widget""".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Prose that an element of a furniture tag holds at least if it stands for the page.
LEAST_PROSE = 200
LINK_LIST = 3
COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
#: Lists, tables and quotes are content of the element around them, not regions; cells lay out old pages.
REGIONS = frozenset("article body center div main section td".split())
#: Elements that end an open element of the same list when they begin.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",)}
ENDS_P = BLOCK - {"br", "body", "html", "head", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option",
                  "legend"}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",),
         "option": ("select",), "p": ("td", "th", "button", "table")}
SPACES = re.compile(r"\s+")


def marked(tag: str, attrs) -> bool:
    """Whether a class or id of the element has a word that names furniture."""
    return tag not in ("html", "body", "main", "article") and any(
        name in ("class", "id") and value and not SKIPPED_NAMES.isdisjoint(re.split(r"[^a-z0-9]+", value.lower()))
        for name, value in attrs)


class Lines(HTMLParser):
    """Lines of a page, those of furniture too. Element 0 stands for the page; ``parents``, ``names``, ``marked`` (by class or
    id) and ``tagged`` (by tag or role) are by element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.names, self.parents, self.marked, self.tagged = ["body"], [-1], [False], [False]
        #: Name, element, whether skipped, whether in a link.
        self.open: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        #: Depths of the open elements of a name, of the open block elements, and of those that give no lines.
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]
        self.skips: list[int] = [0]
        self.headings = 0
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.places: list[int] = []
        self.pieces: list[list[tuple[int, str, bool]]] = []
        self.heads: list[bool] = []
        self.part: list[tuple[int, str, bool]] = []
        self.seen = 0

    def _depth(self, *names: str) -> int:
        """Depth of the innermost open element of these names, 0 for none."""
        found = 0
        for name in names:
            if (depths := self.depths.get(name)) and depths[-1] > found:
                found = depths[-1]
        return found

    def _skipped(self, tag: str, attrs) -> bool:
        if self.open[-1][2] or tag in SKIPPED:
            return True
        if tag in CONTROLS:
            return self.open[self.blocks[-1]][0] not in SENTENCES
        return tag not in ("html", "body", "main", "article") and any(
            name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attrs)

    def _tagged(self, tag: str, attrs) -> bool:
        if tag in ("html", "body", "main", "article"):
            return False
        if tag == "header" and self._depth("article", "main"):
            return False
        return tag in FURNITURE or any(name == "role" and value and value.lower() in SKIPPED_ROLES for name, value in attrs)

    def _line(self) -> None:
        text = SPACES.sub(" ", "".join(x for _, x, _ in self.part)).strip()
        if text:
            self.texts.append(text)
            self.tags.append(self.seen)
            self.places.append(self.open[-1][1])
            self.pieces.append(self.part)
            self.heads.append(self.headings > 0)
            self.seen = 0
        self.part = []

    def _close_to(self, depth: int) -> None:
        for name, *_ in self.open[depth:]:
            self.depths[name].pop()
            self.headings -= name in HEADINGS
        del self.open[depth:]
        while self.skips[-1] >= depth:
            self.skips.pop()
        while self.blocks[-1] >= depth:
            self.blocks.pop()

    def _end(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        depth = self._depth(*tags)
        if depth > self.skips[-1] and depth > self._depth(*scope):
            self._close_to(depth)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._line()
            if tag in ENDS_P:
                self._end(("p",), SCOPE["p"])
            if tag in ENDS:
                self._end(ENDS[tag], SCOPE[tag])
        self.seen += 1
        if tag in VOID:
            return
        place = self.open[-1][1]
        out = self._skipped(tag, attrs)
        mark, furnishes = not out and marked(tag, attrs), not out and self._tagged(tag, attrs)
        if not out and (mark or furnishes or tag in REGIONS):
            self.names.append(tag)
            self.parents.append(place)
            self.marked.append(mark)
            self.tagged.append(furnishes)
            place = len(self.names) - 1
        self.depths.setdefault(tag, []).append(len(self.open))
        self.headings += tag in HEADINGS
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        if tag in SKIPPED:
            self.skips.append(len(self.open))
        self.open.append((tag, place, out, self.open[-1][3] or tag == "a" and any(name == "href" for name, _ in attrs)))

    def handle_startendtag(self, tag, attrs):
        # <div/> opens an element in HTML, only void ones do not.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._line()
        depth = self._depth(tag)
        if tag == "p" and not depth:
            return
        self.seen += 1
        if depth and (tag in BLOCK or depth > self.blocks[-1]):
            self._close_to(depth)

    def handle_data(self, data):
        if not self.open[-1][2]:
            self.part.append((self.open[-1][1], data, self.open[-1][3]))

    def end(self) -> Lines:
        self.close()
        self._line()
        return self


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; beyond the ends the end values go on."""
    reach = max(1, int(3 * sigma + 0.5))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, reach, mode="edge"), weights / weights.sum(), mode="valid")


def cluster(page: Lines, sigma: float = SIGMA) -> np.ndarray:
    """Which lines are in the content cluster."""
    size = np.array([len(x) for x in page.texts], dtype=float)
    score = smoothed(size / np.maximum(1, page.tags), sigma)
    return score >= min(score.std(), score.max())


def furniture(page: Lines, sigma: float = SIGMA) -> list[bool]:
    """Which elements are furniture: marked and tagged ones, and all in them, unless they hold the article or most prose.

    Such an element stays if it holds an article or main with more text than all those beside it (comments may be
    articles too), or if it holds the larger part of the cluster's prose (text outside links) and no article stands
    beside it; a menu never stays by that, and what is furniture by tag needs ``LEAST_PROSE`` characters. Beside it are
    the articles that do not hold it and that no further such element parts from it. If nothing of the cluster would be
    left, names do not decide, only tags.
    """
    n = len(page.names)
    text, mass, own = [0] * n, [0] * n, [0] * n
    for pieces, chosen in zip(page.pieces, cluster(page, sigma).tolist(), strict=True):
        for place, x, link in pieces:
            size = len(SPACES.sub(" ", x).strip())
            text[place] += size
            own[place] += size * chosen
            mass[place] += size * (chosen and not link)
    for i in range(n - 1, 0, -1):  # children come after their parents
        mass[page.parents[i]] += mass[i]
    either = [a or b for a, b in zip(page.marked, page.tagged, strict=True)]
    gone = _decided(page, either, text, mass)
    if any(m and not g for m, g in zip(own, gone, strict=True)):
        return gone
    return _decided(page, page.tagged, text, mass)


def _decided(page: Lines, marks: list[bool], text: list[int], mass: list[int]) -> list[bool]:
    n = len(page.names)
    scope, article = [0] * n, [0] * n  # innermost marked element, and innermost article or main, with the element itself
    inner, largest, direct, free = [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n):
        up = max(0, page.parents[i])
        scope[i] = i if marks[i] else scope[up]
        article[i] = i if page.names[i] in ("article", "main") else article[up]
        if article[i]:
            inner[article[i]] += text[i]
            if scope[i] == scope[article[i]]:
                direct[article[i]] += text[i]
                free[scope[i]] += text[i]
    for i in range(n - 1, 0, -1):
        largest[page.parents[i]] = max(largest[page.parents[i]], largest[i], inner[i])
    chain = direct.copy()
    others, opened, gone = [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        up = page.parents[i]
        same = article[up] and scope[article[up]] == scope[up]
        if article[i] == i and same:
            chain[i] += chain[article[up]]
        if marks[i]:
            others[i] = free[scope[up]] - (chain[article[up]] if same else 0)
            if largest[i] > others[i]:
                opened[scope[up]] += largest[i]
    for i in range(1, n):
        up = page.parents[i]
        large = 2 * mass[i] > mass[0] and not (
            page.tagged[i] and (page.names[i] in MENUS or article[up] or mass[i] < LEAST_PROSE))
        gone[i] = gone[up] or marks[i] and largest[i] <= others[i] and (others[i] + opened[scope[up]] > 0 or not large)
    return gone


def settle(page: Lines, sigma: float = SIGMA) -> Lines:
    """``page`` without the lines, and the pieces of lines, that lie in furniture."""
    if not page.texts or not any(page.marked) and not any(page.tagged):
        return page
    gone = furniture(page, sigma)
    staying = list(range(len(gone)))
    for i, out in enumerate(gone):
        if out:
            staying[i] = staying[page.parents[i]]
    lines = zip(page.texts, page.tags, page.places, page.pieces, page.heads, strict=True)
    page.texts, page.tags, page.places, page.pieces, page.heads, seen = [], [], [], [], [], 0
    for text, tags, place, pieces, head in lines:
        seen += tags
        kept = [piece for piece in pieces if not gone[piece[0]]]
        if len(kept) < len(pieces):
            text = SPACES.sub(" ", "".join(x for _, x, _ in kept)).strip()
        if text:
            page.texts.append(text)
            page.tags.append(seen)
            page.places.append(staying[place])
            page.pieces.append(kept)
            page.heads.append(head)
            seen = 0
    return page


def content(page: Lines, sigma: float = SIGMA) -> list[str]:
    """The lines of the content region."""
    page = settle(page, sigma)
    if not page.texts:
        return []
    size = np.array([len(x) for x in page.texts], dtype=float)
    places = np.array(page.places)
    dense = cluster(page, sigma)
    links = np.array([sum(len(SPACES.sub(" ", x).strip()) for _, x, link in pieces if link) for pieces in page.pieces])
    prose = dense & (2 * links < size)
    chosen = prose if prose.any() else dense
    mass, held = np.zeros(len(page.names)), np.zeros(len(page.names), dtype=int)
    np.add.at(mass, places[chosen], size[chosen])
    np.add.at(held, places[chosen], 1)
    for i in range(len(mass) - 1, 0, -1):  # children come after their parents
        mass[page.parents[i]] += mass[i]
        held[page.parents[i]] += held[i]
    outer, top = [], [0] * len(mass)  # outermost articles and mains; the one that an element lies in
    for i, name in enumerate(page.names):
        top[i] = top[max(0, page.parents[i])] or (i if name in ("article", "main") else 0)
        if i and top[i] == i and held[i]:
            outer.append(i)
    if 2 * sum(mass[i] for i in outer) >= mass[0]:
        smallest = {i: i for i in outer}
        for i, name in enumerate(page.names):
            if name in ("article", "main") and top[i] in smallest and held[i] == held[top[i]]:
                smallest[top[i]] = i
        regions, by_name = list(smallest.values()), True
    else:
        by_name = False
        regions = [max(i for i, n in enumerate(page.names) if n in REGIONS and held[i] == held[0])]
    inside = np.zeros(len(mass), dtype=bool)
    inside[regions] = True
    for i in range(1, len(mass)):
        inside[i] |= inside[page.parents[i]]
    kept = np.flatnonzero(inside[places])
    if not by_name:
        # A heading may be a link to its own page.
        only_links = (10 * links >= 9 * size) & ~np.array(page.heads)
        kept = trimmed(kept, only_links, [bool(COPYRIGHT.match(x)) for x in page.texts], prose.any())
    return [page.texts[i] for i in kept]


def trimmed(lines: np.ndarray, only_links: np.ndarray, notices: list[bool], prose: bool) -> np.ndarray:
    """``lines`` of a region that no article names, without ``LINK_LIST`` or more link lines in a row and without link lines
    and copyright notices at both ends; if there is no prose at all, the links are the text and stay."""
    if prose:
        a = 0
        while a < len(lines):
            b = a
            while b < len(lines) and only_links[lines[b]]:
                b += 1
            if b - a >= LINK_LIST:
                lines = np.delete(lines, slice(a, b))
            else:
                a = max(a + 1, b)
    first, last = 0, len(lines)
    while prose and first < last and only_links[lines[first]]:
        first += 1
    while first < last and (notices[lines[last - 1]] or prose and only_links[lines[last - 1]]):
        last -= 1
    return lines[first:last]


def main_text(html: str) -> str:
    page = Lines()
    page.feed(html)
    return " ".join(content(page.end()))


def _extract(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *batch.columns[at + 1:], pa.array(texts, pa.string())],
                                             names=[*(str(i) for i in range(batch.num_columns - 1)), "text"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with its column ``html`` replaced by ``text``, the main text, and ``n_chars``.

    Null html counts as empty; a page without content has an empty text; markup that is cut off or not closed is read
    as far as it goes; an empty table gives an empty result. Columns named text or n_chars give way to the results.
    """
    pages = pages.drop("text", "n_chars")
    at = [c.lower() for c in pages.columns].index("html")
    kept = [f for i, f in enumerate(pages.schema.fields) if i != at]
    inner = T.StructType([*(T.StructField(str(i), f.dataType) for i, f in enumerate(kept)), T.StructField("text", T.StringType())])
    out = pages.withColumn(pages.columns[at], F.col(f"`{pages.columns[at]}`").cast("string")).mapInArrow(_extract(at), inner)
    return out.select(*(F.col(f"`{i}`").alias(f.name) for i, f in enumerate(kept)), "text",
                      F.length("text").cast("long").alias("n_chars"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: ``page_id``, ``url``, ``text`` (the article, in one line) and ``n_chars``."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
