"""Main text of web pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines, one for each
block of text, with the tags met since the line before. The ratio of text to
tags, smoothed by a Gaussian over neighbouring lines, is high where prose runs;
a threshold clusters the lines into content and the rest. Content lines point to
the parts of the page that hold them, whose whole text is the result; no content
line is left out. Lines of navigation and the like take no part, nor do forms and
elements named like furniture unless they hold most of the page's content lines.
Reader comments take no part however long they are.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltworks.llm.common import Batches, arrow_type, scan

SCHEMA = "page_id long, url string, text string, n_chars long"

# Element and role names of the HTML and ARIA standards.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
NOT_CONTENT = frozenset(
    "aside button canvas dialog embed footer head iframe input label map menu nav noembed noframes noscript object script select "
    "style svg template textarea title audio video".split()
)
NOT_CONTENT_ROLES = frozenset(
    "alert alertdialog banner comment complementary contentinfo dialog form menu menubar navigation search status toolbar tooltip".split()
)
#: Words of class and id names that mark page furniture.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies "
    "copyright disclaimer disqus footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices "
    "overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
#: Words of names of reader comments, and words beside them by which a name only tells that there are such.
COMMENTS = frozenset("comment comments discussion discussions disqus replies reply responses".split())
FLAGS = frozenset("allow allowed can closed count disabled enabled has hide no off on open show status toggle with without".split())
#: Begins the name under which a form is an element named like furniture.
FORM = "form"
#: Elements that hold more than this share of the content lines' text hold most of it.
MOST = 0.5
_NAME = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_TAG = re.compile(r"<[a-zA-Z/!?]")
# Tags whose start ends an open paragraph of the same kind.
_ENDED_BY_SAME = frozenset(["p", "li", "dt", "dd", "tr", "td", "th", "option"])


def is_furniture(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> bool:
    """Whether tag, role or state make an element furniture, whatever it holds."""
    if tag in NOT_CONTENT or tag == "header" and not inside_article:
        return True
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value and value.lower() in NOT_CONTENT_ROLES:
            return True
        if name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def furniture_names(tag: str, attrs: list[tuple[str, str | None]]) -> frozenset[str]:
    """Class names and ids with words of furniture. Layout flags have such words too, so what the element holds decides.

    So it does for a form, as some servers put whole pages into one.
    """
    found: set[str] = {" ".join([FORM, *[value or "" for name, value in attrs if name in ("class", "id")]])} if tag == "form" else set()
    for name, value in attrs:
        if name in ("class", "id") and value and tag not in ("html", "body", "main"):
            words = {own: words_of(own) for own in value.split()}
            if not (tag == "article" and any(w & {"main", "post", "entry", "story"} for w in words.values())):
                found |= {own for own, w in words.items() if w & (FURNITURE | COMMENTS)}
    return frozenset(found)


def words_of(name: str) -> set[str]:
    return set(_NAME.findall(_CAMEL.sub(" ", name).lower()))


def names_comments(name: str) -> bool:
    """Whether a name stands for reader comments themselves, as ``comment-list`` does and ``has-comments`` doesn't."""
    words = words_of(name)
    return bool(words & COMMENTS) and not words & FLAGS


#: Elements of one tag with the same names of furniture are of one kind.
Kinds = frozenset[tuple[str, frozenset[str]]]
#: Text, tags since the line before, the innermost place around it.
Line = tuple[str, int, int]


def joined(parts: list[tuple[str, Kinds]]) -> str:
    return _SPACE.sub(" ", "".join([text for text, _ in parts])).strip(" ")


class Lines(HTMLParser):
    """Lines of text outside furniture, and the tree of places, the elements that can hold content.

    Places are numbered as they open, so a parent has the smaller number; 0 is
    the page. ``named`` has the parts of lines with text in elements named like furniture, and the kinds of these.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.named: dict[int, list[tuple[str, Kinds]]] = {}
        self.stack: list[tuple[str, bool, int]] = []  # tag, furniture from here on, id of the element
        self.kinds: list[tuple[int, Kinds]] = [(0, frozenset())]  # open elements named like furniture, and all kinds so far
        self.open: dict[str, int] = {}
        self.parents = [0]  # of each place
        self.path = [(0, 0)]  # open places: id of the element, place
        self.articles: set[int] = set()
        self.parts: list[tuple[str, Kinds]] = []
        self.tags = 0
        self.elements = 0

    def flush(self) -> None:
        text = joined(self.parts)
        if text.strip():
            if any(kinds for _, kinds in self.parts):
                self.named[len(self.lines)] = self.parts
            self.lines.append((text, self.tags, self.path[-1][1]))
            self.tags = 0
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.parts.append((" ", self.kinds[-1][1]))
        if tag in VOID:
            return
        if tag in _ENDED_BY_SAME and self.stack and self.stack[-1][0] == tag:
            self._pop()
        outer = bool(self.stack) and self.stack[-1][1]
        furniture = outer or is_furniture(tag, attrs, bool(self.open.get("article")))
        self.elements += 1
        if tag in BLOCKS and tag not in _ENDED_BY_SAME and not furniture:
            self.parents.append(self.path[-1][1])
            self.path.append((self.elements, len(self.parents) - 1))
            if tag in ("article", "main"):
                self.articles.add(len(self.parents) - 1)
        names = frozenset() if furniture else furniture_names(tag, attrs)
        if names:
            self.kinds.append((self.elements, self.kinds[-1][1] | {(tag, names)}))
        self.stack.append((tag, furniture, self.elements))
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if not self.open.get(tag):
            return
        while self._pop() != tag:
            pass

    def _pop(self) -> str:
        tag, _, element = self.stack.pop()
        self.open[tag] -= 1
        if self.path[-1][0] == element:
            self.path.pop()
        if self.kinds[-1][0] == element:
            self.kinds.pop()
        return tag

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][1]):
            self.parts.append((data, self.kinds[-1][1]))


def lines_of(html: str) -> Lines:
    """Parse a page; a tag cut off at its end is no text, nor is what follows it."""
    unfinished = _TAG.search(html, html.rfind(">") + 1)
    html = html[: unfinished.start()] if unfinished else html
    parser = Lines()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # older parsers give up at an unknown marked section
        parser = Lines()
        parser.feed(html.replace("<![", "<!--["))
        parser.close()
    parser.flush()
    return parser


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian average over neighbouring lines; lines beyond the page do not count."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    middle = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[middle] / np.convolve(np.ones(len(ratios)), kernel)[middle]


def content_lines(lines: list[Line], sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """The length of every line, and whether it is content."""
    sizes = np.array([len(text) for text, _, _ in lines], float)
    ratios = smoothed(sizes / np.maximum([tags for _, tags, _ in lines], 1), sigma)
    return sizes, ratios >= min(ratios.std(), ratios.max())


def without_furniture(page: Lines, sigma: float) -> list[Line]:
    """Lines without the texts of elements named like furniture, but for kinds that hold most of the content lines.

    Beside articles with content, a kind whose names are words of furniture and
    no more, such as ``ad``, and a form are furniture whatever they hold. Reader
    comments are, unless no content line is outside them.
    """
    if not page.named:
        return page.lines
    sizes, content = content_lines(page.lines, sigma)
    inside = within(page.parents, page.articles)
    held: dict[tuple[str, frozenset[str]], float] = {}
    in_articles: list[Kinds] = []
    written = 0
    for line in np.flatnonzero(content).tolist():
        is_article = inside[page.lines[line][2]]
        for text, kinds in page.named.get(line, [(page.lines[line][0], frozenset())]):
            for kind in kinds:
                held[kind] = held.get(kind, 0) + len(text.strip())
            written += len(text.strip())
            if is_article and text.strip():
                in_articles.append(kinds)
    names = {kind for kind, size in held.items() if size > MOST * sizes[content].sum()}
    names = {k for k in names if any(own.lower() not in FURNITURE and own.split()[0] != FORM for own in k[1]) or all(k in kinds for kinds in in_articles)}
    names = {k for k in names if held[k] == written or not any(map(names_comments, k[1]))}
    lines, before = [], 0
    for line, (text, tags, place) in enumerate(page.lines):
        if line in page.named:
            text = joined([part for part in page.named[line] if part[1] <= names])
        before += tags
        if text.strip():
            lines.append((text, before, place))
            before = 0
    return lines


def within(parents: list[int], places: set[int]) -> list[bool]:
    """Whether each place is one of ``places`` or lies in one."""
    inside = [0 in places]
    for place in range(1, len(parents)):
        inside.append(place in places or inside[parents[place]])
    return inside


def summed(parents: list[int], places: list[int], values: list[float]) -> list[float]:
    """For each place, the values of the lines in it and below."""
    sums = [0.0] * len(parents)
    for place, value in zip(places, values, strict=True):
        sums[place] += value
    for place in range(len(parents) - 1, 0, -1):
        sums[parents[place]] += sums[place]
    return sums


def parts_with(places: list[int], sizes: list[float], page: Lines) -> list[bool]:
    """Whether each place is in a part of the page that holds content lines; those have the given places and sizes.

    A content line in no part stands alone.
    """
    parents, articles = page.parents, page.articles
    held = summed(parents, places, sizes)
    in_article = within(parents, articles)
    if sum(size for place, size in zip(places, sizes, strict=True) if in_article[place]) > MOST * held[0]:
        chosen = {a for a in articles if held[a]}
    else:
        # The innermost element with most of it.
        chosen = {max((p for p in range(1, len(parents)) if held[p] >= 0.7 * held[0]), default=0)} - {0}
    # Content lines beside them: the innermost element around those of a neighbour of a part.
    inside = within(parents, chosen)
    above = summed(parents, list(chosen), [1.0] * len(chosen))
    beside = summed(parents, places, [float(not inside[place]) for place in places])
    neighbour = [0] * len(parents)
    around: dict[int, int] = {}
    for place in range(1, len(parents)):
        if inside[place] or above[place]:
            continue
        neighbour[place] = neighbour[parents[place]] or place
        if beside[place] and beside[place] == beside[neighbour[place]]:
            around[neighbour[place]] = place
    return within(parents, chosen | set(around.values()))


def main_text(html: str, sigma: float = 1.0) -> str:
    """The blocks of the parts of the page that hold its content lines, one to a line.

    Articles are the parts if they hold most of the content lines' text, else
    the innermost element with 70 % of it. Content lines beside them stay, with
    the innermost element that holds those of one neighbour. The work grows with
    the length of the page, however deep it is.
    """
    page = lines_of(html)
    lines = without_furniture(page, sigma)
    if not lines:
        return ""
    sizes, content = content_lines(lines, sigma)
    inside = parts_with([place for _, _, place in compress(lines, content)], sizes[content].tolist(), page)
    return "\n".join(text for (text, _, place), is_content in zip(lines, content, strict=True) if is_content or inside[place])


def extract_pages(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    sigma: float = 1.0,
) -> DataFrame:
    """The main text of every page with its length in code points.

    One row per input row, repeated rows included. Null, empty and text-free
    pages give an empty text; a broken page gives what its parser events hold.
    No shuffle.
    """

    def run(batches: Batches) -> Batches:
        out = arrow_type(SCHEMA)
        for batch in batches:
            texts = [main_text(h or "", sigma) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                schema=out,
            )

    return scan(pages, {"page_id": id_col, "url": url_col, "html": html_col}, run, SCHEMA)
