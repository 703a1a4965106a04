"""Main text of web pages by line-block distribution.

A page's markup is cut away in one scan that leaves lines: the text of one block element each, with
the number of its characters that are link text and what the tags around it say. The lengths of
``WINDOW`` lines after one another are summed, less their link text. Where the sum surges the main
text begins, where it falls to nothing it ends, and the lines between surge and dive are kept.

Tags are weights of the lengths. Furniture by its element, role or hiding (menus, headers, footers,
sidebars, forms) weighs nothing. A class or id that names furniture leaves ``SOFT`` of a line's
length for each element that has one; so does standing outside the articles that a page marks,
``OUTSIDE``. Such lines are summed among their like, and surge only at a share of the page's largest
sum: a name alone doesn't hide the text that a page consists of. A line of a marked article weighs
as much as a surge at least, links too. Short lines go on with a run as long as the box stays the
same: the nearest element around them that lays out blocks.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines whose lengths are summed.
WINDOW = 3
#: A surge: so many characters in a window, or this share of the page's largest window if less.
SURGE_CHARS, SURGE_SHARE = 86, 0.2

#: What is left of a line's length in an element that a class or id names as furniture, and outside
#: marked articles.
SOFT, OUTSIDE = 0.02, 0.1
#: Characters that a window must have, whatever the page's largest, in an element named as furniture.
SOFT_CHARS = 200
#: A line with more link text than this share is a link.
LINK_SHARE = 0.6

#: Elements of HTML by their part in a page.
SILENT = frozenset("script style template noscript iframe object svg math canvas select textarea head audio video map".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button fieldset search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: Elements that a new block element of the same kind, or the end of their parent, closes.
SELF_CLOSING = frozenset("p li dt dd tr td th option thead tbody tfoot".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar tablist".split())
#: Words of a class or id that name page furniture.
NAMES = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner
    nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination topbar toolbar
    header masthead footer sidebar aside rail widget widgets
    cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup paywall
    comment comments disqus replies reply respond discussion
    share sharing social related recommended recommendations trending popular tags form login search copyright disclaimer""".split()
)
#: First words of a class or id that says what a page has or lacks, not what the element is.
FLAGS = frozenset("no not has have with without hide".split())
#: Elements that lay out blocks.
BOXES = frozenset("div section article main body td center blockquote".split())
#: Elements whose text is the article wherever they stand, unless furniture encloses them in it.
ARTICLE = frozenset(("article", "main"))

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_WORD = re.compile(r"[A-Za-z]+")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_SPACES = re.compile(r"\s+")


def _words(value: str) -> set[str]:
    """Words of a class or id that name furniture; names such as no-sidebar or with-banner don't."""
    out = set()
    for name in value.split():
        words = [x.lower() for x in _NAME.findall(name) + _WORD.findall(name)]
        if words and words[0] not in FLAGS:
            out |= NAMES.intersection(words)
    return out


def _furniture(tag: str, attributes: str) -> str:
    """What makes an element furniture: "hard" by element, role or hiding, else "header" or "soft" by the words of class and id; "" if nothing."""
    if tag in FURNITURE:
        return "hard"
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return ""
    words: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name == "hidden":
            return "hard"
        if name not in ("class", "id", "role", "aria-hidden", "style"):
            continue
        value = m[2] or m[3] or m[4] or ""
        if name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return "hard"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "hard"
        if name in ("class", "id") and tag not in ("html", "body"):
            words |= _words(value)
    return "" if not words else "header" if words == {"header"} else "soft"


class Line(NamedTuple):
    """A block's text, and the number of its characters that are link text.

    ``article`` is 0 outside articles, else 1 and the number of elements around the article that are
    furniture by class or id. ``box`` numbers the element that lays the block out, 0 for the page.
    """

    text: str
    linked: int
    furniture: bool
    article: int
    hard: bool
    soft: int
    box: int
    heading: bool


def lines_of(page: str) -> list[Line]:
    """Lines of a page in order."""
    lines: list[Line] = []
    parts: list[str] = []
    linked = at = boxes = 0
    # element, what makes it furniture, and around it: silent, furniture, article, hard, soft, box
    stack: list[tuple[str, str, bool, bool, int, bool, int, int]] = []
    silent = furniture = hard = False
    article = soft = box = 0  # soft: elements around that are furniture by class or id

    def end_line() -> None:
        nonlocal linked
        if parts:
            text = _SPACES.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                lines.append(Line(text, min(linked, len(text)), furniture, article, hard, soft, box, any(x[0] in HEADINGS for x in stack[-2:])))
            parts.clear()
        linked = 0

    def close_to(n: int) -> None:
        nonlocal silent, furniture, article, hard, soft, box
        while len(stack) > n:
            _, _, silent, furniture, article, hard, soft, box = stack.pop()

    def open_(tag: str, why: str) -> None:
        nonlocal furniture, hard, soft, box, boxes
        stack.append((tag, why, silent, furniture, article, hard, soft, box))
        if tag in BOXES and tag != "body":
            boxes += 1
            box = boxes
        if why:
            furniture = True
            hard |= why == "hard"
            soft += why != "hard"

    in_link = 0
    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            if not silent:
                parts.append(page[at:])
            break
        if m.start() > at and not silent:
            text = page[at : m.start()]
            parts.append(text)
            if in_link:
                linked += len(text.strip())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA[") and not silent:
                parts.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if tag == "a":
            in_link = 0 if m[1] else 1
        if tag in INLINE:
            if not (m[1] or tag in VOID) and (why := _furniture(tag, m[3])):
                end_line()
                open_(tag, why)
            elif m[1] and stack and stack[-1][0] == tag:
                end_line()
                close_to(len(stack) - 1)
            continue
        end_line()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close_to(i)
                    break
            continue
        if tag in VOID:
            continue
        if tag in SELF_CLOSING and stack and stack[-1][0] == tag:
            close_to(len(stack) - 1)
        if m[3].endswith("/") and tag not in ARTICLE | SILENT:
            continue
        if tag == "body":
            close_to(0)
        if tag in SILENT:
            open_(tag, "")
            silent = True
            if tag in ("script", "style", "textarea", "iframe", "noscript", "template"):  # no markup counts in them
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
                close_to(len(stack) - 1)
        elif tag in ARTICLE and not furniture:
            open_(tag, "")
            article = article or 1
        elif tag in ARTICLE and not (article or hard or _furniture(tag, m[3])):
            # furniture by words alone may be a wrapper of the layout; main_text decides
            open_(tag, "")
            furniture, article = False, 1 + soft
        else:
            why = _furniture(tag, m[3])
            inside = furniture
            open_(tag, why)
            if tag in HEADINGS and inside and article and not why:
                # the title in the article's own header belongs to it
                cause, name = next((t, w) for t, w, _, before, *_ in reversed(stack[:-1]) if not before)
                furniture = cause != "header" and name != "header"
                hard = hard and furniture
    end_line()
    return lines


def _runs(lines: list[Line], weight: list[float], own: list[float], window: list[float], surge: float) -> list[int]:
    """Places of the lines between surge and dive: a run begins by the sums within a box, ``own``."""
    kept: list[int] = []
    n, i = len(lines), 0
    while i < n:
        if own[i] < surge or not weight[i]:
            i += 1
            continue
        begin = i
        while begin and weight[begin - 1] and (lines[begin - 1].box == lines[begin].box or lines[begin - 1].heading):  # a heading or a short first line
            begin -= 1
        end = i + 1
        while end < n and window[end] > 0 and (window[end] >= surge or lines[end].box == lines[end - 1].box or lines[end].heading):
            end += 1
        kept += [j for j in range(begin, end) if weight[j]]
        i = end
    return kept


def _whole_boxes(lines: list[Line], weight: list[float], kept: list[int]) -> set[int]:
    """``kept``, and of each box that holds some of it all lines up to its last one that is no link."""
    first: dict[int, int] = {}
    for i in kept:
        first.setdefault(lines[i].box, i)
    last = {line.box: i for i, line in enumerate(lines) if weight[i]}
    return {*kept, *(i for i, line in enumerate(lines) if line.box and first.get(line.box, len(lines)) <= i <= last.get(line.box, -1))}


def main_text(page: str | None) -> str:
    """The article of a page: its lines joined by line feeds; empty for null, empty or bare pages."""
    lines = lines_of(page) if page else []
    level = min((x.article for x in lines if x.article and not x.furniture), default=0)
    if level > 1:  # all articles are inside furniture by words: they are the text unless other text outweighs them
        inside = sum(len(x.text) for x in lines if x.article == level and not x.furniture)
        if inside < sum(len(x.text) - x.linked for x in lines if not x.article and not x.furniture):
            level = 0
    # lines that tags speak of alike are summed among themselves
    kinds: dict[tuple[bool, int], list[int]] = {}
    for i, x in enumerate(lines):
        if not x.hard:
            inside = bool(level) and x.article == level and not x.furniture
            depth = 0 if inside else max(x.soft, int(x.furniture)) + max(0, x.article - 1 if not level else 0)
            kinds.setdefault((bool(level) and not inside, depth), []).append(i)
    summed = {}
    for (outside, depth), places in kinds.items():
        some, factor = [lines[i] for i in places], (OUTSIDE if outside else 1) * SOFT**depth
        if level and not outside:
            weight = [float(max(len(x.text), SURGE_CHARS)) for x in some]
        else:
            weight = [0.0 if x.linked > LINK_SHARE * len(x.text) else factor * (len(x.text) - x.linked) for x in some]
        own = [sum(w for x, w in zip(some[i : i + WINDOW], weight[i : i + WINDOW]) if x.box == some[i].box) for i in range(len(some))]
        # what names itself furniture stands for itself: no window reaches out of its box
        window = own if depth else [sum(weight[i : i + WINDOW]) for i in range(len(some))]
        summed[outside, depth] = some, weight, own, window
    top = max((w for *_, window in summed.values() for w in window), default=0)
    kept: list[int] = []
    for (outside, depth), (some, weight, own, window) in summed.items():
        surge = SURGE_SHARE * top
        if not outside and not depth:
            surge = min(SURGE_CHARS, surge)
        elif depth:
            surge = max(surge, SOFT_CHARS * (OUTSIDE if outside else 1) * SOFT**depth)
        if top:
            kept += [kinds[outside, depth][i] for i in _whole_boxes(some, weight, _runs(some, weight, own, window, surge))]
    return "\n".join(lines[i].text for i in sorted(kept))


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points).

    A null or empty html has the empty text. Repeated rows are each extracted; extra columns are
    ignored; an empty table gives no rows. Very long pages are scanned once from start to end.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    columns = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return columns.mapInArrow(run, "page_id long, url string, text string, n_chars long")
