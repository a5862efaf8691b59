"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of text.  Tags of blocks that
stand between two lines beyond one that ends and one that begins leave empty
lines, so that a change of part shows in the distribution.  A line weighs its
text's length; headings weigh half a surge more, and lines inside an article or
main element a surge more.  Lines of links alone outside these, and lines of parts
that are no article by their element, role or name (menus, adverts, forms, reader
comments and the like), weigh nothing (a form that holds the page's own parts is
none, and words that also name subjects need words of layout beside them); so do lines outside article and main
where these hold half of all weight.

The weights are summed over a sliding window of WINDOW lines.  Text surges at a
line of half the threshold where the window's sum reaches the threshold and the
next window is not empty, and dives at an empty line where the next window's sum
is below a fourth of it; the lines of weight between are the text.  The threshold
is SURGE characters, or a fourth of the page's fullest window where that is less,
so that short pages have text.

Defined results: null or empty html gives an empty text; a page without any
line of weight too; equal rows give equal rows; a page of any length is read
whole, in time proportional to it; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80

# Elements by their part in a page, and words in class, id or role that name a part.
RAW = {"script", "style", "textarea", "iframe", "title", "noframes", "xmp"}
APART = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "label", "fieldset", "datalist", "select", "noscript", "template", "svg", "math", "object", "canvas", "audio", "video", "head"}
IN_HEAD = {"base", "link", "meta", "noscript", "template", "object", *RAW}
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
APART_NAMES = re.compile(
    r"(?i)ads?|adverts?|advertis\w+|adsense|sponsor\w*|promos?|promotions?|banner|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscri\w+|sidebar|"
    r"nav|navbar|navigation|menus?|breadcrumbs?|pagination|pager|toolbar|header|masthead|footer|comments?|replies|discussion|disqus|respond|share|sharing|social|related|recommend\w*|"
    r"widgets?|login|signup|search|copyright|disclaimer|hidden"
)
#: Of these, words that also name subjects ("social-history", "market-share"): they count only beside words of layout.
SUBJECTS = {"social", "search", "share", "sharing", "related", "discussion", "comments", "replies", "notices", "alerts", "header", "hidden", "copyright", "promotions"}
LAYOUT = re.compile(
    r"bar|box|form|field|input|button|btn|links?|icons?|list|items?|block|panel|pane|wrap|wrapper|container|inner|outer|section|area|region|row|col|column|top|bottom|left|right|side|site|page|global|main|primary|secondary|mobile|"
    r"desktop|fixed|sticky|small|large|post|posts|article|articles|story|stories|content|text|entry|user|reader|thread|tools?|actions?|media|buttons|this|on|us|title|head|count|toggle|results?|print|js|is|the|x?\d+|[a-z]"
)
#: Elements that make the form around them the page's wrapper.
PAGE_PARTS = {*MAIN, "h1"}
#: A name of such words alone marks text, whatever stands beside it.
TEXT_NAMES = {"article", "story", "content", "entry", "post", "main", "text", "body"}
APART_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_UNSEEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I) for x in RAW}


def named_apart(value: str, in_main: bool) -> bool:
    """Whether a class or id names a part that is no article."""
    apart = False
    for name in value.lower().split():
        parts = [x for x in re.split(r"[_-]+|(?<=[a-z])(?=\d)", name) if x]
        if parts and all(x in TEXT_NAMES for x in parts):
            return False
        if not parts or parts[0] in ("no", "has", "with", "without"):
            continue
        layout = all(APART_NAMES.fullmatch(x) or LAYOUT.fullmatch(x) for x in parts)
        if any(APART_NAMES.fullmatch(x) and (layout or x not in SUBJECTS) and not (in_main and x == "header") for x in parts):
            apart = True
    return apart


def _apart(name: str, attributes: str, in_main: bool) -> bool:
    if name in APART or name == "header" and not in_main:
        return True
    if not attributes.strip():
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id") and name not in ("body", "html", *MAIN) and named_apart(value, in_main):
            return True
        if key == "role" and value.lower() in APART_ROLES or key == "hidden" and name != "html" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and _UNSEEN.search(value):
            return True
    return False


class Open:
    """The open elements, with what is asked of them at hand."""

    def __init__(self):
        self.names: list[str] = []
        self.aparts: list[bool] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of elements that are not inline
        self.apart = self.mains = self.apart_mains = 0

    def push(self, name: str, apart: bool) -> None:
        k = len(self.names)
        self.names.append(name)
        self.aparts.append(apart)
        self.at.setdefault(name, []).append(k)
        if name not in INLINE:
            self.blocks.append(k)
        self.apart += apart
        self.mains += name in MAIN
        self.apart_mains += apart and name in MAIN

    def pop(self) -> bool:
        """Close the innermost element; whether it started a part that is no article."""
        name, apart = self.names.pop(), self.aparts.pop()
        self.at[name].pop()
        if name not in INLINE:
            self.blocks.pop()
        self.apart -= apart
        self.mains -= name in MAIN
        self.apart_mains -= apart and name in MAIN
        return apart

    def unwrap(self) -> None:
        """Forms that are open and lie in no other part that is no article turn out to hold the page."""
        forms = self.at.get("form")
        if forms and self.apart == sum(self.aparts[k] for k in forms):
            for k in forms:
                self.aparts[k] = False
            self.apart = 0
            self.apart_mains = 0

    def place(self, name: str) -> int | None:
        """Where the element is that an end tag closes, if there is one; an inline one ends no block."""
        k = self.at.get(name)
        if not k or name in INLINE and self.blocks and self.blocks[-1] > k[-1]:
            return None
        return k[-1]


def lines(page: str) -> tuple[list[str], list[int], list[int]]:
    """The page's blocks of text in order, the weight of each, and the empty lines before each."""
    texts, weights, gaps, within, parts = [], [], [], [], []
    stack, at, end = Open(), 0, len(page)
    anchor, linked, heading, tags = False, 0, False, 0

    def flush() -> None:
        nonlocal linked, tags
        text = " ".join(htmllib.unescape("".join(parts)).split())
        parts.clear()
        if text:
            only_links = not stack.mains and 10 * linked >= 8 * len(text)
            texts.append(text)
            weights.append(0 if stack.apart or only_links else len(text) + SURGE * bool(stack.mains) + SURGE // 2 * heading)
            gaps.append(max(0, tags - 2))
            within.append(bool(stack.mains))
            tags = 0
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        linked += len(text.strip()) * anchor

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "a":
            anchor = not m[1]
        if m[1]:
            k = stack.place(name)
            if name not in INLINE:
                flush()
                tags += 1
                heading = heading and name not in HEADINGS
            elif k is not None and any(stack.aparts[k:]):
                flush()
            while k is not None and len(stack.names) > k:
                stack.pop()
            continue
        if stack.at.get("head") and name not in IN_HEAD and name != "head":  # a head that is not closed ends here
            flush()
            while stack.at["head"]:
                stack.pop()
        if name in RAW:
            if not m[0].endswith("/>"):
                at = _RAW_END[name].search(page, at).end()
            continue
        if name not in INLINE:
            flush()
            tags += 1
            heading = name in HEADINGS
        if name in VOID or m[0].endswith("/>"):
            continue
        if name in PAGE_PARTS:
            stack.unwrap()
        if name in MAIN and not stack.apart_mains:
            # An article can't lie in a menu or advert that was left open before it.
            while stack.apart and not stack.mains:
                stack.pop()
        apart = _apart(name, m[3], bool(stack.mains))
        if apart:
            flush()
        if name == "p" and stack.names and stack.names[-1] == "p":
            stack.pop()
        stack.push(name, apart)
    flush()
    if 2 * sum(w for w, m in zip(weights, within, strict=True) if m) >= sum(weights):
        weights = [w * m for w, m in zip(weights, within, strict=True)]
    return texts, weights, gaps


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The lines of weight between the surge and dive points, joined by line feeds."""
    texts, weights, gaps = lines(page or "")
    if not texts or not any(weights):
        return ""
    # Line by line, empty ones too (a window's length of them is as good as any more).
    place = np.cumsum(np.minimum(gaps, window + 1)) + np.arange(len(texts))
    sizes = np.zeros(int(place[-1]) + 1 + window, np.int64)
    sizes[place] = weights
    sums = np.convolve(sizes, np.ones(window, np.int64))[window - 1 :].tolist()  # of each line and the next ones
    threshold = min(surge, -(-max(sums) // 4))
    line_of, own = dict(zip(place.tolist(), range(len(texts)), strict=True)), sizes.tolist()
    kept, inside = [], False
    for k in range(int(place[-1]) + 1):
        if not inside:
            inside = 2 * own[k] >= threshold and sums[k] >= threshold and (sums[k + 1] > 0 or own[k] >= threshold)
        elif not own[k]:
            inside = 4 * sums[k + 1] >= threshold
        if inside and own[k]:
            kept.append(texts[line_of[k]])
    return "\n".join(kept)


def extract(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 64):
                piece = batch.slice(k, 64)
                texts = [main_text(x) for x in piece.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(page_id).alias("page_id"), url.alias("url"), F.col(html).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
