"""Main-text extraction by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass decides blocks
by link density, length and stop-word density, with the element a block
stands in as a further rule: menus, headers, footers, sidebars, notices,
adverts, forms and comment sections are never content, while the blocks of an
article or main element are content unless they are mostly links.  The second
pass lets short, ambiguous blocks inherit the label of the nearest decided
neighbours.

A skipped element (script, svg, button and the like) is left out up to its end
tag.  Written as ``<svg/>`` it is empty.  One that is left open (the page or an
enclosing block ends without its end tag) goes to the next block element only.

Defined results: null and empty pages give an empty text; very long pages are
read whole; repeated rows are extracted each by itself; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINK_DENSITY = 0.33
LONG_CHARS = 140
SHORT_CHARS = 70
STOP_HIGH, STOP_LOW = 0.25, 0.12

# Tag names by their part in a page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
SKIPPED_TAGS = frozenset("script style noscript template iframe object svg math canvas textarea select button title".split())
# Of the skipped, those whose content is text, whatever tags stand in it; and blocks that are parts of a select.
TEXT_TAGS = frozenset("script style iframe textarea title".split())
SELECT_TAGS = frozenset("option optgroup hr legend".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog".split())
CONTENT_TAGS = frozenset("article main".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class, id and role names that mark boilerplate.
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr notice newsletter subscribe "
    "popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar side aside widget related recommended share social "
    "comment comments disqus reply replies footer header masthead login signup search pagination pager toolbar complementary contentinfo".split()
)
# Common words of four languages.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with be by at this from or an have not but they his her which "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass "
    "le la les de des du et en un une est que qui dans pour pas au sur par avec ce il plus "
    "el los las del y en una es que por con para su al se lo como más no".split()
)


def _named_boilerplate(names: str, content: bool) -> bool:
    """Whether class, id or role names mark boilerplate; an article's only where they name comments."""
    for name in names.split():
        parts = re.split(r"[^a-z]+", name)
        if parts[0] not in ("has", "no", "with", "without") and not BOILERPLATE_NAMES.isdisjoint(parts):
            if not content or not {"comment", "comments", "reply"}.isdisjoint(parts):
                return True
    return False


class Block:
    __slots__ = ("parts", "linked", "inside", "label")

    def __init__(self, inside: str) -> None:
        self.parts: list[str] = []
        self.linked = 0
        self.inside = inside  # "content", "boilerplate" or "open"
        self.label = ""


class BlockReader(HTMLParser):
    """Cuts a page into blocks, each with its share of linked characters and what it stands in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, str, list | None]] = []  # kind, tag or text, attributes
        self.blocks: list[Block] = []
        self.open: list[tuple[str, str]] = []
        self.links = 0
        self.now = Block("open")

    def _cut(self) -> None:
        if self.now.parts:
            self.blocks.append(self.now)
        self.now = Block(self.open[-1][1] if self.open else "open")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.events.append(("start", tag, attrs))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in SKIPPED_TAGS:
            self.events.append(("start", tag, attrs))

    def handle_endtag(self, tag: str) -> None:
        self.events.append(("end", tag, None))

    def handle_data(self, data: str) -> None:
        self.events.append(("data", data, None))

    def _ends(self) -> dict[int, int]:
        """Places of the skipped elements that have an end tag, each with the place of that."""
        ends: dict[int, int] = {}
        later: dict[str, list[int]] = {}
        for i in range(len(self.events) - 1, -1, -1):
            kind, tag, _ = self.events[i]
            if kind == "end" and tag in TEXT_TAGS:
                later.setdefault(tag, []).append(i)
        stack: list[tuple[str, int]] = []
        held: Counter = Counter()
        skipped = 0  # open skipped elements
        past = -1
        for i, (kind, tag, _) in enumerate(self.events):
            if i <= past or kind == "data" or tag not in SKIPPED_TAGS and tag not in BLOCK_TAGS or tag in VOID_TAGS:
                continue
            if kind == "start":
                if tag in TEXT_TAGS and not skipped:
                    places = later.get(tag, [])
                    while places and places[-1] < i:
                        places.pop()
                    if places:
                        past = ends[i] = places[-1]
                    continue
                stack.append((tag, i))
                held[tag] += 1
                skipped += tag in SKIPPED_TAGS
            elif held[tag]:
                while True:
                    top, at = stack.pop()
                    held[top] -= 1
                    skipped -= top in SKIPPED_TAGS
                    if top == tag:
                        break
                if tag in SKIPPED_TAGS:
                    ends[at] = i
        return ends

    def close(self) -> None:
        super().close()
        ends = self._ends()
        past, left_open = -1, ""
        for i, (kind, tag, attrs) in enumerate(self.events):
            if i <= past:
                continue
            if kind == "start" and tag in SKIPPED_TAGS:
                if i in ends:
                    past = ends[i]
                else:
                    left_open = tag
                continue
            if left_open:
                block = kind != "data" and tag in BLOCK_TAGS and not (left_open == "select" and tag in SELECT_TAGS)
                if not block or kind == "end" and all(t != tag for t, _ in self.open):
                    continue
                left_open = ""
            if kind == "start":
                self._start(tag, attrs)
            elif kind == "end":
                self._end(tag)
            else:
                self._data(tag)
        self._cut()

    def _start(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.now.parts.append(" ")
            return
        if tag in VOID_TAGS:
            if tag == "hr":
                self._cut()
            return
        if tag == "a":
            self.links += 1
            return
        if tag not in BLOCK_TAGS:
            return
        if tag == "p" and self.open and self.open[-1][0] == "p":
            self.open.pop()
        inside = self.open[-1][1] if self.open else "open"
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower()
        if inside != "boilerplate":
            if tag in BOILERPLATE_TAGS and not (tag == "header" and inside == "content"):
                inside = "boilerplate"
            elif tag not in ("html", "body") and _named_boilerplate(names, tag in CONTENT_TAGS):
                inside = "boilerplate"
            elif tag in CONTENT_TAGS:
                inside = "content"
        self.open.append((tag, inside))
        self._cut()

    def _end(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
            return
        if tag not in BLOCK_TAGS:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
        self.links = 0
        self._cut()

    def _data(self, data: str) -> None:
        self.now.parts.append(data)
        if self.links:
            self.now.linked += len("".join(data.split()))


def _first_pass(text: str, block: Block) -> str:
    if block.inside == "boilerplate":
        return "bad"
    dense = block.linked / max(1, len("".join(text.split())))
    if dense > LINK_DENSITY:
        return "bad"
    if block.inside == "content":
        return "good" if len(text) >= SHORT_CHARS else "near"
    words = text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    if len(text) < SHORT_CHARS:
        return "bad" if block.linked else "near"
    if stops >= STOP_HIGH:
        return "good" if len(text) >= LONG_CHARS else "near"
    return "near" if stops >= STOP_LOW else "bad"


def _second_pass(labels: list[str], inside: list[str]) -> list[str]:
    """Ambiguous blocks take the label both nearest decided neighbours share; where these differ or
    lack, the nearer one's, then that of the element the block stands in."""
    out = list(labels)
    n = len(labels)
    before, after = [None] * n, [None] * n
    for order, into in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[str, int] = {}
        for i in order:
            # Neighbours count within the same kind of element: an advert before an article says nothing of its heading.
            into[i] = last.get(inside[i])
            # Within an article only text counts: a list of links beside a short paragraph says nothing of it.
            if labels[i] == "good" or (labels[i] == "bad" and inside[i] != "content"):
                last[inside[i]] = i
    for i, label in enumerate(labels):
        if label != "near":
            continue
        near = [j for j in (before[i], after[i]) if j is not None]
        if near:
            out[i] = labels[min(near, key=lambda j: (abs(j - i), labels[j] != "good"))]
        else:
            out[i] = "good" if inside[i] == "content" else "bad"
    return out


def extract(html: str | None) -> str:
    """Main text of one page: blocks in page order, joined by one newline."""
    if not html:
        return ""
    reader = BlockReader()
    reader.feed(html)
    reader.close()
    kept = []
    for b in reader.blocks:
        text = " ".join("".join(b.parts).split())
        if text:
            kept.append((text, b))
    labels = _second_pass([_first_pass(t, b) for t, b in kept], [b.inside for _, b in kept])
    return "\n".join(t for (t, _), label in zip(kept, labels, strict=True) if label == "good")


@F.pandas_udf(T.StringType())
def main_text(pages: pd.Series) -> pd.Series:
    return pages.map(extract, na_action=None)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, the main text and its code points, for each row of ``pages``."""
    return pages.select("page_id", "url", main_text(F.col(html_col).cast("string")).alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
