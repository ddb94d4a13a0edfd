"""Main text of HTML pages by minimum-cut labelling.

A page is read into blocks, the text between the borders of block elements, in page order. A linear classifier over the
tags, class names and shape of a block gives the cost of calling it content and of calling it boilerplate; these are the
capacities of its arcs from the source and to the sink. Neighbours in the page are joined by an edge that weakens with
the element borders between them, and so is the last block before with the same parent. The minimum cut of this network,
found by maximum flow, is the labelling of least total cost; ties go to content. Blocks whose own cost outweighs all
their edges have that label in every minimum cut, so they are folded into their neighbours first, and the flow is run
on the rest.

The classifier is linear with the fixed weights below, as no page is labelled.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Quotes count after an equals sign only, and a tag holds no `<` outside them; repeats give nothing back, so that reading
# takes time in proportion to the page.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?](?:[^>]*+>|.*+\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)"
    r"((?:[^<>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>|[^<]++|<", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORDS = frozenset
# Elements by their part in a page.
SKIPPED = _WORDS("script style noscript template textarea select svg iframe object canvas audio video title datalist".split())
INLINE = _WORDS(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q ruby rt rp s "
    "samp small span strike strong sub sup time tt u var wbr progress".split()
)
VOID = _WORDS("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {
    "li": _WORDS(["li"]), "dt": _WORDS(["dt", "dd"]), "dd": _WORDS(["dt", "dd"]), "tr": _WORDS(["tr", "td", "th"]),
    "td": _WORDS(["td", "th"]), "th": _WORDS(["td", "th"]), "option": _WORDS(["option"]),
}
CONTAINERS = _WORDS("table ul ol dl menu article section div main body html td th nav header footer aside form".split())
OUTSIDE = _WORDS("nav header footer aside form menu dialog button fieldset".split())
MAIN = _WORDS(["article", "main"])
# Words in class, id and role that tell what an element holds.
STRONG = _WORDS(
    "sidebar aside ad ads adv advert advertisement adsense sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice alert popup modal overlay newsletter subscribe subscription share sharing social comment comments reply replies "
    "respond discussion disqus breadcrumb breadcrumbs related recommended recommendations footer copyright legal disclaimer "
    "login signup complementary contentinfo pagination pager paywall outbrain taboola".split()
)
WEAK = _WORDS("header nav navigation navbar menu banner topbar toolbar search form widget masthead skip".split())
GOOD = _WORDS("article content post entry story main text body prose".split())
# Words that make a name tell of something elsewhere in the page, as in "has-sidebar".
ABOUT = _WORDS("has with without no is hide show".split())
# Weights of the classifier, in log-odds for content.
W_START, W_OUTSIDE, W_STRONG, W_WEAK, W_HIDDEN = 0.3, -14.0, -14.0, -11.0, -16.0
W_MAIN, W_NOT_MAIN, W_GOOD = 4.0, -3.5, 1.0
W_WORD, MOST_WORDS, W_LINKS, W_SENTENCE, W_PARAGRAPH, W_ITEM, W_RIGHTS = 0.05, 40, -5.0, 0.5, 0.7, -0.3, -4.0
# Strength of the edges. Capacities are whole numbers, so that flows are exact.
E_NEXT, E_PARENT, SCALE = 1.5, 1.0, 1_000
# Part of its strength that an edge keeps across the border of an element that is named for another part of the page.
E_APART = 0.2
# An article with less than this part of the text of the largest is a teaser.
TEASER = 0.3


class _Element:
    __slots__ = ("tag", "parent", "depth", "weight", "weak", "good", "hidden", "size", "low", "inside", "holds")

    def __init__(self, tag, attributes, parent):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.weight, self.weak, self.good, self.hidden, self.size = 0.0, False, False, False, 0
        self.low, self.inside, self.holds = 0.0, False, False
        if tag in OUTSIDE:
            self.weight = W_OUTSIDE
        if not attributes or tag in ("html", "body"):
            return
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id", "role"):
                for token in value.split():
                    words = [w.lower() for w in _NAME.findall(token)]
                    if not words or not ABOUT.isdisjoint(words):
                        continue
                    if words[0] in STRONG or words[-1] in STRONG:
                        self.weight = min(self.weight, W_STRONG)
                    elif words[0] in WEAK or words[-1] in WEAK:
                        self.weak, self.weight = not self.weight, min(self.weight, W_WEAK)
                    self.good = self.good or not GOOD.isdisjoint(words)
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                self.hidden = True
            elif name == "aria-hidden" and value == "true":
                self.hidden = True
        self.hidden = self.hidden or re.search(r"(?:^|\s)hidden(?:\s|/|=|$)", attributes) is not None


class _Block:
    __slots__ = ("text", "parent", "linked", "tag")

    def __init__(self, text, parent, linked):
        self.text, self.parent, self.linked = text, parent, linked


def blocks_of(page: str) -> list[_Block]:
    """The blocks of a page with text, white space inside them turned into one space."""
    top = here = _Element("", "", None)
    blocks: list[_Block] = []
    parts: list[str] = []
    linked = links = 0
    # How many elements of a tag are open, so that an end tag without a beginning costs nothing.
    opened: Counter[str] = Counter()

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(_Block(text, here, min(linked, len(text))))
            parts.clear()
        linked = 0

    def leave(at):
        """Close the elements from the innermost up to `at`."""
        nonlocal here
        while True:
            opened[here.tag] -= 1
            left, here = here, here.parent
            if left is at:
                return

    place = 0
    while match := _TOKEN.match(page, place):
        place = match.end()
        end, tag, attributes = match.groups()
        if tag is None:
            token = match.group()
            if token[:2] in ("<!", "<?"):
                continue
            text = html.unescape(token) if "&" in token else token
            parts.append(text)
            if links:
                linked += len(text.strip())
            continue
        tag = tag.lower()
        if tag in SKIPPED:
            if not end and not attributes.endswith("/"):
                # What is inside is no markup.
                close = re.compile(f"</{tag}(?=[\\s/>])[^>]*+(?:>|\\Z)", re.I).search(page, place)
                place = close.end() if close else len(page)
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            links = 0 if end else 1
        elif tag in INLINE or tag == "input":
            continue
        elif end:
            at = here
            while opened[tag] and at.parent and at.tag != tag and not (tag in ("p", "li", "td", "th", "tr") and at.tag in CONTAINERS):
                at = at.parent
            flush()
            if at.parent and at.tag == tag:
                leave(at)
        else:
            flush()
            links = 0
            at, closed = here, CLOSED_BY.get(tag, frozenset())
            while (
                (opened["p"] > 0 or any(opened[c] > 0 for c in closed))
                and at.parent and (at.tag == "p" or at.tag not in CONTAINERS or at.tag in closed)
            ):
                above = at.parent
                if at.tag == "p" or at.tag in closed:
                    leave(at)
                at = above
            if tag in VOID:
                continue
            here = _Element(tag, attributes, here)
            opened[tag] += 1
            if tag in MAIN:
                # A wrapper named for a part of the page is more than that if the article lies inside.
                at = here.parent
                while at and not at.holds:
                    if at.weak and at.weight == W_WEAK:
                        at.weight, at.weak = 0.0, False
                    at.holds = True
                    at = at.parent
    flush()
    return blocks


def content_odds(blocks: list[_Block]) -> list[float]:
    """The log-odds of each block for being content."""
    # Every element with text below it once: sizes go up from the deepest, what holds for all inside goes down.
    elements: set[_Element] = set()
    for block in blocks:
        block.parent.size += len(block.text)
        at = block.parent
        while at and at not in elements:
            elements.add(at)
            at = at.parent
    order = sorted(elements, key=lambda e: -e.depth)
    for element in order:
        if element.parent:
            element.parent.size += element.size
    largest = max((e.size for e in order if e.tag in MAIN and not e.weight), default=0)
    for element in reversed(order):
        above = element.parent
        element.low = min(above.low if above else 0.0, W_HIDDEN if element.hidden else element.weight)
        main = element.tag in MAIN and (0 if element.weight else element.size) >= TEASER * largest
        element.inside = main or (above.inside if above else False)
        element.good = element.good or (above.good if above else False)
    odds = []
    for block in blocks:
        low, inside, good = block.parent.low, block.parent.inside, block.parent.good
        text, tag = block.text, block.parent.tag
        total = W_START + low + W_WORD * min(MOST_WORDS, text.count(" ") + 1) + W_LINKS * block.linked / len(text)
        total += (W_MAIN if inside else W_NOT_MAIN) if largest else 0.0
        total += W_GOOD * good + W_SENTENCE * (text[-1] in ".!?…。！？") + W_PARAGRAPH * (tag == "p") + W_ITEM * (tag in ("li", "td", "th"))
        if text[0] == "©" or text[:10].lower() == "copyright " or "all rights reserved" in text[-60:].lower():
            total += W_RIGHTS if not inside else 0.0
        odds.append(total)
    return odds


def edges_of(blocks: list[_Block]) -> list[tuple[int, int, float]]:
    """(block, later block, strength) for neighbours in the page and for the nearest of the same parent."""
    found, last = [], {}
    for i, block in enumerate(blocks):
        a, b = blocks[i - 1].parent if i else None, block.parent
        if i:
            steps, apart = 0, 1.0
            while a is not b:
                if a.depth >= b.depth:
                    low, a = a, a.parent
                else:
                    low, b = b, b.parent
                steps += 1
                if low.weight:
                    apart = E_APART
            found.append((i - 1, i, apart * E_NEXT / (1 + max(0, steps - 2))))
        group = block.parent.parent or block.parent
        if group in last and last[group] != i - 1:
            found.append((last[group], i, E_PARENT))
        last[group] = i
    return found


def minimum_cut(gains: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The side of each node in the minimum cut: True on the source's.

    A positive gain is the capacity of the arc from the source, a negative one of the arc to the sink; an edge has its
    capacity both ways. Of several minimum cuts the one with the most nodes on the source's side is taken.
    """
    n = len(gains)
    gains, near = list(gains), [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        held = sum(near[i].values())
        if side[i] is not None or abs(gains[i]) < held or (gains[i] == -held):
            continue
        side[i] = gains[i] > 0 or held == 0 and gains[i] == 0
        for j, w in near[i].items():
            gains[j] += w if side[i] else -w
            del near[j][i]
            queue.append(j)
        near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        # Shortest augmenting paths over residual capacities; node -1 is the source and -2 the sink.
        left = {i: dict(near[i]) for i in rest}
        left[-1], left[-2] = {}, {}
        for i in rest:
            a, b = (-1, i) if gains[i] > 0 else (i, -2)
            left[a][b] = abs(gains[i])
            left[b][a] = 0
        while True:
            back = {-1: None}
            queue = deque([-1])
            while queue and -2 not in back:
                a = queue.popleft()
                for b, w in left[a].items():
                    if w > 0 and b not in back:
                        back[b] = a
                        queue.append(b)
            if -2 not in back:
                break
            path, b = [], -2
            while back[b] is not None:
                path.append((back[b], b))
                b = back[b]
            flow = min(left[a][b] for a, b in path)
            for a, b in path:
                left[a][b] -= flow
                left[b][a] += flow
        # What still reaches the sink is on its side in every cut; all else can be on the source's.
        reach, queue = {-2}, deque([-2])
        while queue:
            b = queue.popleft()
            for a in left[b]:
                if a not in reach and left[a][b] > 0:
                    reach.add(a)
                    queue.append(a)
        for i in rest:
            side[i] = i not in reach
    return side


def main_text(page: str | None) -> str:
    """The content blocks of a page joined by empty lines; '' for NULL, empty or contentless pages."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    gains = [round(SCALE * odds) for odds in content_odds(blocks)]
    kept = minimum_cut(gains, [(a, b, round(SCALE * w)) for a, b, w in edges_of(blocks)])
    return "\n\n".join(b.text for b, keep in zip(blocks, kept) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """The rows (key, url, html) as (key, url, text, n_chars), one for each."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.record_batch([batch.column("key"), batch.column("url"), pa.array(texts, pa.string()), sizes], names=["key", "url", "text", "n_chars"])

    rows = pages.select(F.col("key").cast("bigint").alias("key"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "key bigint, url string, text string, n_chars bigint")
