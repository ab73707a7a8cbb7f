"""Main text of web pages by minimum-cut labelling of their blocks.

A page is split into blocks of text. A linear classifier gives each block a
cost of being called boilerplate and one of being called content; these are the
capacities of its edges to the two terminals. Neighbours in page order and
neighbours under the same DOM parent are joined by smoothness edges. The
minimum cut, found by maximum flow, is the cheapest labelling of all blocks at
once: an odd short paragraph goes with those around it.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose content is no text of the page.
SKIPPED = frozenset(
    "script style template svg iframe select textarea button head datalist option annotation "
    "annotation-xml".split()
)
# Their content is no markup; without an end tag it runs to the end of the page.
RAW = frozenset("script style iframe textarea".split())
# A start of the same kind, or for the head of any element of the body, ends these.
UNNESTED = frozenset("select button head option".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    # Elements with fallback text, and formulas.
    "audio canvas object video math semantics mfrac mi mmultiscripts mn mo mover mpadded mphantom "
    "mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover".split()
)
# A start of one of these ends an open element of the same row.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
          "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
# An open paragraph ends where a block starts; others stay open across these.
SCOPES = frozenset("article aside body div footer form header main nav section table ul ol".split())

# Where the page goes on after an element that should have ended before.
BLOCKS = SCOPES | frozenset(
    "address blockquote center details dialog dl fieldset figure h1 h2 h3 h4 h5 h6 hr li menu p "
    "pre search summary tbody td tfoot th thead tr".split()
)

BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
GOOD_TAGS = frozenset("article main".split())
BAD_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert menu menubar form".split()
)
# Words of class names and ids: what boilerplate is called,
BAD_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer foot sidebar side aside ad ads advert adverts "
    "advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "alert popup modal overlay toast comment comments commentlist disqus respond reply replies share "
    "sharing social related recommended breadcrumb breadcrumbs pagination pager subscribe newsletter "
    "signup login search widget widgets toolbar copyright legal tags skip".split()
)
# of these what may hold articles of its own,
LISTED = frozenset(
    "comment comments commentlist disqus respond reply replies related recommended".split()
)
# what content is called,
GOOD_WORDS = frozenset("article content post entry story main body text".split())
# parts that leave a boilerplate word before them what it is,
PART_WORDS = frozenset(
    "area articles author bar block body box button buttons column container content footer form group "
    "header icon info inner item items label left link links list main meta outer panel posts right row "
    "section slot stories text title top bottom trail unit wrap wrapper".split()
)
# and first words that speak of something else: a state, or a subject.
STATE_WORDS = frozenset(
    "no not non has have with without is hide show tag category cat topic subject".split()
)
WORD = re.compile(r"[^\W\d_]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<![^>]*+>|<\?[^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
UNSHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)

# Weights of the linear classifier: positive speaks for content.
BIAS = -0.2
IN_GOOD, IN_BAD = 1.6, -5.0
# A name of several words says less than one word alone.
NAMED, PARTLY_NAMED = -5.0, -3.5
LINKED = -3.0
PER_WORD, MOST_WORDS = 0.06, 30
ENDS_SENTENCE = 0.5
TAG_SCORES = {"p": 0.8, "h1": 0.6, "h2": 0.4, "h3": 0.3, "blockquote": 0.6, "pre": 0.6,
              "li": 0.0, "td": 0.0, "div": -0.2, "title": -5.0}
# Capacities between neighbours in page order, more under one parent.
ADJACENT, SIBLING = 0.35, 0.5


class Block(NamedTuple):
    text: str
    tag: str
    parent: int
    good: bool
    bad: float
    linked: float


class Element(NamedTuple):
    tag: str
    number: int
    good: bool
    # Weights against content: of tags, roles and hidden elements; of names; of
    # names that may hold articles.
    bad: float = 0.0
    named: float = 0.0
    listed: float = 0.0


def name_marks(names: str) -> tuple[bool, float, float]:
    """What a class list or id says: good, and the weights of boilerplate and listed names.

    Each name counts as a whole. It is boilerplate if its last word is a
    boilerplate word, or its first one before a word for a part; not if the
    first word speaks of a state or a subject (``has-sidebar``, ``tag-social``).
    """
    good, named, listed = False, 0.0, 0.0
    for name in names.split():
        words = [w.lower() for w in WORD.findall(CAMEL.sub("-", name))]
        if not words or words[0] in STATE_WORDS:
            continue
        first, last = words[0], words[-1]
        if first in ("article", "post", "entry", "story", "content") and last == "header":
            continue  # holds the title of an article
        if last in BAD_WORDS or (first in BAD_WORDS and last in PART_WORDS):
            weight = NAMED if len(words) == 1 else PARTLY_NAMED
            named = min(named, weight)
            if first in LISTED or last in LISTED:
                listed = min(listed, weight)
        else:
            good |= last in GOOD_WORDS
    return good, named, listed


def _element(tag: str, number: int, attributes: str, parent: Element) -> Element:
    """An element with the marks of its containers; the nearest speaks for content."""
    good, bad, named, listed = tag in GOOD_TAGS, 0.0, 0.0, 0.0
    if tag in BAD_TAGS or (tag in ("header", "noscript") and not parent.good):
        # The header of an article holds its title; that of a page does not.
        bad = IN_BAD
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name == "role":
                good |= value.lower() in ("main", "article")
                if value.lower() in BAD_ROLES:
                    bad = IN_BAD
            elif name in ("class", "id"):
                if tag not in ("html", "body"):
                    says, called, lists = name_marks(value)
                    good |= says
                    if not (called and parent.good and value.lower() == "header"):
                        named, listed = min(named, called), min(listed, lists)
            elif (
                (name == "hidden" and value.lower() != "until-found")
                or (name == "aria-hidden" and value.lower() == "true")
                or (name == "style" and UNSHOWN.search(value))
            ):
                bad = IN_BAD
    if tag in GOOD_TAGS:
        # No name makes the main part of a page boilerplate, or what is around
        # it; but lists of comments or of other articles hold articles, too.
        lists = 0.0 if tag == "main" else min(listed, parent.listed)
        named = around = listed = lists
    else:
        around, lists = parent.named, parent.listed
    return Element(
        tag, number, (good or parent.good) and not (bad or named),
        min(bad, parent.bad), min(named, around), min(listed, lists),
    )


def _raw_end(page: str, tag: str, at: int) -> int:
    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
    return close.end() if close else len(page)


def _skipped_end(page: str, tag: str, at: int, around: set[str], closes: dict[str, int]) -> int:
    """Where the text goes on after the start tag, ending at ``at``, of a skipped element.

    After its own end tag. If that is missing (an element around it, another of
    its kind or the page ends first), at the first block inside, and for want
    of one at that place; at the end of the page nothing is skipped. A head
    without end tag ends where the body starts. ``closes`` keeps the place of
    the last end tag of a kind.
    """
    if tag in RAW:
        return _raw_end(page, tag, at)
    if tag not in closes:
        closes[tag] = max((m.start() for m in re.finditer(rf"</{tag}(?=[\s/>])", page, re.I)), default=-1)
    ended = closes[tag] >= at
    block, depth, open_ = None, 1, {}
    start = at
    while (found := TOKEN.search(page, at)) is not None:
        at = found.end()
        end, name, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if end:
            if name == tag:
                depth -= 1
                if not depth:
                    return at
            elif open_.get(name):
                open_[name] -= 1
            elif name in around and name not in INLINE:
                return found.start() if block is None else block
            continue
        if tag == "head":
            if name not in IN_HEAD:
                return found.start()
        elif name == tag and tag in UNNESTED:
            return found.start() if block is None else block
        elif block is None and name in BLOCKS:
            block = found.start()
            if not ended:
                return block
        if attributes.endswith("/") or name in VOID:
            continue
        if name in RAW:
            at = _raw_end(page, name, at)
        elif name == tag:
            depth += 1
        else:
            open_[name] = open_.get(name, 0) + 1
    return start if block is None else block


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order; markup errors never lose text."""
    root = Element("", 0, False)
    stack = [root]
    blocks: list[Block] = []
    runs: list[str] = []
    linked = total = 0
    anchors = numbers = 0
    closes: dict[str, int] = {}

    def text(run: str) -> None:
        nonlocal linked, total
        if run:
            runs.append(entities.unescape(run) if "&" in run else run)
            size = len(run)
            total += size
            linked += size if anchors else 0

    def flush() -> None:
        nonlocal linked, total
        if runs:
            joined = " ".join("".join(runs).split())
            if joined:
                holder = next((e for e in reversed(stack) if e.tag not in INLINE), root)
                at = stack.index(holder)
                parent = stack[max(0, at - 1)].number
                top = stack[-1]
                blocks.append(
                    Block(
                        joined, holder.tag, parent, top.good, min(top.bad, top.named),
                        linked / max(1, total),
                    )
                )
            runs.clear()
        linked = total = 0

    at = 0
    while True:
        found = TOKEN.search(page, at)
        if found is None:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        end, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if tag not in INLINE:
                flush()
            if tag == "a":
                anchors = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    # An inline end tag must not close the block around it.
                    if tag not in INLINE or all(e.tag in INLINE for e in stack[i:]):
                        del stack[i:]
                    break
            continue
        if tag == "br":
            runs.append(" ")
            continue
        if tag in SKIPPED:
            if tag not in INLINE:
                runs.append(" ")
            if not attributes.endswith("/"):
                at = _skipped_end(page, tag, at, {e.tag for e in stack}, closes)
            continue
        if tag not in INLINE:
            flush()
            # Unclosed inline elements end with their block.
            while len(stack) > 1 and stack[-1].tag in INLINE:
                stack.pop()
            closing = CLOSES.get(tag, ()) if tag in CLOSES else ("p",)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closing:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPES:
                    break
            anchors = 0
        if tag in VOID or attributes.endswith("/"):
            continue
        numbers += 1
        anchors += tag == "a"
        stack.append(_element(tag, numbers, attributes, stack[-1]))
    flush()
    return blocks


def content_score(block: Block) -> float:
    """Log-odds of a block being content."""
    words = block.text.count(" ") + 1
    score = BIAS + TAG_SCORES.get(block.tag, 0.0) + PER_WORD * min(words, MOST_WORDS)
    score += IN_GOOD * block.good + block.bad + LINKED * block.linked
    return score + ENDS_SENTENCE * (block.text[-1] in ".!?…:;。”\"'»)")


def min_cut(scores: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Cheapest labelling: a label against a score costs its size, a cut edge its weight.

    Nodes whose score outweighs all their edges keep its sign in a cheapest
    labelling; they are settled first and passed on to their neighbours'
    scores. Maximum flow decides what is left. A tie is not content.
    """
    near: list[dict[int, float]] = [{} for _ in scores]
    for (i, j), weight in edges.items():
        near[i][j] = near[i].get(j, 0.0) + weight
        near[j][i] = near[j].get(i, 0.0) + weight
    scores = list(scores)
    label: list[bool | None] = [None] * len(scores)
    queue = deque(range(len(scores)))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(scores[i]) >= sum(near[i].values()):
            label[i] = scores[i] > 0
            for j, weight in near[i].items():
                scores[j] += weight if label[i] else -weight
                del near[j][i]
                queue.append(j)
            near[i] = {}
    left = [i for i, known in enumerate(label) if known is None]
    if left:
        content = _source_side(scores, near, left)
        for i in left:
            label[i] = i in content
    return [bool(known) for known in label]


def _source_side(scores, near, nodes) -> set[int]:
    """Nodes on the source's side after a maximum flow (shortest augmenting paths)."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i in nodes:
        room[i] = dict(near[i])
    for i in nodes:
        if scores[i] > 0:
            room[source][i] = scores[i]
            room[i].setdefault(source, 0.0)
        else:
            room[i][sink] = -scores[i]
            room[sink].setdefault(i, 0.0)
    while True:
        level, order = {source: 0}, deque([source])
        while order:
            i = order.popleft()
            for j, space in room[i].items():
                if space > 1e-9 and j not in level:
                    level[j] = level[i] + 1
                    order.append(j)
        if sink not in level:
            return {i for i in level if i >= 0}
        following = {i: iter(list(room[i])) for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                pushed = min(room[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    room[a][b] -= pushed
                    room[b][a] = room[b].get(a, 0.0) + pushed
                path = [source]
                following = {k: iter(list(room[k])) for k in level}
                continue
            for j in following[i]:
                if room[i][j] > 1e-9 and level.get(j) == level[i] + 1:
                    path.append(j)
                    break
            else:
                path.pop()
                level[i] = -1


def main_blocks(page: str) -> list[str]:
    """The content blocks of a page in order."""
    blocks = blocks_of(page)
    edges: dict[tuple[int, int], float] = {}
    last_of: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            edges[i - 1, i] = ADJACENT
        if block.parent in last_of:
            pair = (last_of[block.parent], i)
            edges[pair] = edges.get(pair, 0.0) + SIBLING
        last_of[block.parent] = i
    kept = min_cut([content_score(b) for b in blocks], edges)
    return [b.text for b, content in zip(blocks, kept) if content]


def main_text(page: str | None) -> str:
    """Content blocks joined by a blank line; empty for NULL and pages without any."""
    return "\n\n".join(main_blocks(page)) if page else ""


def extract_pages(
    pages: DataFrame, html: str = "html", carry: tuple[str, ...] = ("page_id", "url")
) -> DataFrame:
    """Carried columns, ``text`` and ``n_chars`` of each row of ``pages``.

    NULL and empty pages, and pages without content, give an empty text.
    Repeated rows are extracted each, pages of any length whole; broken markup
    never fails. A block whose two labels cost the same is no content. Columns
    of ``pages`` that are not carried play no part, whatever their names.
    """
    source = pages.select(
        F.struct(*(F.col(c) for c in carry)).alias("_row"), F.col(html).alias("_html")
    )
    schema = T.StructType([source.schema["_row"]]).add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            texts = [main_text(page) for page in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_row"), pa.array(texts, pa.string()),
                    pa.array(map(len, texts), pa.int64()),
                ],
                schema.names,
            )

    return source.mapInArrow(run, schema).select(
        *(F.col(f"_row.`{c}`").alias(c) for c in carry), "text", "n_chars"
    )
