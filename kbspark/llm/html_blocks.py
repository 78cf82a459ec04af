"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass classifies each block by its length, the share of its characters in links and
the share of stop words among its words; blocks in menus, headers, footers, sidebars, notices, adverts, forms and reader comments are
boilerplate by their place. A name or a form is evidence only: it does not count where the wrapper holds the page's heading and most of the
text that is not in links, and an article inside such a wrapper ends its mark, if the page has no article outside. Stop words are those of four
languages; where a page has next to none of them, its own most frequent short words stand in. Inside an article a block with many links is
undecided. In the second pass short and undecided blocks take the label of the nearest decided neighbours.

Reading a page takes time in proportion to its length, whatever is left open in it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, extended, fresh

# Tag names, words of class names, and frequent words of the four languages.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
SKIPPED_TAGS = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button head title".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside menu dialog fieldset".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REPEATED_TAGS = frozenset("p li dt dd tr td th option".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus "
    "footer header gdpr login masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup promo promoted promotion "
    "notice notices overlay related recommended replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist discussion discussions disqus replies reply respond".split())
BOILERPLATE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
STOP_WORDS = frozenset(
    "a all an and are as at be been but by can for from had has have he her his i if in is it its more not of on one or our she so that the their "
    "there they this to was we were what when which who will with would you your "
    "au aux avec ce ces cette comme dans de des du elle en est et être il ils je la le les leur lui mais même ne nous on ou par pas plus pour "
    "qu que qui sa se ses son sont sur un une vous "
    "aber als am auch auf aus bei bis das dass dem den der des die ein eine einem einen einer es für hat ich ihr im ist mit nach nicht noch nur "
    "oder sich sie sind so über um und uns von vor war werden wie wird zu zum zur "
    "al como con del desde donde el ella entre era es esta este hay las lo los más me muy no nos o para pero por porque se sin sobre su sus "
    "también tan todo una uno y ya".split()
)
SHORT, LONG = 70, 200  # characters
LINKS, STOPS_LOW, STOPS_HIGH = 0.33, 0.10, 0.25  # shares
NEAR_HEADING = 3  # blocks between a heading and good text
MOST, MORE, ALL = 0.5, 0.7, 0.9  # of a page's text without links: with the page's heading, without one, for reader comments
FEW_STOPS = 0.06  # a page with fewer listed stop words is in another language
OWN_STOPS = 25  # words of a page that stand in for stop words
OWN_LETTERS = 4  # of such a word, at most

# A tag is met whole unless it holds a sign that could open or end another or stand in quotes that are left open; then only its < is met.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|--!>|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/><\"']*)([^<>\"']*(?:\"[^\"<>]*\"[^<>\"']*|'[^'<>]*'[^<>\"']*)*)>|<(?=/?[a-zA-Z])",
    re.S,
)
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)(.*)", re.S)
_SIGN = re.compile("[\"'>]")
# Letters of scripts that write words without spaces count as words, and for more than one letter of length.
_DENSE = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_DENSE_LENGTH = 3
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW_ENDS = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW_TAGS}
_NAME = re.compile(r"[a-z]+")
_WORD = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]|[^\\W\\d_\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    links: int = 0  # characters in links
    heading: str = ""  # tag of the heading it is in
    main: bool = False
    boilerplate: bool = False  # by a tag or role around it; with the marks that count, see blocks()
    level: int = 0  # marks around its article that count
    mark: int = 0  # innermost mark around it
    outside: int = 0  # innermost mark around its article
    label: str = ""


@dataclass
class _Open:
    """An open tag; what is summed over all tags open around it is kept with it, so that nothing is searched for."""

    tag: str
    skipped: bool = False
    main: bool = False
    boilerplate: bool = False
    heading: str = ""
    links: int = 0
    mark: int = 0
    outside: int = 0
    block: int = -1  # place of the innermost block-level tag


@dataclass
class _State:
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=lambda: [_Open("")])
    count: Counter[str] = field(default_factory=Counter)  # open tags by name
    marks: list[tuple[int, bool]] = field(default_factory=lambda: [(0, False)])  # the mark around it, reader comments

    def end_block(self) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
        if text:
            o = self.stack[-1]
            links = len(_SPACE.sub(" ", html.unescape("".join(self.linked))).strip()) if self.linked else 0
            self.blocks.append(Block(text, links, o.heading, o.main, o.boilerplate, 0, o.mark, o.outside))
        self.parts, self.linked = [], []

    def end_from(self, k: int) -> None:
        for o in self.stack[k:]:
            self.count[o.tag] -= 1
        del self.stack[k:]


def _attributes(source: str, inside: bool) -> tuple[bool, bool, bool, bool, bool]:
    """Whether attributes say boilerplate by name, reader comments, boilerplate by role, hidden, or main text. A header inside an article is
    its own."""
    named = comments = boilerplate = hidden = main = False
    for m in _ATTRIBUTE.finditer(source):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            found = _NAME.findall(value)
            words = BOILERPLATE_WORDS.intersection(found)
            about = any(w in COMMENT_WORDS or w.endswith(("comment", "comments")) for w in found)
            named |= bool(words - {"header"}) or bool(words) and not inside or about
            comments |= about
        elif name == "role":
            boilerplate |= value in BOILERPLATE_ROLES
            main |= value in ("main", "article")
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    return named, comments, boilerplate, hidden, main


def _tag_ends(page: str) -> tuple[list[int], list[int]]:
    """Places of all quotes and > and, for a tag that meets the sign first, the place of the > that ends it (-1: none). A > in quotes ends none."""
    signs = [m.start() for m in _SIGN.finditer(page)]
    ends, later = [-1] * len(signs), {"'": -1, '"': -1}
    for k in range(len(signs) - 1, -1, -1):
        sign = page[signs[k]]
        if sign == ">":
            ends[k] = signs[k]
        else:
            closing = later[sign]
            ends[k] = ends[closing + 1] if 0 <= closing < len(signs) - 1 else -1
            later[sign] = k
    return signs, ends


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, with what their place in it says. Tags left open end with what holds them."""
    s, at, ends = _State(), 0, None
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not s.stack[-1].skipped:
            s.parts.append(text)
            if s.stack[-1].links:
                s.linked.append(text)
        if m is None:
            break
        at, slash, tag, rest = m.end(), m[1], m[2], m[3]
        if m[0] == "<":
            ends = ends or _tag_ends(page)
            k = bisect_left(ends[0], at)
            end = ends[1][k] if k < len(ends[0]) else -1
            if end < 0:  # a sign in a text
                if not s.stack[-1].skipped:
                    s.parts.append("<")
                continue
            slash, tag, rest = _TAG.match(page, at, end).groups()
            at = end + 1
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            _close(s, tag)
            continue
        if tag == "br":
            s.parts.append(" ")
            continue
        if tag in BLOCK_TAGS or tag == "body":
            s.end_block()
            nearest = s.stack[-1].block
            if tag in REPEATED_TAGS and nearest >= 0 and s.stack[nearest].tag == tag:
                s.end_from(nearest)  # a paragraph, item or cell ends an open one of its kind, with the inline tags left open in it
            while s.count["head"] and tag not in ("title", "head"):  # content ends a head left open
                _close(s, "head")
        if tag in VOID_TAGS or rest.endswith("/") and tag not in BLOCK_TAGS | SKIPPED_TAGS:
            continue
        _open(s, tag, rest)
        if tag in RAW_TAGS:
            end = _RAW_ENDS[tag].search(page, at)
            at = end.start() if end else len(page)
    s.end_block()
    _count_marks(s)
    return s.blocks


def _open(s: _State, tag: str, rest: str) -> None:
    out = s.stack[-1]
    named, comments, boilerplate, hidden, main = _attributes(rest, out.main) if rest else (False,) * 5
    wide = tag in ("body", "html")  # a class of the whole page says nothing about a block
    main |= tag in MAIN_TAGS
    by_tag = tag in BOILERPLATE_TAGS and not (tag == "header" and out.main)
    mark = out.mark
    if (named and not wide or tag == "form") and not main:
        s.marks.append((mark, comments))
        mark = len(s.marks) - 1
    s.count[tag] += 1
    s.stack.append(_Open(
        tag, out.skipped or tag in SKIPPED_TAGS or hidden and not wide, out.main or main,
        out.boilerplate or boilerplate and not wide and tag not in MAIN_TAGS or by_tag, tag if tag in HEADINGS else out.heading,
        out.links + (tag == "a"), mark, mark if main and not wide and not named else out.outside,
        len(s.stack) if tag in BLOCK_TAGS else out.block,
    ))


def _count_marks(s: _State) -> None:
    """Leave out the marks of wrappers that hold what the page is about, and tell each block whether one that counts is around it.

    Articles in the fewest marked wrappers that hold text enough are the page's own; those in more stay boilerplate, as related pages are.
    """
    found, marks = s.blocks, s.marks
    n = len(marks)
    own, stories, heads, first, whole = [0] * n, [0] * n, [False] * n, [False] * n, [False] * n
    open_blocks = [b for b in found if not b.boilerplate]
    head = next((b for b in open_blocks if b.heading == "h1"), None)
    opening = next((b for b in open_blocks if len(b.text) - b.links >= SHORT), None)
    for b in open_blocks:
        own[b.mark] += len(b.text) - b.links
        stories[b.outside] += len(b.text) * b.main
        heads[b.mark] |= b is head
        first[b.mark] |= b is opening
    for k in range(n - 1, 0, -1):  # a mark comes after the mark around it
        outer, comments = marks[k]
        heads[outer] |= heads[k]
        first[outer] |= first[k]
        if not comments or (first[k] if head is None else heads[k]):  # else readers wrote it, however much it is
            own[outer] += own[k]
    for k in range(n - 1, 0, -1):
        outer, comments = marks[k]
        if head is not None:
            large = heads[k] and own[k] > MOST * own[0]
        else:
            large = own[k] > (ALL if comments else MORE) * own[0] and (first[k] or not comments)
        whole[k] = large and stories[k] <= LONG  # else an article in it ends its mark
        stories[outer] += stories[k] * large
    counted = [0] * n
    for k in range(1, n):
        counted[k] = counted[marks[k][0]] + (not whole[k])
    chars: dict[int, int] = {}
    for b in found:
        b.level = counted[b.outside]
        b.boilerplate |= counted[b.mark] > b.level
        if b.main and not b.boilerplate:
            chars[b.level] = chars.get(b.level, 0) + len(b.text)
    plain = sum(len(b.text) - b.links for b in found if not b.main and not b.boilerplate and len(b.text) > LONG)
    if 2 * plain >= max(chars.values(), default=0):  # a story without an element of its own
        chars[0] = chars.get(0, 0) + plain
    best = min((k for k in chars if chars[k] > LONG), default=min(chars, default=0))
    for b in found:
        b.boilerplate |= b.level > best


def _close(s: _State, tag: str) -> None:
    """End the innermost open tag of this name and those left open inside it; a tag that is not open ends nothing."""
    if not s.count[tag]:
        if tag in BLOCK_TAGS:
            s.end_block()
        return
    k = len(s.stack) - 1
    while s.stack[k].tag != tag:
        k -= 1
    if tag in BLOCK_TAGS or s.stack[-1].block >= k:
        s.end_block()
    s.end_from(k)


def stop_shares(found: list[Block]) -> list[float]:
    """The share of stop words of each block: of the listed ones or, where next to none of the page's words is listed, of its own most frequent
    short words too."""
    words = [[] if b.boilerplate else _WORD.findall(b.text.lower()) for b in found]
    stops = [len([w for w in ws if w in STOP_WORDS]) for ws in words]
    if sum(stops) < FEW_STOPS * sum(map(len, words)):
        short = Counter(w for ws in words for w in ws if len(w) <= OWN_LETTERS)
        own = {w for _, w in sorted((-n, w) for w, n in short.items() if n > 2)[:OWN_STOPS]} | STOP_WORDS
        stops = [sum(w in own for w in ws) for ws in words]
    return [n / (len(ws) or 1) for n, ws in zip(stops, words, strict=True)]


def first_pass(block: Block, stops: float) -> str:
    """bad, good, short or near; the last two are undecided."""
    if block.boilerplate:
        return "bad"
    dense = block.links / len(block.text) > LINKS
    n = len(block.text)
    if not block.text.isascii():
        n += (_DENSE_LENGTH - 1) * len(_DENSE.findall(block.text))
    if dense and not block.main:
        return "bad"
    if n < SHORT:
        return "bad" if block.links and not block.main else "short"
    if stops >= STOPS_HIGH:
        return "good" if n > LONG and not dense else "near"
    if stops >= STOPS_LOW:
        return "near"
    return "near" if block.main else "bad"


def second_pass(found: list[Block]) -> None:
    """Decide what is undecided from the nearest decided neighbours; the edges of the page and of boilerplate count as bad.

    Inside an article, undecided blocks are text unless both neighbours there are bad: an article's own start and end count as good.
    """
    labels = [b.label for b in found]
    n = len(found)
    before, now = ["bad"] * n, "bad"
    for i, b in enumerate(found):
        if b.main and (i == 0 or not found[i - 1].main):
            now = "good"
        before[i] = now
        if labels[i] in ("good", "bad"):
            now = labels[i]
    after, now = ["bad"] * n, "bad"
    for i in range(n - 1, -1, -1):
        if found[i].main and (i == n - 1 or not found[i + 1].main):
            now = "good"
        after[i] = now
        if labels[i] in ("good", "bad"):
            now = labels[i]
    for i, b in enumerate(found):
        if labels[i] == "near":
            b.label = "good" if "good" in (before[i], after[i]) else "bad"
        elif labels[i] == "short":
            b.label = "good" if before[i] == after[i] == "good" or b.main and "good" in (before[i], after[i]) else "bad"
    for i, b in enumerate(found):  # a heading goes with the text under it
        if b.heading and not b.boilerplate and labels[i] in ("short", "near") and b.label == "bad":
            if any(x.label == "good" for x in found[i + 1 : i + 1 + NEAR_HEADING]):
                b.label = "good"


def extract(page: str) -> str:
    """Main text: the good blocks in page order, joined by two line breaks; empty if there are none."""
    found = blocks(page)
    for b, stops in zip(found, stop_shares(found), strict=True):
        b.label = first_pass(b, stops)
    second_pass(found)
    return "\n\n".join(b.text for b in found if b.label == "good")


def with_text(pages: DataFrame, source: str) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``, its code points. A null or empty page has an empty text; repeated rows get equal answers."""
    text, n = fresh(pages, "text", "n_chars")
    schema, at = extended(pages, **{text: "string", n: "long"}), pages.columns.index(source)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 512):
            found = [extract(x or "") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())],
                names=[*batch.schema.names, text, n],
            )

    return pages.mapInArrow(run, schema)
