"""Main text of web pages by two passes over their blocks.

A page is read into blocks: runs of text between tags that start or end a block. The first pass decides a block by itself: by the share of
its characters that stand in links, by its length, and by the share of its words that are stop words. What stands in menus,
page headers, footers, asides, forms, scripts and the like, or in an element whose class, id or role says so, is no main text.
Blocks that are short or neither rich nor poor in stop words stay open; the second pass gives them the label of the nearest
decided neighbours.

An ``article`` or ``main`` element is a scope of its own: its edges count as good neighbours, and nothing in it is bad for lack of stop words
alone. Outside of one, the edges of the page count as bad. If such elements hold at least half of the good text, the rest of the
page is dropped.

Defined cases: a null page has no text; white space of a block is one space, two line breaks in a row end a block, one is
a space; tags, comments and references may be broken off anywhere; equal rows are each returned; an empty table gives an empty result;
other columns stay. Work is linear in a page's length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters below which a block is short and from which it is long; shares of stop words; most characters in links.
SHORT, LONG, STOPS_LOW, STOPS_HIGH, LINKS, LINKS_IN_ARTICLE = 70, 140, 0.12, 0.2, 0.33, 0.66
#: Outside of articles a short heading goes with the next decided block, if that is no further than so many characters.
HEADING_REACH = 300

# Function words of English, German, French, Spanish and Dutch.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its
    may more most no not of on one only or other our out over she so some such than that the their them then there these they this to up was we
    were what when which who will with would you your
    aber als am auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für hat ich ihr im ist ja kann
    man mit nach nicht noch nur oder sich sie sind so über um und uns unter vom von vor war was wenn wie wir wird zu zum zur
    au aux avec c ce ces cette comme d dans de des du elle en est et eux il ils j je l la le les leur leurs lui mais m mes n ne nos nous on ont ou où
    par pas plus pour qu que qui s sa se ses si son sont sur un une vous y à été être
    al como con cuando del desde donde el ella entre era es esta este fue ha hay la las lo los me muy más no o para pero por que se ser si sin sobre
    son su sus también un una y ya
    aan bij dan dat de deze die dit door een en er haar heeft het hij ik in je kan maar met naar niet nog of om ook op te tot uit van voor was wat
    we werd wij wordt zich zij zijn
    """.split()
)

# Tags of HTML by what they mean here.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_BLOCK = frozenset(
    """address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th
    thead tr ul""".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SCOPE = frozenset("article aside dd details dialog div dl fieldset figure footer form header li main nav ol search section table td ul".split())
_NEVER = frozenset("aside audio button canvas datalist dialog footer math nav noscript object search select svg template video".split())
_PERHAPS = frozenset(["form", "header"])
# Words in class, id and role that name what is no article. The first list holds for all within; of the second, a main element gets out.
_NEVER_LABELS = frozenset(
    """breadcrumb breadcrumbs comment comments complementary contentinfo disqus footer menu nav navbar navigation recommended related replies
    respond sidebar""".split()
)
_PERHAPS_LABELS = frozenset(
    """ad ads adsbygoogle advert advertisement adverts advertising alert alertdialog banner consent cookie cookies dialog disclaimer form gdpr
    header login masthead modal newsletter notice notices notification pager pagination popup promo promotion search share sharing signup social
    sponsor sponsored subscribe subscription toolbar widget""".split()
)
_DISCUSSION = frozenset("comment comments disqus replies respond".split())
_NOT_SO = frozenset("closed enabled has no on open with without".split())

_TAG = re.compile(
    r"""<!--(?:-?>|(?s:.*?)(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)"""
)
_LABELS = re.compile(r"""(?<![^\s"'/])(?:class|id|role)\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s>"']++)""", re.IGNORECASE)
_LABEL_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE) for name in _RAW}

GOOD, BAD, OPEN, NEAR = "good", "bad", "open", "near"


@dataclass(slots=True)
class Block:
    text: str
    linked: int  # characters in links
    heading: bool
    dropped: bool
    scope: int  # the article or main element it stands in, 0 for none


@dataclass(slots=True)
class _Open:
    name: str
    drop: int  # 0: no, 1: unless a main element follows inside, 2: whatever follows
    scope: int


def _labelled(name: str, attributes: str, scope: int) -> int:
    words = {w.lower() for m in _LABELS.finditer(attributes) for w in _LABEL_WORD.findall(m[1])}
    if not words or words & _NOT_SO:
        return 0
    if name in ("article", "main"):
        return 2 if words & _DISCUSSION else 0
    if words & _NEVER_LABELS:
        return 2
    return 1 if words & (_PERHAPS_LABELS - {"header"} if scope else _PERHAPS_LABELS) else 0


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, each with what the first pass asks of it."""
    out: list[Block] = []
    parts: list[str] = []
    stack = [_Open("", 0, 0)]
    opened: Counter = Counter()
    scopes = at = linked = 0
    heading = in_link = broken = False

    def end_block() -> None:
        nonlocal linked, heading
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, linked, heading, stack[-1].drop > 0, stack[-1].scope))
        parts.clear()
        linked, heading = 0, False

    def close(name: str) -> None:
        while (top := stack.pop()).name != name:
            opened[top.name] -= 1
        opened[name] -= 1

    while at < len(page):
        tag_at = page.find("<", at)
        tag = _TAG.match(page, tag_at) if tag_at >= 0 else None
        to = len(page) if tag_at < 0 else tag_at if tag else tag_at + 1
        if to > at:
            text = html.unescape(page[at:to])
            parts.append(text)
            seen = not text.isspace()
            broken = broken and not seen
            if in_link and seen:
                linked += len(" ".join(text.split()))
        if tag is None:
            at = to
            continue
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if name == "br":
            if broken:
                end_block()
            parts.append(" ")
            broken = True
            continue
        if name in _BLOCK:
            end_block()
            broken = False
        if tag[1]:
            in_link = in_link and name != "a"
            if opened[name] > 0:
                if name not in _BLOCK:
                    end_block()
                close(name)
            continue
        if name in _RAW:
            end = _RAW_END[name].search(page, at)
            at = end.start() if end else len(page)
            continue
        if name == "a":
            in_link = True
        if name in _BLOCK and stack[-1].name == "p":
            close("p")
        if name in ("li", "dd", "td") and opened[name] > 0 and any(o.name == name for o in _siblings(stack)):
            close(name)
        heading = heading or (name[0] == "h" and name[1:].isdecimal())
        above = stack[-1]
        label = _labelled(name, tag[3], above.scope) if tag[3] and name not in ("html", "body") else 0
        drop, scope = max(above.drop, label), above.scope
        if name in _NEVER:
            drop = 2
        elif name == "form" or name == "header" and not scope:
            drop = max(drop, 1)
        elif name == "main" or name == "article" and not scopes:
            drop = 0 if drop == 1 else drop
        if name in ("main", "article") and not drop and not scope:
            scopes += 1
            scope = scopes
        if name not in _VOID and (name in _SCOPE or drop > above.drop or label):
            if name not in _BLOCK:
                end_block()
            stack.append(_Open(name, drop, scope))
            opened[name] += 1
    end_block()
    return out


def _siblings(stack: list[_Open]):
    """Open elements down to the list or table around them; no more than 64, which matters to broken pages only."""
    for o in stack[: -min(len(stack), 64) : -1]:
        if o.name in ("ul", "ol", "dl", "table"):
            return
        yield o


def first_pass(block: Block) -> str:
    """The label of a block by itself: good, bad, ``OPEN`` (short) or ``NEAR`` (neither rich nor poor in stop words)."""
    length = len(block.text)
    if block.dropped or block.linked > length * (LINKS_IN_ARTICLE if block.scope else LINKS):
        return BAD
    if not block.scope and "\N{COPYRIGHT SIGN}" in block.text and length < LONG:
        return BAD
    if length < SHORT:
        return BAD if block.linked and not block.scope else OPEN
    words = _WORD.findall(block.text.lower())
    stops = sum(map(STOP_WORDS.__contains__, words))
    if stops >= STOPS_HIGH * len(words):
        return GOOD if length >= LONG else NEAR
    return NEAR if block.scope or stops >= STOPS_LOW * len(words) else BAD


def second_pass(blocks: list[Block], labels: list[str], edge: str) -> list[str]:
    """Labels for all blocks of one scope; beyond its first and last block stands ``edge``."""
    n = len(blocks)
    after, near = [(n, edge)] * n, (n, edge)
    for i in range(n - 1, -1, -1):
        after[i] = near
        if labels[i] in (GOOD, BAD):
            near = (i, labels[i])
    out, before, start = [], (-1, edge), 0
    starts = []
    for b in blocks:
        starts.append(start)
        start += len(b.text)
    for i, label in enumerate(labels):
        if label in (GOOD, BAD):
            before = (i, label)
        else:
            (j, left), (k, right) = before, after[i]
            if left == right:
                label = left
            elif label == NEAR:
                label = GOOD
            elif edge == BAD and blocks[i].heading and k < n and starts[k] - starts[i] <= HEADING_REACH:
                label = right
            else:
                label = left if i - j < k - i else right if k - i < i - j else BAD
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    """The good blocks of a page, one a line."""
    found = blocks_of(page or "")
    good: list[tuple[int, Block]] = []
    for scope, members in groupby(sorted(range(len(found)), key=lambda i: found[i].scope), key=lambda i: found[i].scope):
        members = [i for i in members if not (scope and found[i].dropped)]  # an advert in an article says nothing about what is around it
        blocks = [found[i] for i in members]
        labels = second_pass(blocks, [first_pass(b) for b in blocks], GOOD if scope else BAD)
        good += [(i, b) for i, b, label in zip(members, blocks, labels) if label == GOOD]
    inside = sum(len(b.text) for _, b in good if b.scope)
    if inside * 2 >= sum(len(b.text) for _, b in good):
        good = [(i, b) for i, b in good if b.scope]
    return "\n".join(b.text for _, b in sorted(good, key=lambda x: x[0]))


def extracted(pages: DataFrame, *, page: str = "html", to: str = "text") -> DataFrame:
    """The rows with the main text of their pages."""

    @F.arrow_udf("string")
    def texts(values: pa.Array) -> pa.Array:
        return pa.array((main_text(v.as_py()) for v in values), pa.string())

    return pages.withColumn(to, texts(F.col(page)))


def op12_main_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
