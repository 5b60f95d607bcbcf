"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Menus, headers, footers, sidebars, buttons, scripts and styles, by their
tags, give no blocks. Evidence of a block is its length, its density of stop words, its share of linked characters,
whether it lies in a declared article or main element, and whether an element around it names itself (class, id, role) as
something else than the article. Such names count for nothing on an element that holds the page's heading or main element,
so a layout class on a wrapper doesn't hide the article.

The first pass decides: self-named blocks (which are no neighbours either), link-dense blocks, and blocks beside a declared
article are boilerplate; long
blocks with enough stop words are text, in a declared article with any; long blocks without stop words are boilerplate if
the page declares nothing. Other blocks, above all short ones, stay open. The second pass gives each open block the label
of its nearest decided neighbours, where the ends of a declared article count as text: two that agree decide, otherwise
the nearer one does (in a declared article: text does), and text wins a tie. A page without any decided block keeps its
open blocks.

Character references are decoded, white space in a block becomes one space, blocks join by one newline. Null, empty and
tag-only pages give an empty text. Repeated rows keep their rows, empty tables give none. Other columns are not read. Pages
are read whole, in time linear in their length even where tags are not closed.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, small_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|textarea|title|iframe|math|select|object)\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^>"']++)*+)>"""
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr "
    "ul head".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NOT_TEXT = set("nav header footer aside form button dialog menu head".split())
HINTS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer bottom sidebar aside widget ad ads adv advert "
    "adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup "
    "modal overlay newsletter subscribe signup login comment comments disqus reply replies respond share sharing social related "
    "recommended pagination pager toolbar form search".split()
)
WHOLE = set("body html main article".split())
REMARKS = set("comment comments disqus reply replies respond".split())  # each remark may be an article of its own
NEGATED = set("no without hide".split())
HINTED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
# fixed values: frequent function words of the languages in use
STOP = {
    "en": "the of and to a in is it that for on with as was by be this are at from or an not have but they you which had her his",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er so dass sie nach wird bei",
    "fr": "le la les de des du un une et en est que qui dans pour par sur pas au avec ce il sont plus se ne à son elle ou",
    "es": "el la los las de del y en que un una es se no por con para su al lo como más o pero sus le ha este sí",
}
STOP_WORDS = frozenset(w for ws in STOP.values() for w in ws.split())
WORD = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("parts", "linked", "declared", "heading", "inside")

    def __init__(self, declared: bool, heading: bool, inside: tuple[int, ...]):
        self.parts: list[str] = []
        self.linked, self.declared, self.heading, self.inside = 0, declared, heading, inside


class Element:
    """An open element: its tag, and what its subtree is."""

    __slots__ = ("tag", "hidden", "declares", "named")

    def __init__(self, tag: str, attrs: str):
        names = [re.split(r"[^a-z0-9]+", "".join(g).lower()) for g in HINTED.findall(attrs)]
        found = {w for ws in names for k, w in enumerate(ws) if not (k and ws[k - 1] in NEGATED)}
        self.tag, self.hidden = tag, tag in NOT_TEXT and tag != "form"
        self.declares = tag in ("article", "main") or "main" in found
        hints = found & HINTS if tag not in WHOLE else set()
        self.named = (2 if hints <= REMARKS else 1) if hints else int(tag == "form")


def blocks(page: str) -> list[tuple[str, Block, bool]]:
    """Blocks of a page in order, their white space collapsed, and whether an element around names itself as no text."""
    out: list[Block] = []
    stack: list[Element] = []
    opened: Counter[str] = Counter()
    named: list[int] = []  # open self-named elements, by number
    kinds: list[int] = []  # of each self-named element: 1, 2 for remarks, 0 if it holds the page's own heading or article
    hidden = declared = links = 0
    now: Block | None = None
    at = 0

    def text(a: int, b: int) -> None:
        nonlocal now
        if a >= b or hidden:
            return
        part = html.unescape(page[a:b])
        if now is None:
            heading = any(e.tag[0] == "h" and e.tag[1:].isdigit() for e in stack[-3:])
            now = Block(declared > 0, heading, tuple(named))
            out.append(now)
        now.parts.append(part)
        if links:
            now.linked += len("".join(part.split()))

    def close() -> str:
        nonlocal hidden, declared, links
        gone = stack.pop()
        opened[gone.tag] -= 1
        hidden, declared, links = hidden - gone.hidden, declared - gone.declares, links - (gone.tag == "a")
        if gone.named:
            named.pop()
        return gone.tag

    for m in TOKEN.finditer(page):
        text(at, m.start())
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            now = None
        elif tag == "br" and now is not None:
            now.parts.append(" ")
        if tag in VOID:
            continue
        if not m["close"]:
            if (m["attrs"] or "").rstrip().endswith("/"):
                continue
            if tag in ("p", "li", "a") and stack and stack[-1].tag == tag:
                close()  # its end tag is optional or missing
            element = Element(tag, m["attrs"] or "")
            if not hidden and tag in ("h1", "main", "article"):
                for k in named:
                    kinds[k] *= kinds[k] == 2 and tag == "article"
            stack.append(element)
            opened[tag] += 1
            hidden, declared, links = hidden + element.hidden, declared + element.declares, links + (tag == "a")
            if element.named:
                named.append(len(kinds))
                kinds.append(element.named)
        elif opened[tag]:
            while close() != tag:
                pass
    text(at, len(page))
    joined = ((" ".join("".join(b.parts).split()), b) for b in out)
    return [(t, b, any(kinds[k] for k in b.inside)) for t, b in joined if t]


def first_pass(line: str, block: Block, has_declared: bool, long: int, link_limit: float, stop_limit: float) -> bool | None:
    """True: text; False: boilerplate; None: open."""
    if block.linked > link_limit * len(line.replace(" ", "")) or (has_declared and not block.declared):
        return False
    if len(line) < long:
        return None
    ws = WORD.findall(line.lower())
    density = sum(w in STOP_WORDS for w in ws) / max(1, len(ws))
    if block.declared:
        return True if density > 0 else None
    return density >= stop_limit


def second_pass(labels: list[bool | None], headings: list[bool], declared: list[bool] | None = None) -> list[bool]:
    """Open blocks take the label of their nearest decided neighbours; headings look ahead first."""
    n, declared = len(labels), declared or [False] * len(labels)

    def nearest(order) -> list[tuple[int, bool] | None]:
        out: list[tuple[int, bool] | None] = [None] * n
        seen, last = None, None
        for k in order:
            if declared[k] and last is not None and not declared[last]:
                seen = (last, True)  # the declared element begins here
            if declared[k] and last is None:
                seen = (k + (1 if order.step < 0 else -1), True)
            out[k] = seen
            if labels[k] is not None:
                seen = (k, bool(labels[k]))
            last = k
        return out

    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    out = []
    for k, label in enumerate(labels):
        a, b = before[k], after[k]
        if label is not None:
            out.append(bool(label))
        elif a is None and b is None:
            out.append(True)
        elif a is None or b is None:
            out.append((a or b)[1])  # type: ignore[index]
        elif a[1] == b[1]:
            out.append(a[1])
        elif declared[k]:
            out.append(True)
        elif headings[k]:
            out.append(b[1])
        else:
            da, db = k - a[0], b[0] - k
            out.append(a[1] if da < db else b[1] if db < da else True)
    return out


def judged(page: str | None, long: int = 80, link_limit: float = 0.33, stop_limit: float = 0.12) -> tuple[str, int, int]:
    """The main text, and how many blocks each pass decided."""
    every = blocks(page or "")
    found = [(t, b) for t, b, named in every if not named]  # insertions are nobody's neighbours
    has_declared = any(b.declared for _, b in found)
    labels = [first_pass(t, b, has_declared, long, link_limit, stop_limit) for t, b in found]
    kept = second_pass(labels, [b.heading for _, b in found], [b.declared for _, b in found])
    opened = sum(x is None for x in labels)
    return "\n".join(t for (t, _), k in zip(found, kept, strict=True) if k), len(every) - opened, opened


def main_text(page: str | None, long: int = 80, link_limit: float = 0.33, stop_limit: float = 0.12) -> str:
    return judged(page, long, link_limit, stop_limit)[0]


def extract(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    long: int = 80,
    link_limit: float = 0.33,
    stop_limit: float = 0.12,
) -> DataFrame:
    """page_id, url, text, n_chars, and n_first and n_second, the blocks that each pass decided."""
    small_batches(pages.sparkSession)
    frame = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html")
    )

    def run(it):
        for batch in batches(it):
            got = [judged(x, long, link_limit, stop_limit) for x in batch.column("html").to_pylist()]
            text = [g[0] for g in got]
            cols = [pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), *[pa.array([g[k] for g in got], pa.int32()) for k in (1, 2)]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), *cols], names=["page_id", "url", "text", "n_chars", "n_first", "n_second"]
            )

    return frame.mapInArrow(run, f"page_id {frame.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, n_first int, n_second int")
