"""HTML extraction (operator 1): two passes over the blocks of a page. The first decides blocks by their share of text in
links, their length and their share of stop words; short blocks stay open, and so do those of few stop words next to good ones.
The second gives an open block the label of the nearest decided block of its container, or, if it has none, of the page.

Menus, page headers, footers, sidebars, notices, adverts, forms and reader comments that say what they are by element, class,
id or role are bad from the start. Where a page marks its article (article, main, or the role), blocks outside it are bad too;
in it, and in pages without a mark, the two passes decide. A container with more open text without links than there is good text on
the page is good too: a page may have no stop word of a known language.

Character references are decoded, white space within a block becomes one space, blocks are trimmed and joined by one space in
page order. Unclosed comments, scripts and tags reach to the end of the page. A null page, an empty one and one without good
blocks give an empty text. Each row is read whole and by itself, repeated rows alike; extra columns are not looked at."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_LINKED, SOME_LINKED = 0.5, 0.2
SHORT = 70
LONG = 200
STOP_LOW, STOP_HIGH = 0.1, 0.2

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about all an and are as at be been but by can for from had has have he her his i if in is it its more no not of on one or our out she so
    that the their there they this to up was we were what when which who will with would you
    aber als am an auch auf aus bei bin das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch
    nur oder sich sie sind so über um und von vor war wie wird zu zum zur
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour que qui sa se ses son sur une un vous
    al como con de del el ella en es esta este ha la las lo los más no o para pero por que se si sin sobre son su sus también un una y ya""".split()
)
#: Elements that end a block of text.
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr
    html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul""".split()
)
#: Elements whose content is no text of the page.
RAW = frozenset("button canvas iframe math noframes noscript object script select style svg template textarea title video audio".split())
#: Elements that hold other things than the article.
ASIDE = frozenset("aside dialog footer form menu nav".split())
#: Words in class, id or role that say the same.
ASIDE_NAMES = frozenset(
    """ad ads adv advert advertisement adverts alert banner breadcrumb breadcrumbs byline comment comments commentlist complementary consent contentinfo cookie
    cookies dialog discussion disqus footer form gdpr header login menu menubar modal nav navbar navigation newsletter notice notices notification overlay
    paywall pagination pager popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor
    sponsored subscribe subscription toc toolbar topbar widget widgets""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_TAG = re.compile(r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<[!?/][^>]*(?:>|$)|</?[a-zA-Z][^<>]*$")
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_EDGES = ".,;:!?()[]{}\"'«»„“”…-–—"


def _marks(attributes: str) -> tuple[bool, bool]:
    """Whether the attributes say: not the article; the article."""
    off = main = False
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            off = True
        elif name in ("class", "id", "role"):
            off |= any(x.lower() in ASIDE_NAMES for x in _PARTS.findall(value))
            main |= name == "role" and value in ("main", "article")
    return off, main


@dataclass(slots=True)
class Block:
    """A block of text: where it stands, the place of its container, whether it is a heading, its share of characters in links."""

    aside: bool
    article: bool
    container: int
    heading: bool
    text: str = ""
    linked: float = 0.0


#: Elements that belong to the container which they stand in.
_PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote figure figcaption table td th tr tbody thead tfoot summary legend center header section hr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in order."""
    found: list[tuple[Block, list[tuple[str, bool]]]] = []
    stack: list[tuple[str, bool, bool, int]] = []  # element, aside, article, container
    open_names: Counter[str] = Counter()
    links, block, at, containers = 0, None, 0, 0

    def put(text: str) -> None:
        nonlocal block
        if not text:
            return
        if block is None:
            _, off, main, own = stack[-1] if stack else ("", False, False, 0)
            block = (Block(off, main, own, any(x[0] in _HEADINGS for x in stack[-3:])), [])
            found.append(block)
        block[1].append((text, links > 0))

    def leave(k: int) -> None:
        open_names.subtract(x[0] for x in stack[k:])
        del stack[k:]

    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW and not closing:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|$)", re.I).search(page, at)
                at = len(page) if not end else end.end()
            if name not in ("svg", "math", "button"):
                block = None
            continue
        if name == "br":
            put(" ")
        elif name == "a":
            links = max(0, links - 1) if closing else links + 1
        if name in BLOCKS:
            block, links = None, 0
        if name in VOID:
            continue
        if closing:
            if open_names[name] > 0:
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)
                if stack[k][1] != (stack[k - 1][1] if k else False):
                    block = None
                leave(k)
            continue
        if name in BLOCKS and stack and stack[-1][0] == "p":
            leave(len(stack) - 1)
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            leave(len(stack) - 1)
        off, main = _marks(attributes) if attributes.strip() else (False, False)
        _, above_off, above_main, container = stack[-1] if stack else ("", False, False, 0)
        article = above_main or main or name in ("article", "main")
        if name in ("body", "html", "article", "main"):
            off = False
        off |= name in ASIDE or name == "header" and not article
        if off and not above_off:
            block = None
        if name in BLOCKS and name not in _PLAIN:
            containers += 1
            container = containers
        stack.append((name, above_off or off, article, container))
        open_names[name] += 1
    out = []
    for b, parts in found:
        b.text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
        if b.text:
            chars = [(len(t.strip()), linked) for t, linked in parts]
            b.linked = sum(n for n, linked in chars if linked) / max(1, sum(n for n, _ in chars))
            out.append(b)
    return out


def _stop_share(text: str) -> float:
    own = text.lower().split()
    return sum(w.strip(_EDGES) in STOP_WORDS for w in own) / max(1, len(own))


def _decided(block: Block) -> bool | None:
    """The first pass: good, bad or open."""
    if block.linked > MOST_LINKED:
        return None if block.heading else False
    if block.heading or len(block.text) < SHORT or block.linked > SOME_LINKED:
        return None
    share = _stop_share(block.text)
    return True if share >= STOP_HIGH or share >= STOP_LOW and len(block.text) >= LONG else None


def _nearest(known: list[int], k: int) -> list[int]:
    """The known places next to k, which is none of them, on either side."""
    at = bisect_left(known, k)
    return known[max(0, at - 1) : at + 1]


def labels(found: list[Block]) -> list[bool]:
    """Whether each block is part of the main text."""
    has_article = any(b.article and not b.aside for b in found)
    inside = [not b.aside and (b.article or not has_article) for b in found]
    decided = [_decided(b) if own else False for b, own in zip(found, inside, strict=True)]
    # free text that no rule has decided: more of it in one container than good text on the page is the text too
    free = [own and x is None and not b.linked for b, own, x in zip(found, inside, decided, strict=True)]
    sizes: Counter[int] = Counter()
    for b, x in zip(found, free, strict=True):
        sizes[b.container] += len(b.text) * x
    largest = max(sizes, key=lambda k: (sizes[k], -k), default=0)
    good = sum(len(b.text) for b, x in zip(found, decided, strict=True) if x)
    if sizes[largest] > good:
        decided = [True if x and (b.container == largest or b.article and not good) else y for b, x, y in zip(found, free, decided, strict=True)]
    # a long block of few stop words is bad, unless its container or the article's mark speaks for it
    trusted = {b.container for b, x in zip(found, decided, strict=True) if x}
    for k, b in enumerate(found):
        if decided[k] is None and len(b.text) >= LONG and not b.article and b.container not in trusted and _stop_share(b.text) < STOP_LOW:
            decided[k] = False
    out = [x is True for x in decided]
    known, by_container = [], defaultdict(list)
    for k, x in enumerate(decided):
        if x is not None:
            known.append(k)
            if inside[k]:
                by_container[found[k].container].append(k)
    for k in (k for k, x in enumerate(decided) if x is None):
        # within a container a tie is good; between containers it is bad, and so is what lies beyond the page's ends
        near = [(abs(x - k), not decided[x]) for x in _nearest(by_container[found[k].container], k)]
        if not near:
            around = [(abs(x - k), decided[x]) for x in _nearest(known, k)] + [(k + 1, False), (len(found) - k, False)]
            out[k] = min(around)[1]
        else:
            out[k] = not min(near)[1]
    return out


def main_text(page: str | None) -> tuple[str, int, int]:
    """The main text of a page, its number of blocks, and how many of them were kept."""
    found = blocks(page or "")
    kept = [b.text for b, good in zip(found, labels(found), strict=True) if good]
    return " ".join(kept), len(found), len(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            out = [main_text(x.as_py()) for x in part.column(2)]
            texts, seen, kept = map(list, zip(*out, strict=True))
            counts = {"n_chars": list(map(len, texts)), "n_blocks": seen, "n_kept": kept}
            yield pa.RecordBatch.from_pydict({"page_id": part.column(0), "url": part.column(1), "text": pa.array(texts, pa.string())} | {k: pa.array(v, pa.int64()) for k, v in counts.items()})


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept of each row."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
