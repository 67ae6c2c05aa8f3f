"""Operator 6: main text of HTML pages by two-pass block rules."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import bounded_batches, fresh

#: A comment, declaration, tag or one of these cut off by the end of the page. Quoted values may hold ">".
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
_LETTERS = re.compile(r"[^\W\d_]+")

#: Elements whose content is not text.
RAW = frozenset("script style noscript template iframe textarea title svg annotation object select canvas audio video".split())
#: Elements that never hold main text.
SKIP = frozenset("head nav footer aside form button dialog menu fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary center hr header hgroup".split()) | SKIP
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements that close an open one of the same kind.
SELF_CLOSING = frozenset("li dt dd tr td th option".split())
#: Names in class, id and role that mark what is never main text where none of CONTENT stands beside them ...
NEVER = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion comment comments commentlist disqus respond reply replies cookie cookies consent gdpr newsletter subscribe signup breadcrumb breadcrumbs hidden search navigation contentinfo complementary alert alertdialog noprint".split())
#: ... likewise, but frequent parts of other names.
RARELY = frozenset("nav navbar menu header footer masthead sidebar banner sharing popup toolbar pagination pager breadcrumb toc login".split())
#: Ordinary words that mark such an element only where no other name stands beside them.
ALONE = frozenset("side aside rail notice related share social widget modal overlay tags".split())
#: A name that begins so belongs to reader comments, whatever follows of CONTENT.
COMMENT = frozenset("comment comments reply replies".split())
CONTENT = frozenset("content article main post entry body page wrapper container layout story text".split())
#: Parts that a name made of those above may hold besides, as in "sidebar-left" or "ad-container".
PLACES = frozenset("left right top bottom list area box block bar wrap wrapper container section inner outer link links".split())
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on are or this from an at not have has but they his her you which we their its were will "
    "de la le les des et que en un une du qui dans est pour pas par sur au avec ce il elle ne se plus son sa "
    "der die das und den von zu mit sich dem nicht ein eine ist im für auf als auch es an werden aus er hat dass sie nach wird bei "
    "el los las y del se por con no una su para al lo como más pero sus o este si porque".split()
)
#: Rules of the first pass.
LINKED, SHORT, LONG, FEW_STOP_WORDS, MANY_STOP_WORDS = 0.5, 70, 200, 0.2, 0.3
#: An article tag isn't trusted if so many times its text is decided as main text outside of it.
OUTWEIGHED = 4


def _unwanted(tag: str, attributes: str) -> bool:
    """Whether an element is hidden or named as what is never main text. Names count as a whole, and block scores
    decide where a name of content stands beside."""
    if tag in ("html", "body", "main") or not attributes:
        return False
    junk = content = other = alone = False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true":
            return True
        if key in ("class", "id", "role"):
            for name in value.split():
                parts = _parts(name)
                known = set(parts)
                whole = known <= NEVER | RARELY | ALONE | PLACES and "hidden" not in known
                bad = name.lower() in NEVER or whole and bool(known & (NEVER | RARELY)) or bool(parts) and parts[0] in COMMENT and known <= COMMENT | CONTENT | PLACES
                junk |= bad
                alone |= whole and bool(known & ALONE)
                content |= not bad and bool(known & CONTENT)
                other |= not bad and not whole
    return (junk or alone and not other) and not content and (tag != "article" or junk)


def _parts(name: str) -> list[str]:
    """Words of one class token, id or role: letters between other characters and changes of case."""
    return [x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if x]


#: Text, whether it stands in the article, share of link text, and whether it is a heading.
Block = tuple[str, bool, float, bool]


def blocks_of(html: str) -> list[Block]:
    """Blocks outside skipped elements, in page order."""
    blocks: list[Block] = []
    stack: list[tuple[str, bool]] = []  # open elements and whether their content is skipped
    opened: Counter = Counter()
    skipped = links = articles = breaks = 0
    texts: list[str] = []
    linked = 0
    at = 0

    def flush(inside: bool) -> None:
        nonlocal linked
        if texts:
            if text := " ".join("".join(texts).split()):
                blocks.append((text, inside, min(1.0, linked / len(text)), any(opened[h] for h in HEADINGS)))
            texts.clear()
        linked = 0

    def close(name: str) -> None:
        nonlocal skipped, links, articles
        while opened[name]:
            top, bad = stack.pop()
            opened[top] -= 1
            skipped -= bad
            links -= top == "a"
            articles -= top in ("article", "main")
            if top == name:
                return

    size = len(html)
    while at < size:
        found = _MARKUP.search(html, at)
        end = found.start() if found else size
        if end > at and not skipped:
            piece = html[at:end]
            piece = unescape(piece) if "&" in piece else piece
            texts.append(piece)
            if piece.strip():
                breaks = 0
                linked += len(piece.strip()) if links else 0
        if not found:
            break
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            breaks += 1
            texts.append(" ")
            if breaks == 2:
                flush(articles > 0)
            continue
        if tag in BLOCK:
            flush(articles > 0)
        if found[1]:
            close(tag)
            continue
        if tag in RAW:
            texts.append(" ")
            if not found[3].endswith("/"):
                stop = re.compile(f"</{re.escape(tag)}\\b[^>]*>?", re.I).search(html, at)
                at = stop.end() if stop else size
            continue
        if tag in VOID:
            continue
        if opened["p"] and tag in BLOCK:
            close("p")
        if tag in SELF_CLOSING and stack and stack[-1][0] == tag:
            close(tag)
        bad = tag in SKIP or tag == "header" and not articles or _unwanted(tag, found[3])
        stack.append((tag, bad))
        opened[tag] += 1
        skipped += bad
        links += tag == "a"
        articles += tag in ("article", "main")
    flush(articles > 0)
    return blocks


def _decided(block: Block) -> bool | None:
    """First pass: link density, length and stop-word density decide a block or leave a short one open."""
    text, _, density, _ = block
    words = [w.lower() for w in _LETTERS.findall(text)]
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if density > LINKED:
        return False
    if len(text) < SHORT:
        return False if density > 0.2 else None
    if stops >= MANY_STOP_WORDS or len(text) >= LONG and stops >= FEW_STOP_WORDS:
        return True
    return False if stops < FEW_STOP_WORDS else None


def labels_of(blocks: list[Block]) -> list[bool]:
    """Which blocks are main text.

    First pass: link density, length and stop-word density decide a block or leave a short one
    open. Second pass: an open block takes the label of the nearest decided block, before or after
    it. Where they are as near and differ, a heading goes with what follows and other blocks go;
    so do they where nothing is decided.

    A page that marks its article rules out what lies outside and keeps what lies inside, however
    short, linked or poor in stop words, since unwanted elements are gone by then. But where the
    first pass finds OUTWEIGHED times as much main text outside, the tag marks a teaser, and all blocks
    are judged by the rules.
    """
    first = [_decided(b) for b in blocks]
    inside = sum(len(b[0]) for b in blocks if b[1])
    if inside and sum(len(b[0]) for b, label in zip(blocks, first, strict=True) if label and not b[1]) <= OUTWEIGHED * inside:
        return [b[1] for b in blocks]
    far = len(blocks) + 1
    before: list[tuple[int, bool]] = []
    last = (-far, False)
    for i, label in enumerate(first):
        last = (i, label) if label is not None else last
        before.append(last)
    out, after = [False] * len(blocks), (2 * far, False)
    for i in range(len(blocks) - 1, -1, -1):
        if first[i] is not None:
            after = (i, first[i])
            out[i] = first[i]
            continue
        left, right = i - before[i][0], after[0] - i
        if min(left, right) >= far or left == right and before[i][1] != after[1]:
            out[i] = blocks[i][3] and right < far and after[1]
        else:
            out[i] = before[i][1] if left <= right else after[1]
    return out


def main_text(html: str | None) -> str:
    """Main text of one page: its blocks joined by line feeds; empty for null."""
    blocks = blocks_of(html or "")
    return "\n".join(b[0] for b, keep in zip(blocks, labels_of(blocks), strict=True) if keep)


def extract_main_text(pages: DataFrame, html_col: str = "html", into: str = "main_text") -> DataFrame:
    """All columns of pages and the main text of each whole page (column renamed if taken).

    One pass where the rows lie, without a shuffle. Null or empty html, and pages without main
    text: the empty string. Cut-off tags are dropped, unclosed elements end with the page.
    Repeated rows: each judged alone.
    """
    bounded_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def extract(html: pa.Array) -> pa.Array:
        return pa.array([main_text(x) for x in html.to_pylist()], pa.string())

    return pages.withColumn(fresh(pages, into)[0], extract(F.col(html_col)))


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
