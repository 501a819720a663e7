"""Main text of web pages (operator 5): a page becomes a flat list of text blocks, and a decision tree over word counts,
link densities and surroundings of a block and its neighbours says which belong to the article."""

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from ledgerline.llm.common import arrow_map
from ledgerline.llm.decision_tree import decide, train
from ledgerline.llm.html_labels import PAGES

SCHEMA = "page_id long, url string, text string, n_chars long"

# Element names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset(
    "article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol search "
    "section table ul".split()
)
#: Not the head: its elements have no text of their own, and its tags may be omitted.
HIDDEN = frozenset("button datalist iframe noscript object option select svg template textarea title".split())
RAW = frozenset("script style xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ASIDE_TAGS = frozenset("aside dialog footer form header menu nav search".split())
MAIN_TAGS = frozenset("article main".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_LABEL = re.compile(r'(?<![\w-])data-keep="([01])"')
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs byline comment comments complementary "
    "consent contentinfo cookie cookies copyright dialog disclaimer feedback footer form gdpr header login masthead "
    "menu modal nav navbar navigation newsletter notice pager pagination popup privacy promo promoted recommended "
    "related reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "tags toc toolbar tracking widget".split()
)
MAIN_NAMES = frozenset("article content entry main post story".split())
#: `no-sidebar` says what a page has or lacks, not what the element is.
STATES = frozenset("has have no not with without".split())


def _side(tag: str, attributes: str, beside: bool = False) -> int:
    """1 for a container of the article, -1 for one beside it, 0 if nothing is known.

    A single name of something beside the article does not outweigh the tags article, main and body, unless the element
    is itself `beside` the article (a comment in the comments); with a name of the article there, nothing is known.
    """
    if tag in ASIDE_TAGS:
        return -1
    main = aside = False
    if attributes:
        for name in (n for value in _NAMES.findall(attributes) for n in value.strip("\"'").split()):
            words = {w.lower() for w in _WORDS.findall(name)}
            if words & ASIDE_NAMES:
                aside |= not words & STATES
            else:
                main |= bool(words & MAIN_NAMES)
    if tag == "body":
        return 0
    if tag in MAIN_TAGS:
        return -1 if aside and beside else 1
    return int(main) - int(aside)


def _closed(page: str, tag: str) -> set[int]:
    """Ends of the start tags of `tag` that have an end tag of their own."""
    closed, starts = set(), []
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])[^>]*>?", page, re.I):
        if not m[1]:
            starts.append(m.end())
        elif starts:
            closed.add(starts.pop())
    return closed


def blocks(page: str, labelled: bool = False) -> list[dict]:
    """The page's text blocks in order: text, words, words in links, side, heading, and, of a `labelled` page, its label.

    A label is the attribute data-keep="0" or "1" of the block or of what contains it; in other pages the name means nothing.
    Work is linear in the page's length, however deep elements stand in each other. Ends of elements may be missing. Scripts, styles, comments, controls and titles have no text. A control without an end
    reaches to the next block or to the end of what contains it.
    """
    found: list[dict] = []
    parts: list[str] = []
    linked = 0
    # Open containers: tag, and of the innermost that says so, side and label, and whether any is of the article.
    stack: list[tuple[str, int, str, bool]] = [("", 0, "", False)]
    opened: Counter = Counter()
    state = {"heading": 0, "keep": ""}
    in_link, hidden, hidden_tag, at = 0, 0, "", 0
    hidden_open, inner, inside = False, [], Counter()  # whether the hidden element has no end, and the containers opened in it
    closed: dict[str, set[int]] = {}

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            words = text.count(" ") + 1
            found.append({
                "text": text, "words": words, "linked": min(linked, words), "side": stack[-1][1],
                "heading": state["heading"], "keep": state["keep"] or stack[-1][2],
            })
        parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            text = entities.unescape(raw)
            parts.append(text)
            if in_link:
                linked += len(text.split())

    position = 0
    while m := _TAG.search(page, position):
        add(page[at : m.start()])
        at = position = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, position)
            at = position = end.end() if end else len(page)
            continue
        if hidden:
            if tag == hidden_tag:
                hidden += -1 if closing else 1
                if not hidden:
                    continue
            elif hidden_open and tag in BLOCKS:
                hidden = 0
            elif tag in CONTAINERS:
                if not closing:
                    inner.append(tag)
                    inside[tag] += 1
                elif inside[tag]:
                    last = ""
                    while last != tag:
                        last = inner.pop()
                        inside[last] -= 1
                elif opened[tag]:
                    hidden = 0
            if hidden:
                continue
        elif tag in HIDDEN:
            if not closing and not attributes.endswith("/"):
                if tag not in closed:
                    closed[tag] = _closed(page, tag)
                hidden, hidden_tag, hidden_open, inner, inside = 1, tag, at not in closed[tag], [], Counter()
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag in BLOCKS:
            flush()
            if re.fullmatch("h[1-6]", tag):
                state["heading"] = 0 if closing else 1
            elif not closing:
                state["heading"] = 0
            label = _LABEL.search(attributes) if labelled and not closing else None
            state["keep"] = label[1] if label else ""
            in_link = 0
            if tag in CONTAINERS:
                if not closing:
                    _, around, keep, article = stack[-1]
                    side = _side(tag, attributes, around < 0)
                    if tag == "header" and article:
                        side = 0  # an article's own heading
                    stack.append((tag, side or around, state["keep"] or keep, article or side == 1))
                    opened[tag] += 1
                elif opened[tag]:
                    last = ""
                    while last != tag:
                        last = stack.pop()[0]
                        opened[last] -= 1
    add(page[at:])
    flush()
    return found


def features(found: list[dict]) -> list[list[float]]:
    """Of each block: words, link density, side and heading; the same of the blocks before and after; whether any
    block of the page is known to be in an article."""
    own = [[min(b["words"], 100), b["linked"] / b["words"], b["side"], b["heading"]] for b in found]
    some = float(any(b["side"] == 1 for b in found))
    edge = [0.0, 0.0, 0.0, 0.0]
    return [
        [*x, *(own[i - 1] if i else edge), *(own[i + 1] if i + 1 < len(own) else edge), some] for i, x in enumerate(own)
    ]


@cache
def classifier():
    """The tree, trained on the labelled pages of html_labels (a fixed, small table)."""
    rows, labels = [], []
    for page in PAGES:
        found = blocks(page, labelled=True)
        rows += features(found)
        labels += [b["keep"] == "1" for b in found]
    return train(np.array(rows, float), np.array(labels))


def main_text(page: str | None, tree=None) -> str:
    tree = classifier() if tree is None else tree
    found = blocks(page or "")
    return "\n\n".join(b["text"] for b, x in zip(found, features(found), strict=True) if decide(tree, x))


def _texts(source, tree) -> Iterator[dict]:
    for batch in source:
        texts = [main_text(h, tree) for h in batch["html"]]
        yield {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": list(map(len, texts))}


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every row of `pages` (page_id, url, html) and its number of code points.

    One row for each row, repeated rows and null ids included; a null, empty or unreadable page has an empty text.
    White space in a block is one space, blocks are joined by an empty line, and nothing is cut off.
    """
    tree = classifier()
    return arrow_map(pages, ["page_id", "url", "html"], SCHEMA, lambda source: _texts(source, tree))
