"""Main text of web pages by a maximum-scoring contiguous region.

A page becomes a row of tags and text runs, without comments, declarations,
``head``, raw-text elements (scripts, styles ...) and without subtrees that
their element, role, class or id marks as menu, page header or footer, sidebar,
notice, advert, form or reader comments.  A class or id marks an element if it is
one of the words for such, ends in one (site-footer), or has one before a word
for a container (share-buttons, but not share-price), and does not begin with has-,
no-, with- and the like; in the labelled content ids mark reader comments alone,
and emphasis, links and headings are never marked.  Nothing is left out
that holds the page's first ``main`` or ``article``, and on a page without these no
form, role, class or id leaves out most of its words.  Every word scores ``word``,
every tag a negative weight; one linear scan (Kadane, 1984; Bentley, 1984) finds
the contiguous region of the largest sum.  Blocks that have text in the region
are the main text.  Where a page labels its content, the region lies within one
label and tags there cost nothing, so a list of links does not part an article;
an ``article`` with half the words of the ``main`` around it is the label.

The weights come from labelled pages, those that mark their content with
``article`` or ``main``: a tag that is mostly outside costs nearly ``SCALE``
words, one that is mostly inside nearly nothing, a tag that no labelled page
has a tenth of a word (a link: one word).  The labelled sample has at most ``max_train`` pages in
expectation and is counted where it lies.

Text is decoded (character references), its white space runs become one space,
blocks are trimmed and joined by one newline in page order; nothing is capped.
Pages are read in linear time: from the first tag on whose quotes do not close,
tags end at the next ``>``, and one that the page's end cuts off is dropped.
``br`` and table cells are white space inside a block.

Nulls and edges: a null or empty page, or one without words, has the text ``''``
and n_chars 0; an element that is never closed hides nothing but itself; a page
cut short is read to its end; equal scores take the first, then the longest
region; repeated rows give repeated results; no labelled page: the default
weights; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .packing import slices
from .shared import map_arrow

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|([^<]+|<(?!/?[a-zA-Z]))",
    re.S,
)
#: a tag whose quotes mean nothing
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
TAG_START = re.compile(r"</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.I)
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("nav footer aside form button select menu dialog head fieldset datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
SPACES = frozenset("br td th".split())
LABELS = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar aside cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay paywall newsletter subscribe subscription signup login menu nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "footer masthead related recommended share sharing social toolbar widget widgets comment comments commentlist respond replies disqus search skip hidden".split()
)
#: a class or id that begins so tells of a state of the page or of what is in it
STATES = frozenset("has have no not non with without is in hide show enable enabled disable disabled supports".split())
#: what a mark in front of it makes part of the page's frame: a container and not what is told
CONTAINERS = frozenset(
    "box boxes container wrapper wrap inner outer block blocks bar list lists item items group area section slot unit row col column panel pane content body holder frame top bottom left right "
    "header title heading button buttons link links icon icons post posts story stories count form field input text label list-item zone region module card cards tools tool".split()
)
COMMENTS = frozenset("comment comments commentlist respond replies disqus".split())
UNMARKED = frozenset("a abbr b cite code em h1 h2 h3 h4 h5 h6 i mark q small strong sub sup u".split())
QUOTES = frozenset("quote quotes pullquote pull blockquote".split())
#: elements that are left out by name, but not with most of a page's words
WRAPPERS = frozenset("form fieldset aside".split())
HEADS = frozenset(("header", "topbar", "site-header", "page-header"))
SCALE, WORD = 12.0, 1.0
#: how often a tag counts as seen outside before any page is: links more than others
PRIOR, PRIOR_LINK = 0.01, 0.1


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw else {}


def _marked(name: str, raw: str, inside: bool) -> str:
    """How an element is boilerplate by its own name or attributes: not at all '', ``unseen``, or by ``name`` or ``mark``."""
    a = _attributes(raw)
    if name not in LABELS and name not in ("body", "html") and ("hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()):
        return "unseen"
    words = (a.get("class", "") + " " + a.get("id", "")).lower().split()
    if name in WRAPPERS:
        return "" if inside and name == "aside" and any(not QUOTES.isdisjoint(_parts(w)) for w in words) else "mark"
    if name in HIDDEN or (name == "header" and not inside):
        return "name"
    if not a or name in LABELS or name in ("body", "html"):
        return ""
    if a.get("role", "").lower() in ROLES:
        return "mark"
    if name in UNMARKED:
        return ""
    if any(map(_is_mark, a.get("class", "").lower().split())):
        return "mark"
    if any(_is_mark(w) and (not inside or not COMMENTS.isdisjoint(_parts(w))) for w in a.get("id", "").lower().split()):
        return "mark"
    return "mark" if not inside and not HEADS.isdisjoint(words) else ""


def _parts(word: str) -> list[str]:
    return [x for x in re.split(r"[^a-z0-9]+", word) if x]


def _is_mark(word: str) -> bool:
    """Whether a class or id names a part of the page's frame."""
    parts = _parts(word)
    if not parts or parts[0] in STATES:
        return False
    *rest, last = parts
    return last in MARKS or ((last in CONTAINERS or any(map(str.isdigit, last))) and not MARKS.isdisjoint(rest))


def _all_tokens(page: str) -> list[tuple[str, bool, str]]:
    """(tag, closes, attributes) and ('', False, text) in page order, without comments and raw-text elements."""
    found: list[tuple[str, bool, str]] = []
    at, size = 0, len(page)
    endless: set[str] = set()  # raw-text elements with no end from here on
    quoted = True
    while at < size:
        m = (TOKEN if quoted or not TAG_START.match(page, at) else PLAIN_TAG).match(page, at)
        if m is None and quoted:
            quoted = False
            continue
        if m is None:  # a tag that the page's end cuts off
            break
        at = m.end()
        if m[2] is None:
            if m[4]:
                found.append(("", False, m[4]))
            continue
        name, closes = m[2].lower(), bool(m[1])
        if not closes and name in RAW and not m[3].endswith("/"):
            end = None if name in endless else re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in ("textarea", "title"):
                endless.add(name)
            else:
                at = size
            continue
        found.append((name, closes, m[3]))
    return found


def page_tokens(page: str) -> list[tuple[str, str]]:
    """(tag, '') and ('', text) in page order, boilerplate left out; tags that close begin with /."""
    tokens = _all_tokens(page)
    ends: dict[int, int] = {}  # where each element that is closed ends
    open_at: dict[str, list[int]] = {}
    mains: list[int] = []  # the first of each label
    before = [0]  # words before each token
    for i, (name, closes, rest) in enumerate(tokens):
        before.append(before[-1] + (0 if name else len(rest.split())))
        if not name or name in VOID:
            continue
        if not closes:
            open_at.setdefault(name, []).append(i)
            if name in LABELS and all(tokens[k][0] != name for k in mains):
                mains.append(i)
        elif open_at.get(name):
            ends[open_at[name].pop()] = i
    found: list[tuple[str, str]] = []
    i, inside = 0, 0
    while i < len(tokens):
        name, closes, rest = tokens[i]
        i += 1
        if not name:
            found.append(("", rest))
            continue
        if closes:
            if name in LABELS:
                inside = max(0, inside - 1)
        elif name in VOID or rest.endswith("/"):
            pass
        elif mark := _marked(name, rest, inside > 0):
            end = ends.get(i - 1)
            if end is None:
                continue
            most = mark == "mark" and not mains and 2 * (before[end] - before[i]) > before[-1]
            if mark == "unseen" or not (most or any(i <= k < end for k in mains)):
                i = end + 1
                continue
        elif name in LABELS:
            inside += 1
        found.append(("/" + name if closes else name, ""))
    return found


def tag_counts(page: str) -> Counter:
    """(tag, inside) -> count, for a page whose content is labelled; otherwise nothing."""
    tokens = page_tokens(page)
    if not any(t in LABELS for t, _ in tokens):
        return Counter()
    counts, depth = Counter(), 0
    for tag, _ in tokens:
        if not tag:
            continue
        if tag[0] == "/" and tag[1:] in LABELS:
            depth = max(0, depth - 1)
        counts[tag, depth > 0 and tag.lstrip("/") not in LABELS] += 1
        if tag in LABELS:
            depth += 1
    return counts


def tag_weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Words that each tag costs."""
    out = {}
    for tag in {t for t, _ in counts}:
        inside, outside = counts.get((tag, True), 0), counts.get((tag, False), 0)
        out[tag] = -SCALE * (outside + _prior(tag)) / (inside + outside + 1)
    return out


def _prior(tag: str) -> float:
    return PRIOR_LINK if tag.lstrip("/") == "a" else PRIOR


def best_region(scores: list[float]) -> tuple[int, int]:
    """[first, end) of the contiguous run of the largest sum; (0, 0) if none is over 0."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += x
        if total > best or (total == best and best and start == span[0]):
            best, span = total, (start, i + 1)
    return span


def _labelled(tokens: list[tuple[str, str]], words: list[int]) -> list[bool] | None:
    """Whether each token is in the page's label; None if no label has a word."""
    depth = {"article": 0, "main": 0}
    inside: dict[str, list[bool]] = {name: [] for name in depth}
    for tag, _ in tokens:
        name = tag.lstrip("/")
        if name in depth and tag != name:
            depth[name] = max(0, depth[name] - 1)
        for k, flags in inside.items():
            flags.append(depth[k] > 0)
        if tag in depth:
            depth[tag] += 1
    held = {k: sum(n for n, f in zip(words, flags) if f) for k, flags in inside.items()}
    if held["article"] and 2 * held["article"] >= held["main"]:
        return inside["article"]
    return inside["main"] if held["main"] else None


def main_text(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    tokens = page_tokens(page)
    texts = [html.unescape(t) if not tag and "&" in t else t for tag, t in tokens]
    words = [0 if tag else len(t.split()) for (tag, _), t in zip(tokens, texts)]
    label = _labelled(tokens, words)
    if label is None:
        scores = [weights.get(tag, -SCALE * _prior(tag)) if tag else WORD * n for (tag, _), n in zip(tokens, words)]
    else:
        scores = [WORD * n if within else -math.inf for n, within in zip(words, label)]
    first, end = best_region(scores)
    blocks: list[str] = []
    parts: list[str] = []
    chosen = False

    def flush() -> None:
        nonlocal chosen
        if chosen and (text := " ".join("".join(parts).split())):
            blocks.append(text)
        parts.clear()
        chosen = False

    for i, ((tag, _), text) in enumerate(zip(tokens, texts)):
        if not tag:
            parts.append(text)
            chosen |= first <= i < end and bool(text.strip())
        else:
            name = tag.lstrip("/")
            if name in BLOCKS:
                flush()
            elif name in SPACES:
                parts.append(" ")
    flush()
    return "\n".join(blocks)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for page in batch.column(0).to_pylist():
            total.update(tag_counts(page or ""))
    keys = sorted(total)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], ["tag", "inside", "n"])


def learn_weights(pages: DataFrame, *, key_col: str, html_col: str, max_train: int) -> dict[str, float]:
    """Weights from a bounded sample of labelled pages; only tag counts reach the driver."""
    labelled = pages.select(F.xxhash64(F.col(key_col), F.lit(5)).alias("draw"), F.col(html_col).cast("string").alias("html")).where(F.col("html").rlike("(?i)<(article|main)[ >]"))
    n = labelled.count()
    if not n:
        return {}
    limit = int(min(1.0, max_train / n) * (1 << 30))
    counts = map_arrow(labelled.where(F.pmod("draw", F.lit(1 << 30)) < limit).select("html"), _count, "tag string, inside boolean, n long")
    # tag names that one page alone invents are noise and unbounded; what is left is HTML's vocabulary
    common = counts.groupBy("tag", "inside").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "tag", "inside").limit(1000)
    return tag_weights({(r["tag"], r["inside"]): r["n"] for r in common.collect()})


def _extract(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [main_text(p, weights) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_train: int = 400) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    weights = learn_weights(pages, key_col=id_col, html_col=html_col, max_train=max_train)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_arrow(rows, _extract(weights), f"page_id {kind}, url string, text string, n_chars long")
