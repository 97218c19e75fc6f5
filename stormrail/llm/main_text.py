"""Main text of web pages: the maximum-scoring contiguous run of tokens.

A page is a sequence of tags and words. Tags score negative. A word scores by what its place says: each element it lies
in has a name and words in its class, id and role, and each of those has a weight, the log-likelihood ratio of words inside
and outside the content, learned from pages that mark their article. The innermost telling element decides, outer ones
count for a quarter. One linear scan finds the run of tokens with the largest sum; the text is the run's words that score
positive. So a box in the middle of an article is left out by its score, as a menu beside it is.

Names that no labelled page has get a weight from fixed lists of HTML's own words. An element that holds most of a page's
words, and content by its name among them, is a frame around the page, whatever it is called, and speaks against none. Scripts, styles and comments are
no tokens at all.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormrail.llm.common import slices

#: Labelled pages that the weights are learned from at most: those with the smallest hashes of their addresses.
LABELLED_PAGES = 2000
#: Least and largest gain of a word, least and largest loss. The largest loss keeps a box in the middle of an article from
#: parting it.
GAIN, LOSS = (0.2, 1.0), (0.5, 1.0)
#: Least and largest loss of a tag.
TAG_LOSS = (0.05, 0.3)
#: Weights are cut at the first, tell from the second on, and the fixed lists give the third.
CUT, TELLING, LISTED = 3.0, 1.0, 2.0
#: Parts of an element's weight that count: of the elements around a telling one, of one that tells nothing by itself.
OUTER, FAINT = 0.25, 0.3
#: Words of labelled pages that a name needs for a weight of its own.
LEAST_WORDS = 20
#: An element with more than this share of a page's words may be a frame.
FRAME = 0.5

# Fixed lists of HTML: elements whose text is no text, elements without an end, elements that begin a new block,
# elements that hold no article text.
RAW = ("script", "style", "template", "noscript", "textarea", "svg", "iframe", "object")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "select summary table tbody td tfoot th thead title tr ul".split())
ASIDE = frozenset("nav aside footer form menu dialog button select title head option label".split())
#: Parts of class and id names and of roles that mark an element as no content.
MARKS = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notification alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs header masthead footer "
    "sidebar widget related recommended share sharing social comment comments reply replies discussion disqus form "
    "search login signup subscribe newsletter contentinfo complementary toolbar pagination pager".split())

#: Elements whose class and id say nothing against them.
WHOLE = ("html", "body", "article", "main")
#: Parts of names that mark the head of an article as well as that of a page.
HEADS = frozenset("header title banner".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b(?:[^>]*/>|[^>]*>.*?(?:</\1\s*>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S | re.I)
_MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


@dataclass
class Element:
    parent: int  # -1: none
    name: str
    marks: tuple  # words in class, id and role
    content: bool  # inside an element that the page itself marks as its article
    listed: bool  # in an element that the lists hold for no content
    article: bool  # inside an article or main element
    block: int  # index in the stack of the nearest element that is a block, itself included; -1: none
    words: int = 0


@dataclass
class Token:
    element: int  # the innermost element, -1: none
    words: int  # 0 for a tag
    text: str  # decoded text of a run of words
    tag: str  # class of a tag
    breaks: bool  # a tag that ends a block


def _marks(attributes: str) -> tuple:
    found = {part for m in _MARKED.finditer(attributes) for part in _NAME.findall((m[1] or m[2] or m[3] or "").lower())}
    return tuple(sorted(found | ({"hidden"} if _HIDDEN.search(attributes) else set())))


def _listed(name: str, marks: tuple, article: bool) -> bool:
    """Whether the fixed lists hold an element for no content. The head of an article is one of its parts."""
    if name in ASIDE or name == "header" and not article:
        return True
    return name not in WHOLE and any(
        m == "hidden" or m in MARKS and not (article and m in HEADS) for m in marks)


def parse(page: str) -> tuple[list[Token], list[Element]]:
    """Tags and runs of words of a whole page and its elements, in time proportional to the page. Broken markup never
    fails: a stray < is text, an end tag without a beginning is skipped, a new block ends an open paragraph."""
    out: list[Token] = []
    elements: list[Element] = []
    stack: list[int] = []
    places: dict[str, list[int]] = {}  # name -> its places in the stack

    def cut(k: int) -> None:
        while len(stack) > k:
            places[elements[stack.pop()].name].pop()

    def text(raw: str) -> None:
        if raw:
            plain = html.unescape(raw)
            n = len(plain.split())
            out.append(Token(stack[-1] if stack else -1, n, plain, "", False))
            if stack:
                elements[stack[-1]].words += n

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at:m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        closing, attributes = (m[2] or m[5]) == "/", m[4] or m[7] or ""
        here = stack[-1] if stack else -1
        if closing:
            if places.get(name):
                here = stack[places[name][-1]]
                cut(places[name][-1])
        else:
            if name in BLOCK and name != "br" and stack:
                k = elements[stack[-1]].block
                if k >= 0 and elements[stack[k]].name == "p":
                    cut(k)
            above = elements[stack[-1]] if stack else Element(-1, "", (), False, False, False, -1)
            marks = _marks(attributes)
            elements.append(Element(
                stack[-1] if stack else -1, name, marks, above.content or name == "article",
                above.listed or _listed(name, marks, above.article), above.article or name in ("article", "main"),
                len(stack) if name in BLOCK else above.block))
            here = len(elements) - 1
            if name not in VOID and not attributes.endswith("/"):
                places.setdefault(name, []).append(len(stack))
                stack.append(here)
        out.append(Token(here, 0, "", f"{'/' if closing else ''}{name}", name in BLOCK))
    text(page[at:])
    for e in reversed(elements):
        if e.parent >= 0:
            elements[e.parent].words += e.words
    return out, elements


def _weight(e: Element, learned: dict[str, float], lists: bool) -> float:
    """The weight that says most among those of an element's name and marks: what was learned, else the lists'."""
    best = 0.0
    for key in (e.name, *("." + m for m in e.marks)):
        w = learned.get(key)
        if w is None and lists:
            if key in ("article", "main"):
                w = LISTED
            elif key[0] != "." or e.name not in WHOLE:
                mark = key[1:] in MARKS and key[0] == "." and not (e.article and key[1:] in HEADS)
                if mark or key in ASIDE or key == "header" and not e.article or key == ".hidden":
                    w = -LISTED
        if w is not None and abs(w) > abs(best):
            best = max(-CUT, min(CUT, w))
    if e.article and best < 0 and any(m in HEADS for m in e.marks + (e.name,)):
        return 0.0  # the head of an article is one of its parts
    return best


def evidence(elements: list[Element], total: int, learned: dict[str, float], lists: bool = True) -> list[float]:
    """For each element what its place says of its words."""
    weights = [_weight(e, learned, lists) for e in elements]
    holds = [False] * len(elements)  # whether there is content by its name in an element
    known = any(w >= TELLING for w in weights)
    for i in range(len(elements) - 1, -1, -1):
        # on a page where no name tells of content, paragraphs do
        if elements[i].parent >= 0 and (holds[i] or weights[i] >= TELLING or not known and elements[i].name == "p"):
            holds[elements[i].parent] = True
    out: list[float] = []
    for i, (e, own) in enumerate(zip(elements, weights)):
        around = out[e.parent] if e.parent >= 0 else 0.0
        if own < 0 and holds[i] and e.words > FRAME * total:
            own = 0.0
        out.append(own + OUTER * around if abs(own) >= TELLING else around + FAINT * own)
    return out


def _within(x: float, bounds: tuple[float, float]) -> float:
    return min(bounds[1], max(bounds[0], x))


def scores(found: list[Token], elements: list[Element], learned: dict[str, float], lists: bool = True) -> list[float]:
    """The score of each token."""
    total = sum(t.words for t in found)
    says = evidence(elements, total, learned, lists)
    out = []
    for t in found:
        e = says[t.element] if t.element >= 0 else 0.0
        if t.tag:
            out.append(-_within(-learned.get("tag " + t.tag, 0.0), TAG_LOSS))
        else:
            # a place of which nothing is known counts in full
            out.append(t.words * (_within(e or GAIN[1], GAIN) if e >= 0 else -_within(-e / (2 * LISTED), LOSS)))
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """Range of the contiguous run with the largest sum above 0, the first of equals; (0, 0) if there is none."""
    best, lo, hi, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, lo, hi = total, start, i + 1
    return lo, hi


def main_text(page: str | None, learned: dict[str, float], lists: bool = True) -> str:
    """Text of the best run: blocks in page order joined by one space, white space within a block made one space."""
    found, elements = parse(page or "")
    gains = scores(found, elements, learned, lists)
    lo, hi = best_run(gains)
    # blanks between words have no score of their own and stay with the words around them
    kept = [i for i in range(lo, hi) if found[i].breaks or not found[i].tag and (gains[i] > 0 or not found[i].words)]
    parts = [" " if found[i].breaks else found[i].text for i in kept]
    return " ".join("".join(parts).split())


def learn(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> dict[str, float]:
    """Log-likelihood ratios of names, marks and tags from pages that mark their content themselves by an article
    element. Words of boxes inside it that the lists hold for no content have no label. Only a count for each name comes
    to the driver, of those with ``LEAST_WORDS`` words at least; without such pages it is empty and the lists hold."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                found, elements = parse(page)
                label: list[bool | None] = [False] + [None if e.content and e.listed else e.content for e in elements]
                own: Counter = Counter()
                for t in found:
                    if t.tag:
                        if label[t.element + 1] is not None and t.tag.lstrip("/") != "article":
                            counts["tag " + t.tag, label[t.element + 1]] += 1
                    elif t.words and label[t.element + 1] is not None:
                        own[t.element, label[t.element + 1]] += t.words
                        counts["", label[t.element + 1]] += t.words
                # words under each element, from the innermost outwards
                for i in range(len(elements) - 1, -1, -1):
                    e = elements[i]
                    for c in (True, False):
                        n = own.pop((i, c), 0)
                        if n:
                            for key in (e.name, *("." + m for m in e.marks)):
                                counts[key, c] += n
                            own[e.parent, c] += n
        rows = sorted(counts.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for (k, _), _ in rows], pa.string()), pa.array([c for (_, c), _ in rows], pa.bool_()),
             pa.array([n for _, n in rows], pa.int64())], names=["kind", "content", "n"])

    marked = pages.filter(F.col(html_col).rlike("(?i)<article[\\s>]")).select(
        F.xxhash64(url_col, html_col).alias("h"), F.col(html_col).alias("html"))
    # the sample is drawn from hashes first, so that whole pages are not sorted
    last = marked.select("h").orderBy("h").limit(LABELLED_PAGES).agg(F.max("h")).first()[0]
    if last is None:
        return {}
    counted = marked.filter(F.col("h") <= last).select("html").mapInArrow(run, "kind string, content boolean, n long")
    sums = counted.groupBy("kind").agg(F.sum(F.when(F.col("content"), F.col("n")).otherwise(0)).alias("inside"),
                                       F.sum(F.when(F.col("content"), 0).otherwise(F.col("n"))).alias("outside"))
    counts = {r.kind: (r.inside, r.outside) for r in sums.filter(F.col("inside") + F.col("outside") >= LEAST_WORDS).collect()}
    words = counts.pop("", (0, 0))
    tags = [sum(n[j] for k, n in counts.items() if k.startswith("tag ")) for j in (0, 1)]

    def ratio(n, all_of):
        return math.log((n[0] + 0.5) / (all_of[0] + 1)) - math.log((n[1] + 0.5) / (all_of[1] + 1))

    return {k: ratio(n, tags if k.startswith("tag ") else words) for k, n in counts.items()}


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, url, text, n_chars) for each row of ``pages``. A null or empty page, and one without words of content,
    has an empty text. Rows that repeat have equal texts. Nothing is dropped but what is no content; other columns
    are not read."""
    learned = learn(pages, url_col, html_col)

    def run(batches):
        for batch in slices(batches, "html"):
            texts = [main_text(p, learned) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page {kinds[0]}, url {kinds[1]}, text string, n_chars long")
