"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive (less inside links), tags negative; the best contiguous run,
found in one scan, is the content. The weights are log odds of standing inside against outside the content region of
labelled pages: pages that mark their region with an ``article`` or ``main`` element. Elements that are never content
(menus, footers, sidebars, forms, scripts, adverts, notices, reader comments; by name, role, class or id) are passed over
first and their words take no part. A region does not cross the edge of an outermost ``article`` or ``main`` element; edges
within it score nothing. Of a page with such elements, each one whose words are mostly not links gives its best run, and the runs
are joined in page order; without such an element the best run of the page is taken.

Defined results: a null or empty page, or one without words, gives an empty text. Of regions with equal scores the first
is taken, of those with one start the longest. An element that is never closed ends with the page. Rows are read one by
one, so repeated rows and null ids stay as they are. Weights are fitted on at most ``FIT_PAGES`` pages; without a labelled
page the built-in weights hold. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.words import slices

#: At most so many pages are read to fit the weights, those with the smallest hashes of their ids.
FIT_PAGES = 2000

# Element names of HTML.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
SKIPPED = RAW | {
    "head", "nav", "footer", "aside", "form", "noscript", "template", "svg", "math", "object", "button", "select", "menu",
    "dialog", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
    "u", "var", "wbr", "img", "br"}
REGION = {"article", "main"}
#: Words in a class, id or role that mark an element as none of the content.
NOT_CONTENT = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion",
    "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "nav", "navbar",
    "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "sidebar", "aside", "complementary", "widget",
    "footer", "contentinfo", "masthead", "comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "share",
    "sharing", "social", "related", "recommended", "recommendations", "newsletter", "subscribe", "subscription", "signup",
    "login", "search", "form", "toc"}
#: These count only outside an article or main element, where they belong to the page.
PAGE_ONLY = {"header"}

START = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)")
#: What follows a tag's name, to its end; possessive, so that a try without success is one scan.
ATTRIBUTES = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
MARK = re.compile(r"[>\"']")
NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|\Z)|aria-hidden\s*=\s*[\"']?true)", re.I)
PART = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")

DEFAULT = {"word": 1.0, "linked": 0.1, "tag": -0.1}
BARRIER = "region"


def not_content(name: str, attrs: str, inside: bool) -> bool:
    if name in SKIPPED or (name in PAGE_ONLY and not inside):
        return True
    if not attrs or name in REGION | {"html", "body"}:
        return False
    if HIDDEN.search(attrs):
        return True
    for m in NAMED.finditer(attrs):
        parts = PART.findall((m[1] or m[2] or m[3] or "").lower())
        if not NOT_CONTENT.isdisjoint(parts) or (not inside and not PAGE_ONLY.isdisjoint(parts)):
            return True
    return False


class Closing:
    """Where a tag that starts has an end, a > outside quotes: found for all places at once, as a broken page may start tags
    without end at every place, and a search from each would be quadratic. Made when a first tag turns out to have no end."""

    def __init__(self, page: str):
        self.at = [m.start() for m in MARK.finditer(page)]
        self.ends = [False] * (len(self.at) + 1)
        last: dict[str, int] = {}
        for k in range(len(self.at) - 1, -1, -1):
            mark = page[self.at[k]]
            self.ends[k] = mark == ">" or (mark in last and self.ends[last[mark] + 1])
            last[mark] = k

    def __call__(self, place: int) -> bool:
        return self.ends[bisect_left(self.at, place)]


def markup(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, stop, name, closing, attributes) of each piece of markup, in one forward scan, which a place sent in moves on. The name is None for comments and declarations,
    and "" for character data, whose text comes in the place of the attributes. A tag without an end is text."""
    size, at, closing = len(page), 0, None
    while m := START.search(page, at):
        start, at = m.start(), m.end()
        if m["name"] is not None:
            tag = None
            if closing is None or closing(at):
                tag = ATTRIBUTES.match(page, at)
                closing = closing or (None if tag else Closing(page))
            if not tag:
                continue
            at = tag.end()
            moved = yield start, at, m["name"].lower(), bool(m["close"]), tag[1]
        else:
            data = m[0] == "<![CDATA["
            what = "-->" if m[0] == "<!--" else "]]>" if data else ">"
            found = page.find(what, at)
            stop = size if found < 0 else found + len(what)
            moved = yield start, stop, "" if data else None, False, page[at:size if found < 0 else found] if data else ""
            at = stop
        at = at if moved is None else moved


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """(feature, text, inside a region) of each run of text and each tag outside the elements passed over.

    feature: word or linked for text, the name for a tag, region for the edge of an outermost article or main element, gap for an
    edge within one, an edge without an opposite, or an element passed over inside one."""
    at = links = regions = 0
    skip, depth = "", 0  # the element passed over and how many of its name are open
    size, last = len(page), page.rfind(">") + 1
    scan, moved = markup(page), None
    while at < size:
        try:
            start, stop, name, closing, attrs = scan.send(moved)
        except StopIteration:
            start = stop = size
            name = None
        moved = None
        if start > at and not skip:
            yield ("linked" if links else "word"), page[at:start], regions > 0
        at = stop
        if name == "":
            if not skip:
                yield ("linked" if links else "word"), attrs, regions > 0
            continue
        if name is None:
            continue
        if not closing and name in RAW:  # its content is not markup
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at, max(at, last))
            at = moved = end.end() if end else size
            continue
        alone = name in VOID or attrs.endswith("/") and name in SKIPPED
        if skip:
            if name == skip and not alone:
                depth += -1 if closing else 1
                if not depth:
                    skip = ""
            continue
        if not closing and not_content(name, attrs, regions > 0):
            if not alone:
                skip, depth = name, 1
            if name not in INLINE:
                yield ("gap" if regions else name), "", regions > 0
            continue
        if name == "a":
            links = 0 if closing else 1
        if name in REGION:
            outer = regions == (1 if closing else 0)
            regions = max(0, regions + (-1 if closing else 1))
            yield BARRIER if outer else "gap", "", regions > 0
        else:
            yield name, "", regions > 0


def n_words(text: str) -> int:
    return len(text.split())


def tally(page: str) -> Counter:
    """Counts of (feature, inside) in a labelled page; empty for a page without a region."""
    found = Counter()
    labelled = False
    for feature, text, inside in tokens(page):
        labelled |= inside
        if feature not in (BARRIER, "gap"):
            found[feature, inside] += n_words(text) if feature in ("word", "linked") else 1
    return found if labelled else Counter()


def fit(pages: DataFrame, most: int = FIT_PAGES) -> dict[str, float]:
    """Weights from at most ``most`` pages: log odds, kept in 0.05 to 3 for words and in -1 to -0.01 for tags."""
    key = F.xxhash64("page_id")
    chosen = pages.select("page_id").distinct().orderBy(key, "page_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                total.update(tally(page or ""))
        yield pa.RecordBatch.from_arrays([
            pa.array([f for f, _ in total], pa.string()), pa.array([i for _, i in total], pa.bool_()),
            pa.array(list(total.values()), pa.int64())], ["feature", "inside", "n"])

    counts = pages.select("page_id", "html").join(chosen, "page_id", "left_semi").select("html")
    counts = counts.mapInArrow(run, "feature string, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n"))
    # A feature is a tag's name: as many rows as the chosen pages have names, the longest 99.
    rows = counts.where(F.length("feature") < 100).orderBy(F.desc("n"), "feature", "inside").limit(10_000).collect()
    inner = {r.feature: r.n for r in rows if r.inside}
    outer = {r.feature: r.n for r in rows if not r.inside}
    weights = dict(DEFAULT)
    inner_words = sum(inner.get(f, 0) for f in ("word", "linked"))
    if not inner_words:
        return weights
    for f in inner.keys() | outer.keys():
        odds = math.log((inner.get(f, 0) + 1) / (outer.get(f, 0) + 1))
        weights[f] = min(3.0, max(0.05, odds)) if f in ("word", "linked") else max(-1.0, min(-0.01, odds))
    return weights


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and stop of the contiguous run with the highest positive sum; (0, 0) if there is none."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best or total == best and total > 0 and start == span[0]:
            best, span = total, (start, i + 1)
    return span


def main_text(page: str, weights: dict[str, float]) -> str:
    seen = list(tokens(page))
    scores = [
        -math.inf if f == BARRIER else 0.0 if f == "gap" else n_words(t) * weights[f] if f in ("word", "linked") else weights.get(f, weights["tag"])
        for f, t, _ in seen]
    edges = [-1, *(i for i, (f, _, _) in enumerate(seen) if f == BARRIER), len(seen)]
    runs = []
    for low, high in zip(edges, edges[1:]):
        part = seen[low + 1:high]
        words = {f: sum(n_words(t) for g, t, _ in part if g == f) for f in ("word", "linked")} if part and part[0][2] else None
        if words and words["word"] > words["linked"]:
            start, stop = best_run(scores[low + 1:high])
            runs.append((low + 1 + start, low + 1 + stop))
    blocks = []
    for start, stop in runs or [best_run(scores)]:
        now: list[str] = []
        for feature, text, _ in seen[start:stop]:
            if feature in ("word", "linked"):
                now.append(text)
            elif feature == "br":
                now.append(" ")
            elif feature not in INLINE:
                blocks.append("".join(now))
                now = []
        blocks.append("".join(now))
    clean = (SPACE.sub(" ", entities.unescape(b)).strip() for b in blocks)
    return "\n".join(b for b in clean if b)


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(p or "", weights) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op9_max_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(pages))
