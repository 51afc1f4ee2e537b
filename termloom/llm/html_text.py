"""Main text of web pages by a maximum-scoring subsequence (operator 5).

A page is a sequence of words and tags. Words score positive, tags negative, by weights learned
from labelled pages; one linear scan finds the contiguous region of greatest score, which is the
content. A page labels itself where it marks its one article (``<article>`` or ``<main>``).

What stands inside the region but is not the article's (menus, adverts, comments of readers ...) is
told by evidence, not by single words: every element sums what its name and the words of its class,
id, role and itemprop say for and against content, first guesses plus log-odds from the labelled
pages. Elements against are left out, unless they hold most of the page's words: what holds those is
around the article, whatever it is called. Where elements that speak for content hold a good part of
the words, words outside them score negative.

Tags are read as HTML does, in one pass: quoted values may hold any character, a quote that isn't
closed ends with its tag, an end tag without a start is skipped by a look-up.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bound of the training sample.
SAMPLE_PAGES = 400

BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd div section article main header footer aside nav form table thead tbody tfoot tr td th caption blockquote pre figure figcaption address fieldset hr body html head details summary center".split())
INLINE = frozenset("a abbr b big br cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that never show article text.
NEVER = RAW | frozenset("head noscript template svg math object applet canvas audio video map button select option label datalist".split())
#: Blocks that end where one of these begins, besides p, which any block ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
#: First guesses of the evidence of element names and attribute words; labelled pages add theirs.
NAME_GUESS = {"article": 2.0, "main": 2.0, "nav": -3.0, "menu": -3.0, "footer": -2.5, "aside": -2.0, "form": -2.0, "dialog": -2.0, "header": -1.5}
WORD_GUESS = (
    {w: 2.0 for w in "article main content".split()}
    | {w: 1.5 for w in "post entry story".split()}
    | {"body": 0.5, "text": 0.5}
    | {w: -3.0 for w in "comment comments commentlist disqus replies respond".split()}
    | {w: -2.0 for w in "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs consent contentinfo complementary cookie cookies footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommended related reply share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()}
    | {"search": -1.5, "side": -1.0}
)
#: The word after one of these says nothing of the element itself: has-sidebar, no-header.
MODIFIERS = frozenset("has no not non with without show hide is".split())
AGAINST, STRONGLY, FOR = -1.0, -3.0, 1.5
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ATTR = re.compile(r"[^\s\"'<>/=]+")
_HIDE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I) for name in RAW}


def read_tag(page: str, at: int) -> tuple[dict[str, str], int]:
    """(attributes of the tag whose name ends at ``at``, place after the tag).

    A quote counts as closed where white space, a slash, the tag's or the page's end follows. Else,
    if a ``>`` comes before, the tag ends at that. Every run between two quotes is read at most twice.
    """
    attrs: dict[str, str] = {}
    n, name = len(page), ""
    while at < n:
        c = page[at]
        if c == ">":
            return attrs, at + 1
        if c == "=" and name:
            at += 1
            while at < n and page[at].isspace():
                at += 1
            if at < n and page[at] in "\"'":
                end = page.find(page[at], at + 1)
                closed = end >= 0 and (end + 1 >= n or page[end + 1] in "/>" or page[end + 1].isspace())
                if not closed:
                    stop = page.find(">", at, end if end >= 0 else n)
                    if stop >= 0:
                        attrs.setdefault(name, page[at + 1 : stop])
                        return attrs, stop + 1
                    if end < 0:
                        return attrs, n
                attrs.setdefault(name, page[at + 1 : end])
                at = end + 1
            else:
                start = at
                while at < n and page[at] != ">" and not page[at].isspace():
                    at += 1
                attrs.setdefault(name, page[start:at])
            name = ""
        elif m := _ATTR.match(page, at):
            if name:
                attrs.setdefault(name, "")
            name, at = m[0].lower(), m.end()
        else:
            at += 1
    return attrs, n


def lex(page: str) -> Iterator[tuple]:
    """("t", text), ("<", name, attributes, closed at once) and (">", name); no markup else."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "t", page[at:]
            return
        after = page[lt + 1 : lt + 2]
        end = after == "/"
        m = _NAME.match(page, lt + 1 + end)
        if not m and after not in ("!", "?", "/"):
            yield "t", page[at : lt + 1]  # a less-than sign
            at = lt + 1
            continue
        if lt > at:
            yield "t", page[at:lt]
        if not m:
            if page.startswith("<!--", lt):
                at = lt + 4 if page.startswith((">", "->"), lt + 4) else page.find("-->", lt + 4)
                at = n if at < 0 else page.index(">", at) + 1
                continue
            close = page.find("]]>", lt) if page.startswith("<![CDATA[", lt) else -1
            at = close + 3 if close >= 0 else (page.find(">", lt) + 1 or n)
            continue
        name = m[0].lower()
        attrs, at = read_tag(page, m.end())
        if end:
            yield ">", name
            continue
        yield "<", name, attrs, page[at - 2 : at] == "/>"
        if name in RAW:
            stop = _RAW_END[name].search(page, at)
            at = stop.start() if stop else n


def attribute_words(attrs: dict[str, str]) -> list[str]:
    """Words of class, id, role and itemprop, without those after a modifier."""
    out = []
    for key in ("class", "id", "role", "itemprop"):
        for part in attrs.get(key, "").split():
            skip = False
            for w in _WORD.findall(part):
                w = w.lower()
                if not skip:
                    out.append(w)
                skip = w in MODIFIERS
    return out


class Page:
    """Tokens of a page, its elements as token ranges, and the words that each holds.

    tokens: ("t", text, words) and ("<" or ">", name). elements: [name, attribute words, hidden,
    first token (its start tag), one past the last, element around it or -1, words].
    """

    def __init__(self, page: str):
        self.tokens: list[tuple] = []
        self.elements: list[list] = []
        stack: list[int] = []
        places: dict[str, list[int]] = {}  # depths in the stack by name
        blocks: list[int] = []  # depths of blocks
        tokens, elements = self.tokens, self.elements

        def leave(depth: int) -> None:
            while len(stack) > depth:
                e = elements[stack.pop()]
                e[4] = len(tokens)
                places[e[0]].pop()
                if blocks and blocks[-1] == len(stack):
                    blocks.pop()

        for t in lex(page):
            if t[0] == "t":
                tokens.append(("t", t[1], len(t[1].split())))
                if stack:
                    elements[stack[-1]][6] += tokens[-1][2]
                continue
            name = t[1]
            if t[0] == ">":
                at = places.get(name)
                # an inline element isn't ended from within a block that it holds
                ended = stack[at[-1]] if at and (name in BLOCKS or not blocks or blocks[-1] <= at[-1]) else -1
                if ended >= 0:
                    leave(at[-1])
                tokens.append((">", name))
                if ended >= 0:
                    elements[ended][4] = len(tokens)
                continue
            if name in BLOCKS:
                ends = ENDS.get(name, ())
                while blocks and (top := elements[stack[blocks[-1]]][0]) and (top == "p" or top in ends):
                    leave(blocks[-1])
            tokens.append(("<", name))
            attrs = t[2]
            if name in VOID or t[3] and name not in RAW:
                continue
            hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(_HIDE.search(attrs.get("style", "")))
            places.setdefault(name, []).append(len(stack))
            if name in BLOCKS:
                blocks.append(len(stack))
            elements.append([name, attribute_words(attrs), hidden, len(tokens) - 1, 0, stack[-1] if stack else -1, 0])
            stack.append(len(elements) - 1)
        leave(0)
        for e in reversed(elements):
            if e[5] >= 0 and e[0] not in NEVER:
                elements[e[5]][6] += e[6]
        self.words = sum(t[2] for t in tokens if t[0] == "t") - sum(e[6] for e in elements if e[0] in NEVER and not self._in_never(e))

    def _in_never(self, e: list) -> bool:
        return e[5] >= 0 and self.elements[e[5]][0] in NEVER

    def label(self) -> tuple[int, int] | None:
        """The token range of the page's only article (or main) element."""
        for name in ("article", "main"):
            got = [e for e in self.elements if e[0] == name]
            if len(got) == 1:
                return got[0][3], got[0][4]
        return None


def _covered(ranges: Iterable[tuple[int, int]], n: int) -> list[bool]:
    """Which of n tokens some range holds."""
    edge = [0] * (n + 1)
    for a, b in ranges:
        edge[a] += 1
        edge[b] -= 1
    out, depth = [], 0
    for x in edge[:n]:
        depth += x
        out.append(depth > 0)
    return out


def _odds(a: float, b: float, most: float) -> float:
    return max(-most, min(most, math.log((a + 0.5) / (b + 0.5))))


class Weights:
    """tag: score by name. plain, inside, outside: score of a word on a page without elements that
    speak for content, inside them, and outside them. name, word: evidence."""

    def __init__(self, pages: Iterable[str] = ()):
        self.name, self.word, self.tag = dict(NAME_GUESS), dict(WORD_GUESS), {}
        self.plain, self.inside, self.outside, self.seen = 1.0, 1.0, -0.5, 0
        labelled = [(p, span) for p in map(Page, pages) if (span := p.label())]
        self.seen = len(labelled)
        if not labelled:
            return
        tags, names, words = ({True: Counter(), False: Counter()} for _ in range(3))
        for p, (a, b) in labelled:
            for i, t in enumerate(p.tokens):
                if t[0] != "t":
                    tags[a <= i < b][t[1]] += 1
            for e in p.elements:
                inside = a <= e[3] and e[4] <= b or e[3] <= a and b <= e[4]  # or around it
                names[inside][e[0]] += 1
                words[inside].update(set(e[1]))
        for table, seen, most in ((self.name, names, 1.5), (self.word, words, 2.0)):
            for k in set(seen[True]) | set(seen[False]):
                if (table is self.word or k in NAME_GUESS) and seen[True][k] + seen[False][k] >= 5:
                    table[k] = max(-4.0, min(2.0, table.get(k, 0.0) + _odds(seen[True][k], seen[False][k], most)))
        for k in set(tags[True]) | set(tags[False]):
            self.tag[k] = -0.05 - max(0.0, -_odds(tags[True][k], tags[False][k], 2.0))
        count = {(x, y): 0 for x in (True, False) for y in (True, False)}
        for p, (a, b) in labelled:
            gone, good = self.parts(p)
            for i, t in enumerate(p.tokens):
                if t[0] == "t" and not gone[i] and good is not None:
                    count[good[i], a <= i < b] += t[2]
        if sum(count.values()):
            self.inside = max(0.5, _odds(count[True, True], count[True, False], 1.5))
            self.outside = min(-0.25, _odds(count[False, True], count[False, False], 0.75))

    def evidence(self, e: list, below_content: bool) -> float:
        if e[0] in ("html", "body"):
            return 0.0
        # a page header is a menu bar, the header of an article is not
        own = 0.0 if e[0] == "header" and below_content else self.name.get(e[0], 0.0)
        return own + sum(self.word.get(w, 0.0) for w in dict.fromkeys(e[1]))

    def parts(self, p: Page) -> tuple[list[bool], list[bool] | None]:
        """(tokens that are left out, tokens inside elements for content or None where those hold
        less than two fifths of the words)."""
        n, gone, good = len(p.tokens), [], []
        value, content = [], []  # by element; whether it or one around it is article or main
        for e in p.elements:
            above = e[5] >= 0 and content[e[5]]
            value.append(self.evidence(e, above))
            content.append(above or e[0] in ("article", "main"))
        holds = [False] * len(value)  # an element that speaks for content
        for i in range(len(value) - 1, -1, -1):
            at = p.elements[i][5]
            if at >= 0 and (holds[i] or value[i] >= FOR):
                holds[at] = True
        for e, v, h in zip(p.elements, value, holds, strict=True):
            most = 2 * e[6] > p.words
            if e[0] in NEVER or (e[2] or v <= AGAINST) and not (most and (v > STRONGLY or h)):
                gone.append((e[3], e[4]))
            elif v >= FOR:
                good.append((e[3], e[4]))
        out, inside = _covered(gone, n), _covered(good, n)
        kept = [(t[2], x) for t, x, o in zip(p.tokens, inside, out, strict=True) if t[0] == "t" and not o]
        some = 5 * sum(k for k, x in kept if x) >= 2 * sum(k for k, _ in kept) > 0
        return out, inside if some else None

    def scores(self, p: Page, gone: list[bool], good: list[bool] | None) -> list[float]:
        out = []
        for i, t in enumerate(p.tokens):
            if gone[i]:  # left out anyway: it may lie in the region's way
                out.append(-0.05)
            elif t[0] == "t":
                out.append(t[2] * (self.plain if good is None else self.inside if good[i] else self.outside))
            else:
                out.append(self.tag.get(t[1], -0.1 if t[1] in BLOCKS or t[1] in INLINE else -0.5))
        return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """(first, one past the last) of the greatest sum; of equal sums the earliest; (0, 0) if none is positive."""
    best, region, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, region = run, (start, i + 1)
    return region


_BLANK = re.compile(r"\s+")


def extract(page: str | None, weights: Weights) -> str:
    """The content region's blocks joined by line ends; empty if there is none."""
    if not page:
        return ""
    p = Page(page)
    gone, good = weights.parts(p)
    a, b = best_region(weights.scores(p, gone, good))
    blocks, now = [], []
    for i in range(a, b):
        t = p.tokens[i]
        if t[0] == "t":
            if not gone[i]:
                now.append(t[1])
        elif t[1] in BLOCKS:
            blocks.append(now)
            now = []
        elif t[1] == "br":
            now.append(" ")
    blocks.append(now)
    texts = (_BLANK.sub(" ", html.unescape("".join(x))).strip() for x in blocks if x)
    return "\n".join(x for x in texts if x)


def learn(pages: DataFrame, most: int = SAMPLE_PAGES) -> Weights:
    """Weights from the at most ``most`` whole pages of (page_id, html) of least page_id hash."""
    sample = pages.where("html is not null").select("html", F.xxhash64("page_id").alias("h")).orderBy("h", "html").limit(most)
    return Weights(r["html"] for r in sample.toLocalIterator())


def main_text(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars of every row of (page_id, url, html).

    Null, empty or wordless html: empty text. Character references are decoded, white space inside a
    block is one space, blocks are in page order. Of regions with equal scores the earliest counts.
    Nothing else is dropped or cut; a page of any length is read whole, in time and memory in
    proportion to it. Repeated rows and page_ids each give a row, null page_ids and urls stay null;
    other columns, whatever their names, are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            got = [extract(x.as_py(), weights) for x in t.column(2)]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return main_text(pages, learn(pages))
