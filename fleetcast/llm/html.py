"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Each has a score: the log ratio of how often its kind stands inside and
outside of the article of labelled pages, where words are good and tags bad before anything is learned; tags stay bad whatever is learned,
and the border of what a page's author marked as an article is worse than any tag. One linear scan finds the contiguous stretch with the largest
sum. Elements that are no part of an article by their kind, or by a class, id or role of their own, are one bad tag to the scan and
are left out of the stretch's text, unless they hold the page's only article or, without one, most of its words. A class that only contains
such a word, as in ``site-footer``, makes the words inside bad; so does standing outside of the page's only article.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructType

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NONE_SHOWN = re.compile(r"display\s*:\s*none", re.I)
NAME_PARTS = re.compile(r"[a-z0-9]+")
RAW = frozenset("script style noscript template textarea title iframe svg math xmp noembed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
# Element names and words of class, id or role by which pages mark what is no part of the article.
APART = frozenset("head nav footer aside form button select dialog menu object embed canvas audio video fieldset datalist".split())
APART_WORDS = frozenset((
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu menubar nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing "
    "social related recommended recommendations comment comments commentlist disqus respond replies pagination pager toolbar widget complementary contentinfo skip").split())
MAIN = frozenset(("article", "main"))
SEEDS = {"word": 1.0, "low": -0.2, "tag": -0.3, "apart": -2.0}
HEADING, BORDER, SLIGHT = 5.0, -200.0, -0.1


def attributes(text: str) -> dict[str, str]:
    """Attributes of a tag by lower case name, the first of each."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), next((x for x in m.groups()[1:] if x is not None), ""))
    return out


def standing(name: str, attrs: str, in_main: bool) -> str:
    """``apart`` for an element that is no part of an article, ``low`` for one that may be none, else nothing."""
    if name in APART or name == "header" and not in_main:
        return "apart"
    if not attrs or name in MAIN or name in ("html", "body"):
        return ""
    found = attributes(attrs)
    if "hidden" in found and found["hidden"].lower() != "false" or found.get("aria-hidden", "").strip().lower() == "true" or NONE_SHOWN.search(found.get("style", "")):
        return "apart"
    tokens = " ".join(found.get(x, "") for x in ("class", "id", "role")).lower().split()
    if not APART_WORDS.isdisjoint(tokens):
        return "apart"
    return "low" if any(not APART_WORDS.isdisjoint(NAME_PARTS.findall(t)) and not t.startswith(("no-", "has-", "with-", "without-")) for t in tokens) else ""


class Page:
    """Tokens of a page: ``(kind, feature, value)`` with kind ``word`` or ``low`` (a text run), ``tag`` or ``apart`` (a whole element)."""

    def __init__(self, html: str):
        self.tokens: list[tuple[str, str, object]] = []
        self.main: tuple[int, int] | None = None  # tokens of the only article or main element, if there is one
        tags, texts = self._split(html)
        close = self._matched(tags)
        block_after = self._next_block(tags)
        words = [0]
        for t in texts:
            words.append(words[-1] + len(t.split()))
        named = {n: [(i, close[i]) for i, (closing, name, _) in enumerate(tags) if name == n and not closing and i in close] for n in ("article", "main")}
        only = next((x[0] for x in named.values() if len(x) == 1), None)
        marked = only is not None and words[only[1]] > words[only[0]]
        block, links, in_main, low_until, i = "body", 0, 0, -1, 0
        while i < len(tags):
            closing, name, attrs = tags[i]
            kind = "" if closing or not name else "apart" if name in RAW else standing(name, attrs, in_main > 0)
            if kind:
                end = close.get(i)
                if end is None:  # never closed: it lasts to the next block
                    end = i if name in VOID else block_after[i]
                holds = i < only[0] and only[1] <= end if only else 2 * (words[end] - words[i]) > words[-1]
                if kind == "apart" and name not in RAW and holds:
                    kind = ""
                if kind == "low" and not holds:
                    low_until = max(low_until, end)
            if kind == "apart":
                self.tokens.append(("apart", "apart", None))
                i = end
            elif name:
                at = len(self.tokens)
                self.tokens.append(("tag", ("/" if closing else "") + name, name))
                if name in MAIN:
                    in_main += -1 if closing else 1
                if only and i == only[0]:
                    self.main = (at + 1, at + 1)
                elif only and i == only[1] and self.main:
                    self.main = (self.main[0], at)
                if name == "a":
                    links = 0 if closing else 1
                elif name not in INLINE:
                    block, links = ("body" if closing else name), 0
            if texts[i]:
                low = not only[0] <= i < only[1] if marked else i < low_until
                self.tokens.append(("low" if low else "word", ("a:" if links else "") + block, texts[i]))
            i += 1
        if self.main and self.main[1] <= self.main[0]:
            self.main = None

    @staticmethod
    def _next_block(tags: list[tuple[str, str, str]]) -> list[int]:
        """For each tag the last one before the next tag that is no inline element."""
        out, following = [0] * len(tags), len(tags)
        for i in range(len(tags) - 1, -1, -1):
            out[i] = following - 1
            if tags[i][1] and tags[i][1] not in INLINE:
                following = i
        return out

    @staticmethod
    def _split(html: str) -> tuple[list[tuple[str, str, str]], list[str]]:
        """Tags (a first one without name) and the text after each. Raw elements have no text of their own."""
        tags, texts, last, wait = [("", "", "")], [], 0, ""
        pos = 0
        while True:
            m = TOKEN.search(html, pos)
            if wait:
                end = re.compile(rf"</{wait}\s*>", re.I).search(html, last)
                m = TOKEN.match(html, end.start()) if end else None
                texts.append("")
                wait = ""
                if not m:
                    return tags, texts
            else:
                texts.append(html[last:m.start()] if m else html[last:])
            if not m:
                return tags, texts
            name = (m[2] or "").lower()
            tags.append((m[1] or "", name, m[3] or ""))
            last = pos = m.end()
            if name in RAW and not m[1] and not (m[3] or "").endswith("/"):
                wait = name

    @staticmethod
    def _matched(tags: list[tuple[str, str, str]]) -> dict[int, int]:
        """Index of the closing tag by that of the opening tag."""
        open_at: dict[str, list[int]] = {}
        close: dict[int, int] = {}
        for i, (closing, name, _) in enumerate(tags):
            if closing and open_at.get(name):
                close[open_at[name].pop()] = i
            elif name and not closing and name not in VOID:
                open_at.setdefault(name, []).append(i)
        return close

    def scores(self, weights: dict[str, float]) -> list[float]:
        out = []
        for kind, feature, value in self.tokens:
            if kind == "tag":
                each = BORDER if value in MAIN else weights.get(f"tag {feature}", prior(kind, feature))
            else:
                each = weights.get(f"word {feature}", prior("word", feature)) if kind in ("word", "low") else SEEDS[kind]
                each = min(each, SEEDS["low"]) if kind == "low" else each
            out.append(each * len(value.split()) if kind in ("word", "low") else each)
        return out

    def text(self, weights: dict[str, float]) -> str:
        """Blocks of the best stretch, each on one line, apart by an empty line."""
        a, b = best_stretch(self.scores(weights))
        blocks, current = [], []
        for kind, feature, value in self.tokens[a:b]:
            if kind in ("word", "low"):
                current.append(value)
            elif kind == "apart" or value not in INLINE:
                blocks.append("".join(current))
                current = []
            elif value == "br":
                current.append(" ")
        blocks.append("".join(current))
        return "\n\n".join(x for x in (" ".join(unescape(x).split()) for x in blocks) if x)


def prior(kind: str, feature: str) -> float:
    """Score before anything is learned. A heading is few words between tags; a tag within a line says little."""
    if kind == "word":
        return HEADING if feature in ("h1", "h2", "h3") else SEEDS[kind]
    return SLIGHT if feature.lstrip("/") in INLINE else SEEDS[kind]


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous stretch with the largest sum, in one scan; empty if no sum is above 0. The first of ties."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, bounds = total, (start, i + 1)
    return bounds


def learn(pages: DataFrame, html_col: str = "html", key: str = "page_id", sample: int = 2000, strength: float = 20.0, most: int = 500) -> dict[str, float]:
    """Weights from labelled pages: those whose markup names one article (or main) element, which labels the tokens inside.

    At most about ``sample`` pages, chosen by a hash of ``key``, are learned from, and weights of the ``most`` kinds seen most often are kept. A kind of token
    seen ``strength`` times counts half of its evidence; unseen kinds keep the given scores (word 1, in a heading 5, tag -0.3, tag within a
    line -0.1). Tags never score above that of a tag within a line. Without labelled pages, and for an empty table, all keep them. NULL and empty pages teach
    nothing, repeated pages count again, and so do pages of any length; pages whose key is NULL are not learned from. Kinds seen equally often are taken by name.
    """
    labelled = pages.filter(F.col(html_col).rlike("(?i)<(article|main)[\\s>]")).select(F.col(key).alias("key"), F.col(html_col).alias("html"))
    n = labelled.count()
    if not n:
        return {}
    chosen = labelled.filter(F.shiftrightunsigned(F.xxhash64("key"), 11) / F.lit(float(2**53)) < sample / n).select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for html in batch.column(0):
                page = Page(html.as_py())
                if page.main:
                    a, b = page.main
                    for i, (kind, feature, value) in enumerate(page.tokens):
                        if kind != "apart" and value not in MAIN and re.fullmatch(r"(a:)?/?[a-z0-9]{1,10}", feature):
                            seen[f"{'tag' if kind == 'tag' else 'word'} {feature}", a <= i < b] += 1 if kind == "tag" else min(len(value.split()), 20)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen], pa.bool_()), pa.array(list(seen.values()), pa.int64())], ["feature", "inside", "n"])

    rows = chosen.mapInArrow(count, "feature string, inside boolean, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("o")
    ).orderBy(F.desc(F.col("i") + F.col("o")), "feature").limit(most).collect()
    inside, outside = sum(r.i for r in rows) + 1, sum(r.o for r in rows) + 1
    out = {}
    for r in rows:
        given = prior(*r.feature.split(" "))
        ratio = math.log((r.i / inside + 1e-4) / (r.o / outside + 1e-4))
        trust = (r.i + r.o) / (r.i + r.o + strength)
        out[r.feature] = max(-4.0, min(SLIGHT if r.feature.startswith("tag ") else 4.0, trust * ratio + (1 - trust) * given))
    return out


def extract(pages: DataFrame, weights: dict[str, float], keep: list[str], html_col: str = "html") -> DataFrame:
    """``keep`` and ``text, n_chars`` of every page, from its whole html, however long.

    NULL or a page without content gives an empty text; the first of equally good stretches is taken; repeated pages get equal texts. The
    result's columns replace kept ones of the same name; an empty table gives an empty result.
    """
    keep = [c for c in keep if c not in ("text", "n_chars")]
    rows = pages.select(*keep, F.col(html_col).alias("__html"))
    schema = StructType([*rows.schema.fields[:len(keep)]]).add("text", StringType()).add("n_chars", LongType())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [Page(x.as_py() or "").text(weights) for x in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(len(keep))], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema.names)

    return rows.mapInArrow(read, schema)
