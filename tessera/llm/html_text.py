"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of its block elements (inline ones only lend their text to a block). The trees
score each node by its tag and its ancestors', tokens of its attributes, depth, the density of text
and links in its subtree, and its siblings. Decoding is over the whole tree: a node is main text only
within main text, and the labelling with the largest likelihood under that rule is taken, so no
ancestor and descendant contradict each other. The text of main nodes is the result.

The trees learn from pages made here (page_templates.py) with known parts, a bounded, seeded sample.

Null and empty pages, and pages without main text, give the empty text; an empty table gives none; repeated rows are
pages of their own. Reading takes time in proportion to the page, however long or broken: a quote counts only as
an attribute's value, one that nothing ends counts as a letter, and a tag or comment that nothing ends takes the rest
of the page with it, as browsers have it. Pictures (svg) and what a page never shows aren't text; fallbacks of
embedded things and formulas are. A column called text or n_chars is replaced.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .boosting import BoostedTrees
from .common import fresh, others, plus, text_or_empty

#: A comment, a declaration, or a tag with its slash, name, attributes and end. Nothing is looked at twice.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(>|\Z)", re.S)
_CLASSES = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_STOPS = re.compile(r"[.!?]")

INLINE = frozenset("a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label map mark noscript object picture q rp rt ruby s samp small span strike strong sub sup time tt u var video wbr".split())
#: Formulas: part of the text around them.
INLINE |= frozenset("math mfrac mi mn mo mover mrow mspace msqrt mroot msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
RAW = frozenset("script style template textarea title iframe svg select button datalist".split())
#: A start tag of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag ends an open element of these kinds, up to one of the others.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
#: Elements deeper than this follow each other instead, as in browsers; their text stays.
DEPTH = 512
#: Kinds of tags; each is a feature.
KINDS = ["article main", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "nav", "aside", "header", "footer", "form fieldset", "table tbody tr td th", "blockquote pre", "figure figcaption", "body html", "#text"]
KIND = {tag: i for i, tags in enumerate(KINDS) for tag in tags.split()}
#: Attribute tokens by meaning; each list is a feature.
TOKENS = {
    "advert": "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted dfp taboola outbrain commercial",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pagination pager toc tabs topbar toolbar links skip",
    "side": "sidebar side aside rail widget widgets related recommended recommendations more trending popular archive archives categories tags tagcloud teaser",
    "foot": "footer foot bottom copyright colophon legal imprint",
    "head": "header masthead head branding logo site hero",
    "comment": "comment comments commentlist reply replies respond discussion disqus feedback review reviews reader readers",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay paywall subscribe subscription newsletter signup login privacy warning message announcement",
    "share": "share sharing social facebook twitter follow meta byline author date dateline print tools",
    "form": "form search searchbox input field contact poll survey",
    "content": "content article post entry story body text main page maincontent articlebody postcontent hentry blog news single prose",
}
_TOKEN_KIND = {w: i for i, words in enumerate(TOKENS.values()) for w in words.split()}
_seen: dict[str, int] = {}


def attribute_kinds(attributes: str) -> int:
    """Bits of the token kinds in class, id, role and such."""
    got = _seen.get(attributes)
    if got is None:
        got = 0
        for value in _CLASSES.findall(attributes):
            for word in _WORDS.findall(_CAMEL.sub(" ", value).lower()):
                if word in _TOKEN_KIND:
                    got |= 1 << _TOKEN_KIND[word]
        if len(_seen) > 50_000:
            _seen.clear()
        _seen[attributes] = got
    return got


class Page:
    """Nodes in page order: parent, tag and attribute bits of each; runs: (node, text, link characters, tags inside)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.bits = [-1], ["body"], [0]
        self.runs: list[tuple[int, str, int]] = []
        stack, names = [0], ["body"]
        open_: dict[str, int] = {}
        unended: set[str] = set()
        text: list[str] = []
        linked, links, pos, end = 0, 0, 0, len(source)

        def flush() -> None:
            nonlocal linked
            if text:
                run = "".join(text)
                run = " ".join((entities.unescape(run) if "&" in run else run).split())
                if run:
                    self.runs.append((stack[-1], run, min(linked, len(run))))
                text.clear()
            linked = 0

        def close(upto: int) -> None:
            flush()
            for gone in names[upto:]:
                open_[gone] -= 1
            del stack[upto:], names[upto:]

        find = _TOKEN.search
        while pos < end:
            m = find(source, pos)
            if m is None:
                text.append(source[pos:])
                break
            if m.start() > pos:
                text.append(source[pos : m.start()])
                if links:
                    linked += m.start() - pos
            pos = m.end()
            name = m[2]
            if name is None:
                continue
            if not m[4]:
                break
            name = name.lower()
            if m[1]:
                if name in INLINE:
                    links = max(0, links - 1) if name == "a" else links
                elif open_.get(name):
                    close(next(i for i in range(len(names) - 1, 0, -1) if names[i] == name))
                    links = 0
            elif name in INLINE:
                if name == "a":
                    links = 1
                elif name == "br":
                    text.append(" ")
            elif name in RAW:
                whole = m[3][-1:] != "/" and name not in unended
                stop = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(source, pos) if whole else None
                if stop:
                    pos = stop.end()
                elif whole and name in ("script", "style", "textarea", "title"):
                    break
                elif whole:
                    unended.add(name)
                text.append(" ")
            elif name in VOID:
                if name == "hr":
                    flush()
                else:
                    text.append(" ")
            elif name in ("html", "body", "head", "tbody", "thead", "tfoot"):
                flush()
            else:
                if name in ENDS_P and names[-1] == "p":
                    close(len(names) - 1)
                elif name in IMPLIED and any(open_.get(k) for k in IMPLIED[name][0]):
                    kinds, stops = IMPLIED[name]
                    for i in range(len(names) - 1, 0, -1):
                        if names[i] in stops:
                            break
                        if names[i] in kinds and (name != "tr" or names[i] == "tr"):
                            close(i)
                            break
                if len(names) > DEPTH:
                    close(DEPTH)
                flush()
                links = 0
                self.parent.append(stack[-1])
                self.tag.append(name)
                self.bits.append(attribute_kinds(m[3]) if m[3] else 0)
                stack.append(len(self.tag) - 1)
                names.append(name)
                open_[name] = open_.get(name, 0) + 1
        flush()
        self._own_text_nodes()

    def _own_text_nodes(self) -> None:
        """Text beside block children becomes a node of its own, so that it is judged by itself."""
        mixed = set(self.parent)
        for i, (node, run, linked) in enumerate(self.runs):
            if node in mixed:
                self.parent.append(node)
                self.tag.append("#text")
                self.bits.append(0)
                self.runs[i] = (len(self.tag) - 1, run, linked)

    def features(self) -> list[list[float]]:
        n, parent = len(self.tag), self.parent
        chars, linked, words, stops, blocks, tags, paras = ([0] * n for _ in range(7))
        first, before = [n] * n, 0
        start = [0] * n
        for node, run, link in self.runs:
            if not chars[node]:
                start[node] = before
            before += len(run)
            chars[node] += len(run)
            linked[node] += link
            words[node] += run.count(" ") + 1
            stops[node] += run.count(". ") + run.count("! ") + run.count("? ") + (run[-1] in ".!?")
            blocks[node] += 1
        total = before or 1
        own = chars[:]
        children, same = [0] * n, [dict() for _ in range(n)]
        longest = [0] * n
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for sums in (chars, linked, words, stops, blocks):
                sums[p] += sums[i]
            tags[i] += 1
            tags[p] += tags[i]
            paras[i] += self.tag[i] == "p"
            paras[p] += paras[i]
            children[p] += 1
            longest[p] = max(longest[p], chars[i])
            same[p][self.tag[i]] = same[p].get(self.tag[i], 0) + 1
            if chars[i]:
                start[p] = start[i] if not own[p] else start[p]
        depth, above, kinds_above, place, seen = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        out = []
        for i in range(n):
            p = parent[i]
            kind = KIND.get(self.tag[i], 2)
            if i:
                depth[i] = depth[p] + 1
                above[i] = above[p] | self.bits[p]
                kinds_above[i] = kinds_above[p] | 1 << KIND.get(self.tag[p], 2)
                place[i] = seen[p]
                seen[p] += 1
            c = chars[i]
            q = p if i else 0
            row = [0.0] * len(KINDS)
            row[kind] = 1.0
            row += [self.bits[i] >> k & 1 for k in range(len(TOKENS))]
            row += [above[i] >> k & 1 for k in range(len(TOKENS))]
            row += [kinds_above[i] >> k & 1 for k in (0, 7, 8, 9, 10, 11, 12)]
            row += [
                depth[i],
                math.log1p(c),
                c / total,
                linked[i] / (c + 1),
                c / (tags[i] + 1),
                words[i] / (blocks[i] + 1),
                stops[i] / (words[i] + 1),
                paras[i],
                children[i],
                place[i] / (children[q] or 1),
                children[q],
                same[q].get(self.tag[i], 0),
                c / (chars[q] + 1),
                c / (longest[q] + 1),
                (chars[q] - c) / (children[q] or 1),
                start[i] / total,
            ]
            out.append(row)
        return out

    def decoded(self, p: list[float]) -> list[bool]:
        """The likeliest labelling in which every main node but the top has a main parent."""
        n = len(self.tag)
        no = [math.log(max(1e-9, 1 - x)) for x in p]
        yes = [math.log(max(1e-9, x)) for x in p]
        for i in range(n - 1, 0, -1):  # children come after their parents
            q = self.parent[i]
            yes[q] += max(no[i], yes[i])
            no[q] += no[i]
        main = [False] * n
        for i in range(n):
            main[i] = yes[i] > no[i] and (i == 0 or main[self.parent[i]])
        return main

    def text(self, main: list[bool]) -> str:
        return "\n\n".join(run for node, run, _ in self.runs if main[node])


@functools.lru_cache(4)
def fit(pages: int = 900, seed: int = 20) -> BoostedTrees:
    """Trees learned from `pages` made pages, once a session."""
    from .page_templates import labelled_pages

    x, y = [], []
    for source, wanted in labelled_pages(pages, seed):
        page = Page(source)
        main = [False] * len(page.tag)
        for node, run, _ in page.runs:
            if wanted(run):
                while node >= 0 and not main[node]:
                    main[node] = True
                    node = page.parent[node]
        x += page.features()
        y += main
    return BoostedTrees.train(np.array(x, np.float64), np.array(y, np.float64), trees=80)


def _extractor(model: BoostedTrees, h: str, rest: list[str], at_once: int = 200):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, texts = batch.column(h).to_pylist(), []
            for i in range(0, len(sources), at_once):
                pages = [Page(s) for s in sources[i : i + at_once]]
                p = model.probability(np.array([row for page in pages for row in page.features()], np.float64)).tolist()
                at = 0
                for page in pages:
                    texts.append(page.text(page.decoded(p[at : at + len(page.tag)])))
                    at += len(page.tag)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*rest, "text", "n_chars"])

    return run


def extracted(pages: DataFrame, model: BoostedTrees, html: str = "html") -> DataFrame:
    """pages with html replaced by text and n_chars (which replace columns of these names)."""
    h, rest = fresh(pages, "h"), others(pages, (html,), ("text", "n_chars"))
    schema = plus(pages.select(*rest), text=T.StringType(), n_chars=T.LongType())
    return pages.select(*rest, text_or_empty(html).alias(h)).mapInArrow(_extractor(model, h, rest), schema)
