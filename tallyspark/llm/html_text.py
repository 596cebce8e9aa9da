"""Main text of web pages: a conditional random field over the leaf blocks of the DOM.

A tolerant tokenizer walks the tags, keeps the stack of open elements and cuts the text into
leaf blocks. Each block's features are its ancestors' tags, the words of their classes, ids and
roles, and signs of the text (length, share of links, end mark). The field is trained on the
labelled pages below; Viterbi marks every block as main text or not.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.llm.common import slices, strings
from tallyspark.llm.crf import Chain, decode, fit_chain

# Elements whose content is read up to their end tag as it stands; elements whose text is
# left out; of these, and of formulas, those that a block element inside ends; elements that end a block;
# elements without content.
_RAW = frozenset("script style title textarea".split())
_SILENT = frozenset("title textarea noscript template svg iframe select canvas audio video".split())
_FOREIGN = frozenset("svg math".split())
_BROKEN_OUT = frozenset("svg math select".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# A start tag of the group ends an open element of the group, up to the scope's element.
_ENDS = (
    (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    (frozenset({"dd", "dt"}), frozenset({"dl"})),
    (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    (frozenset({"tr"}), frozenset({"table", "tbody", "thead", "tfoot"})),
    (frozenset({"option"}), frozenset({"select"})),
)
_P_SCOPE = frozenset({"td", "th", "table", "button", "caption", "html", "body"})

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>",
    re.S,
)
_ENDS_RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}
_MARKS = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|y)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORDS = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    features: tuple[str, ...]
    labelled: bool


class _Walk:
    """The leaf blocks of one page."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[str, ...], bool]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.out: list[Block] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append(Block(text, self.features(text), any(y for _, _, y in self.stack)))
        self.parts, self.linked = [], 0

    def features(self, text: str) -> tuple[str, ...]:
        blocks = [tag for tag, _, _ in self.stack if tag in _BLOCK]
        out = {f"in:{tag}" for tag in blocks if tag not in ("html", "body")}
        out |= {f"is:{w}" for _, ws, _ in self.stack for w in ws}
        share, n = self.linked / max(len(text), 1), len(text)
        out.add("own:" + (blocks[-1] if blocks else "none"))
        out.add("links:" + ("none" if share < 0.05 else "few" if share < 0.5 else "most"))
        out.add("size:" + ("s" if n < 25 else "m" if n < 80 else "l"))
        out.add(f"ends:{text[-1] in '.!?:;…。'}")
        if "©" in text or "copyright" in text.lower()[:80]:
            out.add("rights")
        return tuple(sorted(out))

    def start(self, tag: str, rest: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in _BLOCK:
            self.flush()
            self.close_implied(tag)
            if tag != "option":
                self.break_out()
        if tag in _VOID or tag in _FOREIGN and rest.endswith("/"):
            return
        marks, labelled = [], False
        for name, value in _MARKS.findall(rest) if rest.strip() else ():
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "y":
                labelled = True
            elif name in ("hidden", "aria-hidden") and value != "false" or name == "style" and "display:none" in value.replace(" ", ""):
                marks.append("hidden")
            elif name in ("class", "id", "role"):
                marks += _WORDS.findall(value)
        self.stack.append((tag, tuple(marks), labelled))

    def break_out(self) -> None:
        """A block element ends pictures, formulas and lists of options that were left open."""
        for i, (tag, _, _) in enumerate(self.stack):
            if tag in _BROKEN_OUT:
                del self.stack[i:]
                break

    def close_implied(self, tag: str) -> None:
        names = [t for t, _, _ in self.stack]
        for group, scope in (*_ENDS, (frozenset({"p"}), _P_SCOPE)):
            if tag in group or "p" in group:
                for i in range(len(names) - 1, -1, -1):
                    if names[i] in group:
                        del self.stack[i:], names[i:]
                        break
                    if names[i] in scope:
                        break

    def end(self, tag: str) -> None:
        if tag in _BLOCK:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break
            if tag not in _BLOCK and self.stack[i][0] in _BLOCK:
                break  # a stray end of an inline element ends no block

    def text(self, raw: str) -> None:
        if any(tag in _SILENT for tag, _, _ in self.stack):
            return
        raw = html.unescape(raw)
        self.parts.append(raw)
        if any(tag == "a" for tag, _, _ in self.stack):
            self.linked += len(raw.strip())


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page.

    A script or a style without an end tag takes the rest of the page, as in browsers. All other
    elements left open end with the element around them, so nothing after that is lost.
    """
    walk, done, unended = _Walk(), 0, set()
    while m := _TOKEN.search(page, done):
        if m.start() > done:
            walk.text(page[done : m.start()])
        done = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            walk.end(tag)
            continue
        end = _ENDS_RAW[tag].search(page, done) if tag in _RAW and tag not in unended else None
        if end:
            done = end.end()
        elif tag in ("script", "style"):
            done = len(page)
        else:
            unended |= _RAW & {tag}
            walk.start(tag, m[3])
    if done < len(page):
        rest = page[done:]
        cut = rest.rfind("<")
        if cut >= 0 and re.match(r"</?[a-zA-Z!]", rest[cut:]):  # a tag that the page's end cuts off
            rest = rest[:cut]
        walk.text(rest)
    walk.flush()
    return walk.out


# The labelled pages: elements marked with y hold main text.
LABELLED = (
    """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li>
    <li><a href=/c>about,</a></li></ul></nav><div class="ad">Buy two for the price of one.</div><article><h1 y>A walk in the hills</h1>
    <p y>The path climbs past the old mill and turns north.<p y><b>It was cold.<br>Nobody came that day, and nobody was expected.</b>
    <p y>Short.</p><p y>Then we went home, tired and glad.</p></article><footer>&copy; example.org &middot; All about walks.</footer></body></html>""",
    """<html><body><header><div class="logo">The Daily</div><p>News since 1900.</p></header><nav class="menu"><a href=/>Start</a> <a href=/w>World</a></nav>
    <main><h1 y>Rain expected</h1><h2 y>By our reporter</h2><p y>Heavy rain is expected on Monday in the valley.</p><ul y><li>Take a coat.</li><li>Take boots</li></ul>
    <p y>More will be known tomorrow</p></main><aside class="sidebar"><h3>Related</h3><ul><li><a href=/1>Ten best hats</a></li><li><a href=/2>Sun again.</a></li></ul></aside>
    <footer><p>Contact us at the office.</p><p>Terms and privacy.</p></footer></body></html>""",
    """<body><div id="cookie-notice" class="notice"><p>We use cookies to make this site better for you.</p><button>Accept</button></div>
    <div class="content"><h1 y>How bread rises</h1><p y>Yeast eats sugar and gives off gas, which the dough holds.</p><p y>Warmth helps.</p>
    <blockquote y>Patience is the best flour.</blockquote><div class="advert"><p>Our new oven is here. Order today and save!</p></div>
    <p y>Knead it, rest it, and bake it for an hour.</p></div><div class="comments" id="comments"><h3>Comments</h3><p>Great piece, thank you so much!</p>
    <p>I do not agree with the part about salt.</p><form><label>Name</label><input><p>Leave a reply.</p><button>Send</button></form></div></body>""",
    """<body><div role="banner"><h2>My site</h2></div><div role="navigation"><ul><li><a href=/>One</a><li><a href=/>Two</a></ul></div>
    <div role="main"><h1 y>Notes on birds</h1><p y>They sing at dawn. They sing <a href=/x>at dusk</a> too.</p><table y><tr><td>Robin</td><td>12</td></tr><tr><td>Wren</td><td>7</td></tr></table>
    <p y>Counted in the spring of last year by the members of the club.</p></div><div class="share social">Share this on the web.</div>
    <div role="complementary" class="newsletter subscribe"><p>Get our letter every week. It is free.</p><form><input><button>Join</button></form></div>
    <div role="contentinfo">Copyright 2020 by the club. All rights reserved.</div></body>""",
    """<body><div class="header"><h1>Shop and blog</h1><p>Everything for the garden.</p></div><div class="breadcrumbs"><a href=/>Home</a> &gt; <a href=/g>Garden</a></div>
    <div id="post" class="post entry"><h2 y>Pruning roses</h2><p y>Cut above a bud, at an angle, in late winter when the frost is gone.</p>
    <p y>Use clean tools.</p><pre y>sharp knife</pre><p y>Burn what is sick.</p></div><div class="related"><h4>You may also like</h4><p><a href=/q>Watering in summer, the right way.</a></p></div>
    <div class="banner promo sponsored"><p>Sponsored: a mower that mows by itself, now at half price.</p></div><div id="footer"><p>Imprint.</p><p>Made by hand in the south.</p></div></body>""",
    """<body><nav><a href=/>A</a><a href=/>B</a></nav><article><header><h1 y>On rivers</h1><p class="byline meta">By A. Writer</p></header>
    <section y><h2>Sources</h2><p>A river begins in springs, in bogs or under ice.</p><p>Small.</p></section><figure><figcaption y>The source in May.</figcaption></figure>
    <section y><h2>Mouths</h2><p>It ends in a delta or a bay, and in some lands in sand.</p><dl><dt>Delta</dt><dd>A fan of arms.</dd></dl></section>
    <aside class="ad"><p>Rafts for rent at the bridge, every day from nine.</p></aside><footer class="tags"><a href=/t>water</a></footer></article>
    <section class="comments"><article class="comment"><p>Lovely photos, where is this?</p></article><article class="comment reply"><p>Near the pass, I think.</p></article></section>
    <footer>(c) The editors</footer></body>""",
    """<body><div class="popup modal" hidden><p>Sign up now and never miss a story again.</p></div><div class="login"><form><label>User</label><p>Forgot your password?</p></form></div>
    <article class="story"><h1 y>The clock tower</h1><p y>La torre es de piedra y se ve desde el mar.</p><p y>Der Turm ist alt.</p><p y>On y monte par un escalier de bois, en silence.</p><ol y><li>Gate</li><li>Stairs.</li></ol></article>
    <div class="widget search"><form><input><button>Search</button></form></div><div class="alert notice">This site will be down on Sunday.</div><footer><ul><li><a href=/>Legal</a></li></ul></footer></body>""",
    """<body><article><h1 y>One line</h1></article><footer>&copy; host &middot; a word.</footer></body>""",
    """<body><nav><ul><li><a href=/>x</a></li></ul></nav><div class="ads">An offer that ends soon, do not wait.</div><article><h1 y>ALL CAPS!! TITLE!!</h1><p y>WORDS!! AND!! MORE!! WORDS!!</p>
    <p y>word### other*** more%%%</p><p y>one | two | three</p><p y>Licensed under some license.</p><p y>All rights reserved. Copyright is held by nobody</p></article></body>""",
    """<body><p y>Just a bare page of text without any frame around it, as people wrote them once.</p><p y>A second one.</p></body>""",
    """<body><h1 y>Plain</h1><div y>Text in a plain box, as it was done before there were better ways to do it.</div><div class="footer copyright">&copy; 2001</div></body>""",
)
LABELS = ("other", "main")


def learn() -> Chain:
    table = [
        ([b.features for b in blocks], [LABELS[b.labelled] for b in blocks]) for blocks in map(leaf_blocks, LABELLED)
    ]
    return fit_chain(table, LABELS, steps=300)


def main_texts(chain: Chain, pages: list[str], rows: dict | None = None) -> list[str]:
    """The main text of each page. ``rows`` keeps emission rows of feature sets seen so far."""
    rows = {} if rows is None else rows
    if len(rows) > 100_000:
        rows.clear()
    blocks = [leaf_blocks(p) for p in pages]
    counts = np.array([len(b) for b in blocks], np.int64)
    if not counts.sum():
        return [""] * len(pages)
    for page in blocks:
        for b in page:
            if b.features not in rows:
                rows[b.features] = chain.emission(b.features)
    best = decode(chain, np.array([rows[b.features] for page in blocks for b in page]), counts).tolist()
    out, at = [], 0
    for page in blocks:
        out.append(" ".join(b.text for b, y in zip(page, best[at : at + len(page)], strict=True) if y))
        at += len(page)
    return out


def extractor(chain: Chain) -> Column:
    """A column function: the main text of a whole page; null, empty and textless pages give ''."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rows: dict = {}
        for pages in batches:
            yield pd.Series([t for part in slices(strings(pages)) for t in main_texts(chain, part, rows)], dtype=object)

    return F.pandas_udf(run, "string")
