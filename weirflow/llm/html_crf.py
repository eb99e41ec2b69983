"""Main text of web pages: a linear-chain CRF over DOM leaf blocks with ancestor and text features."""

from __future__ import annotations

import bisect
import html
import random
import re
from collections.abc import Container, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import crf
from weirflow.llm.common import slices

TRAIN_PAGES = 260
SEED = 23
BOILERPLATE, CONTENT = 0, 1

# fixed values: element names of the HTML standard
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "template", "noscript", "iframe", "textarea", "title")
FOREIGN = ("svg", "math")  # in these, `/>` ends an element
IN_HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"),
    "option": ("option",), "tbody": ("td", "th", "tr", "thead", "tbody"), "body": ("head",),
}
_CLOSED = {tag: ("p", *names) for tag, names in CLOSES.items()}
_PLAIN = {tag: ("in=" + tag,) for tag in BLOCK}
SCOPES = frozenset("table ul ol dl select body div section article".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_UNENDED = re.compile(r"<!--.*\Z|<[!?].*\Z", re.S)  # all that can be behind the last `>`: a comment or declaration without end
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# fixed values: parts of class names and ids by what they usually hold
CATEGORIES = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs crumbs pagination pager tabs toolbar skip toc".split(),
    "head": "header masthead topbar logo branding siteheader top".split(),
    "foot": "footer foot copyright colophon legal bottom imprint".split(),
    "side": "sidebar side aside related recommended recommendations widget rail trending popular more teaser".split(),
    "ad": "ad ads adv advert advertisement adsense banner promo promotion promoted sponsor sponsored sponsors".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription paywall signup toast warning".split(),
    "talk": "comment comments reply replies discussion respond disqus feedback reader guestbook".split(),
    "form": "form search login contact register input field poll".split(),
    "share": "share sharing social follow like tags meta byline author".split(),
    "text": "content article post story entry body main text page prose".split(),
}
_CATEGORY = {part: name for name, parts in CATEGORIES.items() for part in parts}


@dataclass
class Block:
    tag: str
    path: frozenset[str]  # structural ancestors and the categories of their names
    text: str = ""
    linked: int = 0  # code points inside links
    chunks: list[str] = field(default_factory=list)


def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    if not attributes or "=" not in attributes:
        return ("in=" + tag,)
    parts = {p.lower() for _, v in _ATTRIBUTE.findall(attributes) for p in _NAME_PART.findall(v)}
    return ("in=" + tag, *sorted("cat=" + c for c in {_CATEGORY.get(p) for p in parts} if c), *sorted("name=" + p for p in parts))


class Open:
    """The open elements. What a block asks of them (ancestors' marks, nearest block, places of a name) is kept with each
    element, so that no question walks the stack."""

    def __init__(self, known: Container[str] | None):
        self.known = known  # marks that count; None: all
        self.names: list[str] = []
        self.paths: list[frozenset[str]] = [frozenset()]  # by depth: marks of the blocks around and of this one
        self.blocks: list[int] = [-1]  # by depth: place of the nearest block
        self.kinds: list[str] = [""]  # by depth: nearest block or foreign element
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, attributes: str) -> None:
        at, path = len(self.names), self.paths[-1]
        block = tag in BLOCK
        if block:
            marks = _marks(tag, attributes) if "=" in attributes else _PLAIN[tag]
            if not path.issuperset(marks):
                path = path.union(marks if self.known is None else [m for m in marks if m in self.known])
        self.names.append(tag)
        self.paths.append(path)
        self.blocks.append(at if block else self.blocks[-1])
        self.kinds.append(tag if block or tag in FOREIGN else self.kinds[-1])
        self.places.setdefault(tag, []).append(at)

    def cut(self, depth: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.names) > depth:
            self.places[self.names.pop()].pop()
            self.paths.pop()
            self.blocks.pop()
            self.kinds.pop()

    def last(self, tag: str) -> int:
        """Place of the innermost element of a name, or -1."""
        found = self.places.get(tag)
        return found[-1] if found else -1

    def imply(self, tag: str) -> None:
        """End tags that a block's start implies: of open paragraphs and what it closes, up to the nearest scope."""
        closed = [found for name in _CLOSED.get(tag, ("p",)) if (found := self.places.get(name))]
        if not closed:
            return
        scope, outer = max(self.last(t) for t in SCOPES), len(self.names)
        for found in closed:
            i = bisect.bisect_right(found, scope)
            if i < len(found):
                outer = min(outer, found[i])
        self.cut(outer)


def blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """Leaf blocks of text in page order, of what a browser would show; linear in the page.

    Of the ancestors' marks only the `known` ones are kept, if given, so that a block's path is bounded.
    """
    out: list[Block] = []
    stack = Open(known)
    held: list[str] = []
    linked = at = links = 0
    final = page.rfind(">")  # no tag ends behind it

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            nearest = stack.blocks[-1]
            out.append(Block(stack.names[nearest] if nearest >= 0 else "body", stack.paths[-1], text, linked))
        held.clear()
        linked = 0

    def leave_head() -> None:
        for i, t in enumerate(stack.names[:3]):
            if t == "head":
                stack.cut(i)
                break

    def foreign(tag: str) -> bool:
        if tag in FOREIGN or tag in BLOCK and tag != "title":
            return tag in FOREIGN
        return stack.kinds[-1] in FOREIGN

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not raw.isspace():
            leave_head()
        if raw and "head" not in stack.names[:3]:
            text = html.unescape(raw) if "&" in raw else raw
            held.append(text)
            if links:
                linked += len(text)

    lowered = None
    while True:
        m = _TOKEN.search(page, at, final + 1) if at <= final else None
        if not m:
            unended = _UNENDED.search(page, max(at, final + 1))
            say(page[at:unended.start() if unended else len(page)])
            break
        say(page[at:m.start()])
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):  # a comment without end
            break
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag closes what it names and all inside; one that names nothing open does nothing
            if tag in BLOCK:
                flush()
            depth = stack.last(tag)
            if depth >= 0 and (tag in BLOCK or stack.blocks[-1] < depth):
                stack.cut(depth)
            if tag == "a":
                links = 0
            elif tag == "p" and depth < 0:
                flush()
            continue
        if tag not in IN_HEAD:
            leave_head()
        if (m[3] or m[6] or "").endswith("/") and foreign(tag):  # an element without content
            continue
        if tag in RAW:
            if tag in ("title", "textarea") and not foreign(tag):
                flush()
            lowered = page.lower() if lowered is None else lowered
            end = lowered.find("</" + tag, at) if len(lowered) == len(page) else -1
            if end < 0:
                closing = re.compile("</" + tag, re.I).search(page, at)
                end = closing.start() if closing else len(page)
            close = page.find(">", end)
            at = len(page) if close < 0 else close + 1
            continue
        if tag in BLOCK:
            flush()
            stack.imply(tag)
        elif tag == "br":
            held.append("\n")
        if tag == "a":
            links = 1
        if tag not in VOID:
            stack.push(tag, m[3] or m[6] or "")
    flush()
    return out


# ---- features

_SAYS = re.compile(r"©|\(c\)|copyright|all rights|cookie|subscribe|newsletter|advert|sponsored|sign up|log in|share", re.I)


def block_features(b: Block, path: bool = True) -> list[str]:
    words = b.text.count(" ") + 1
    share = b.linked / len(b.text)
    size = next(n for n in (2, 5, 10, 20, 40, 1 << 60) if words <= n)
    out = ["tag=" + b.tag, *(b.path if path else ()), f"words={size if size < 100 else 'more'}", f"links={0 if not share else 1 if share < 0.3 else 2 if share < 0.8 else 3}"]
    if b.text[-1] in ".!?…\"”":
        out.append("sentence")
    if _SAYS.search(b.text):
        out.append("says")
    return out


def context_features(items: list[Block], path: bool = True) -> list[list[str]]:
    """Features of each block, with its ancestors' unless told not, and the size and tag of its neighbours."""
    own = [block_features(b, path) for b in items]
    short = [[x for x in f if x.startswith(("tag=", "words="))] for f in own]
    out = []
    for i, f in enumerate(own):
        around = ["first"] if i == 0 else ["-" + x for x in short[i - 1]]
        around += ["last"] if i == len(own) - 1 else ["+" + x for x in short[i + 1]]
        out.append(f + around)
    return out


def _ids(features: list[list[str]], known: dict[str, int], width: int) -> np.ndarray:
    """Rows of feature ids, padded; for training, whose widest row gives the width."""
    out = np.full((len(features), width), len(known), np.int64)
    for i, f in enumerate(features):
        at = sorted({known[x] for x in f if x in known})
        out[i, : len(at)] = at
    return out


def _scores(items: list[Block], known: dict[str, int], chain: crf.Chain, paths: dict[frozenset[str], np.ndarray]) -> np.ndarray:
    """Emission scores of a page's blocks: all their features, whatever their number. Sums over equal paths are remembered."""
    features, none = context_features(items, False), np.zeros(chain.weights.shape[1])
    out = np.empty((len(items), chain.weights.shape[1]))
    small: dict[tuple[str, ...], np.ndarray] = {}
    for i, (b, f) in enumerate(zip(items, features)):
        around = paths.get(b.path)
        if around is None:
            around = paths[b.path] = sum((chain.weights[known[x]] for x in b.path if x in known), none)
        key = tuple(f)
        own = small.get(key)
        if own is None:
            own = small[key] = sum((chain.weights[known[x]] for x in set(f) if x in known), none)
        out[i] = around + own
    return out


# ---- labelled pages


def labelled_pages(n: int, seed: int) -> list[tuple[str, dict[str, int]]]:
    """Pages from a seeded generator, with the label of each block by its text: layouts, class names and faults vary."""
    r = random.Random(seed)
    syllables = "an be co di el fo ga hi in jo ka lu me no or pa qu re su te un vi wo xa ye zu é ción ung".split()
    serial = iter(range(10**9))

    def text(lo, hi, mark=""):
        junk = r.choice(["", "", "", "", "***", "&amp;&amp;&amp;", "%%%"])
        w = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) + junk for _ in range(r.randint(lo, hi))]
        return (mark + " " if mark else "") + " ".join(w).capitalize() + f" q{next(serial)}" + r.choice([".", ".", ".", "", "!"])

    labels: dict[str, int] = {}

    def put(inner: str, label: int) -> str:
        labels[" ".join(html.unescape(re.sub("<[^>]+>", "", inner)).split())] = label
        return inner

    def name(kind: str) -> str:
        part = r.choice(CATEGORIES[kind])
        part = r.choice([part, part, f"site-{part}", f"{part}-box", f"main_{part}", part.capitalize() + "Area"])
        return r.choice(["class", "class", "id"]) + f'="{part}"'

    def links(k: int, tag="li") -> str:
        return "".join(f"<{tag}>" + put(f'<a href="/x">{text(1, 2)}</a>', 0) + (f"</{tag}>" if r.random() < 0.8 or tag != "li" else "") for _ in range(k))

    def menu():
        k = r.randint(2, 7)
        return r.choice([lambda: f"<nav><ul>{links(k)}</ul></nav>", lambda: f"<div {name('nav')}><ul>{links(k)}</ul></div>", lambda: f"<nav {name('nav')}>{links(k, 'div')}</nav>"])()

    def boxed(kind: str, tag: str, lo=2, hi=30, mark=""):
        inner = "".join(r.choice([f"<p>{put(text(lo, hi, mark), 0)}</p>", f"<div>{put(text(lo, hi, mark), 0)}</div>"]) for _ in range(r.randint(1, 3)))
        if r.random() < 0.4:
            inner = put(text(lo, hi, mark), 0)
        return r.choice([f"<{tag}>{inner}</{tag}>", f"<div {name(kind)}>{inner}</div>", f"<{tag} {name(kind)}>{inner}</{tag}>"] if tag != "div" else [f"<div {name(kind)}>{inner}</div>", f"<section {name(kind)}>{inner}</section>"])

    def form():
        return f"<form {r.choice(['', name('form')])}><label>{put(text(1, 3), 0)}</label><input name=q><button>{put(text(1, 2), 0)}</button>" + (f"<select><option>{put(text(1, 1), 0)}<option>{put(text(1, 1), 0)}</select>" if r.random() < 0.4 else "") + (f"<p>{put(text(4, 15), 0)}</p>" if r.random() < 0.4 else "") + "</form>"

    def talk():
        each = "".join(r.choice([f"<div {name('talk')}><p>{put(text(3, 60), 0)}</p></div>", f"<li><p>{put(text(3, 60), 0)}</p></li>", f"<article><p>{put(text(3, 60), 0)}</p></article>"]) for _ in range(r.randint(1, 6)))
        return f"<{(t := r.choice(['section', 'div', 'ol']))} {name('talk')}><h3>{put(text(1, 3), 0)}</h3>{each}</{t}>"

    def side():
        return boxed("side", "aside", 2, 40) if r.random() < 0.6 else f"<aside><h3>{put(text(1, 3), 0)}</h3><ul>{links(r.randint(2, 6))}</ul></aside>"

    def body():
        out = [f"<h1>{put(text(2, 12), 1)}</h1>"]
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.62:
                p = put(text(1, 3) if r.random() < 0.15 else text(4, 90), 1)
                out.append(r.choice([f"<p>{p}</p>", f"<p>{p}</p>", f"<p>{p}", f"<p><b>{p}<br>", f"<div>{p}</div>", f"<p>{p}</p>"]))
            elif x < 0.70:
                out.append(f"<h{(h := r.choice('23'))}>{put(text(1, 7), 1)}</h{h}>")
            elif x < 0.76:
                out.append("<ul>" + "".join(f"<li>{put(text(2, 20), 1)}" + r.choice(["</li>", ""]) for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.79:
                out.append(f"<blockquote><p>{put(text(4, 40), 1)}</p></blockquote>")
            elif x < 0.81:
                out.append(f"<figure><img src=x><figcaption>{put(text(3, 12), 1)}</figcaption></figure>")
            elif x < 0.84:
                out.append("<table>" + "".join(f"<tr><td>{put(text(1, 4), 1)}</td><td>{put(text(1, 4), 1)}</td></tr>" for _ in range(2)) + "</table>")
            else:
                out.append(r.choice([lambda: boxed("ad", "div"), lambda: boxed("share", "div", 1, 4), form, side, lambda: boxed("notice", "div", 3, 20)])())
        return "".join(out)

    out = []
    for _ in range(n):
        labels = {}
        top = [lambda: r.choice([f"<header><h2>{put(text(1, 4), 0)}</h2>{menu()}</header>", f"<div {name('head')}><h1>{put(text(1, 4), 0)}</h1><p>{put(text(2, 8), 0)}</p></div>", menu()]), menu, lambda: boxed("ad", "div"), lambda: boxed("notice", "div", 3, 30), form, side]
        r.shuffle(top)
        page = "".join(f() for f in top[: r.randint(0, 3)])
        main = body()
        page += r.choice([main, f"<article>{main}</article>", f"<article>{main}</article>", f"<main><article>{main}</article></main>", f"<main>{main}</main>", f"<div {name('text')}>{main}</div>", f"<div>{main}</div>", f"<div {name('text')}><article>{main}</article></div>"])
        low = [talk, side, lambda: boxed("ad", "div"), lambda: boxed("side", "section"), form, menu]
        r.shuffle(low)
        page += "".join(f() for f in low[: r.randint(0, 3)])
        if r.random() < 0.9:
            page += r.choice([f"<footer>{put(text(2, 8, '&copy;'), 0)}</footer>", boxed("foot", "footer", 2, 12, r.choice(["", "©"])), f"<div {name('foot')}>{put(text(2, 10, '&copy;'), 0)}</div>"])
        out.append((f"<!DOCTYPE html><html><head><title>{text(2, 5)}</title><script>var t='</p>';</script></head><body>{page}" + r.choice(["</body></html>", ""]), labels))
    return out


def fit(pages: list[tuple[str, dict[str, int]]]) -> tuple[dict[str, int], crf.Chain]:
    sequences, targets = [], []
    for page, labels in pages:
        found = [b for b in blocks(page) if b.text in labels]
        if found:
            sequences.append(context_features(found))
            targets.append(np.array([labels[b.text] for b in found]))
    seen: dict[str, int] = {}
    for s in sequences:
        for f in s:
            for x in f:
                seen[x] = seen.get(x, 0) + 1
    known = {x: i for i, x in enumerate(sorted(x for x, k in seen.items() if k >= 8))}
    width = max(len(set(f)) for s in sequences for f in s)
    return known, crf.fit([_ids(s, known, width) for s in sequences], targets, len(known), 2, epochs=100)


def main_texts(pages: list[str], model: tuple[dict[str, int], crf.Chain]) -> list[str]:
    known, chain = model
    found = [blocks(p, known) for p in pages]
    lengths = np.array([len(b) for b in found], np.int64)
    if not lengths.sum():
        return [""] * len(pages)
    paths: dict[frozenset[str], np.ndarray] = {}
    labels = chain.viterbi(np.concatenate([_scores(b, known, chain, paths) for b in found if b]), lengths)
    out, at = [], 0
    for own in found:
        out.append("\n\n".join(b.text for b, y in zip(own, labels[at:at + len(own)]) if y == CONTENT))
        at += len(own)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """`page_id, url, text, n_chars`: the main text of every page, from the whole html.

    The page is cut into leaf blocks of text with their ancestors; a chain of two labels, trained here on labelled pages
    from a seeded generator, keeps or drops each by its ancestors' tags and names, its own text and its neighbours.
    Of elements only scripts, styles, titles, templates, `noscript`, frames and text fields are left out with their text;
    a head without end tag ends at the first text or element that can't stand in it.
    Character references are decoded, white space in a block is one space, blocks are joined by an empty line.

    Null or empty html, or a page without main text, gives an empty text and 0. Repeated rows and null ids or urls each
    keep their row; no rows give no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit(labelled_pages(TRAIN_PAGES, SEED)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 8 << 20):
            texts = main_texts([h or "" for h in part.column("html").to_pylist()], shared.value)
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
