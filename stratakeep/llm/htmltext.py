"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A tolerant parser cuts a page into leaf blocks: maximal runs of inline content between block-level
tags, each with its ancestor tags, their class and id words, and text statistics.  The field's
features are those of one block; its transitions tie neighbours.  It is trained on labelled pages
by maximum likelihood (forward-backward) and decodes by Viterbi.

``labelled_pages`` writes the labelled pages that the default model learns from: layouts drawn from
templates with known main blocks.  ``fit`` takes other labelled pages just as well.

Edge cases: a null or empty html has the text ""; unclosed and stray tags, broken entities and
missing ends are tolerated; pages of any length are read whole; a page whose blocks are all
rejected has the text ""; rows that repeat give repeated results.  Tags end where HTML ends them.
As in HTML, a script, style, title, textarea, comment or quoted value without an end reaches to the
end of the page; an iframe, noscript, select, svg, template or annotation of a formula without one is
read on as text, with one it is left out.  What an attribute hides (``hidden``, ``aria-hidden``,
``display:none``, ``visibility:hidden``) counts as no part of the article; a header inside an article
is its own, and so is a line on rights.  The text of a formula and the fallback text of an object
belong to the block that they stand in.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import released, ship

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg select annotation annotation-xml".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
# formulas and embedded objects stand inside the text around them
_INLINE |= frozenset("object param math annotation annotation-xml maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none mprescripts semantics".split())
_P_ENDS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "option": {"select"}}
_ENDS_PAGE = frozenset("script style title textarea".split())
# sought in the page itself: lower() may change the length and so the offsets
_ENDS = {name: re.compile(rf"</{name}(?=[ \t\n\f\r/>])", re.I | re.A) for name in _ENDS_PAGE}
# an attribute as HTML reads it: a quote opens a value only right after "="
_ATTRIBUTE = r"([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^ \t\n\f\r>\"'][^ \t\n\f\r>]*+)|(?=>)|\Z))?+"
_ATTR = re.compile(_ATTRIBUTE)
_TAG = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^ \t\n\f\r/>]*+)((?:[ \t\n\f\r/]++|" + re.sub(r"\((?!\?)", "(?:", _ATTRIBUTE) + r")*+)(?:>|\Z))", re.S)
_SKIPPED = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<script(?:[ \t\n\f\r][^>]*[^/>])?>.*?(?:</script|\Z)|<(/?)(annotation|annotation-xml|iframe|noscript|select|svg|template)(?=[ \t\n\f\r/>])([^>]*)", re.S | re.I | re.A)
_WORDED = frozenset("class id role".split())
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("text", "path", "words", "linked", "links")

    def __init__(self, text: str, path: tuple[str, ...], words: tuple[str, ...], linked: int, links: int):
        self.text, self.path, self.words, self.linked, self.links = text, path, words, linked, links


def _closed(page: str, at: int) -> dict[int, int]:
    """Where each closed iframe, svg and so on from ``at`` on has its end tag, by the place of its start."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for m in _SKIPPED.finditer(page, at):
        if not m[2]:
            continue
        starts = opened.setdefault(m[2].lower(), [])
        if not m[1]:
            if not m[3].rstrip().endswith("/"):
                starts.append(m.start())
        elif starts:
            ends[starts.pop()] = m.start()
    return ends


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order, with character references decoded and white space folded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = depth = 0
    place: list[tuple[str, tuple[str, ...]]] = []

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = entities.unescape(piece)
            if not parts or not any(p.strip() for p in parts):
                place[:] = stack
            parts.append(piece)
            if depth:
                linked += len(piece.strip())

    def flush() -> None:
        nonlocal linked, links
        whole = _SPACE.sub(" ", "".join(parts)).strip()
        if whole:
            out.append(Block(whole, tuple(t for t, _ in place), tuple(w for _, ws in place for w in ws), linked, links))
        parts.clear()
        linked = links = 0

    at, closed = 0, None
    while True:
        m = _TAG.search(page, at)
        if not m:
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name not in _INLINE:
                flush()
            if name == "a" and depth:
                depth -= 1
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name not in _INLINE:
            flush()
        if name in _ENDS_PAGE:
            end = _ENDS[name].search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else len(page)
            continue
        if name in _RAW:
            if closed is None:
                closed = _closed(page, m.start())
            if m.start() in closed:
                close = page.find(">", closed[m.start()])
                at = close + 1 if close >= 0 else len(page)
            continue
        if name == "br" or name == "img":
            parts.append(" ")
        if name in _VOID:
            continue
        if name in _P_ENDS or name in _SAME:
            _imply(stack, name)
        if name == "a":
            depth, links = 1, links + 1
        words = tuple(w for a in _ATTR.finditer(m[3]) for w in _told(a[1].lower(), (a[2] or a[3] or a[4] or "").lower())) if m[3] else ()
        stack.append((name, words))
    text(page[at:])
    flush()
    return out


def _told(name: str, value: str) -> list[str]:
    """What an attribute says: its name and its value's words, or that the element isn't shown."""
    if name == "aria-hidden":
        return ["unseen"] if value.strip() == "true" else []
    if name == "hidden":
        return ["unseen"]
    if name == "style":
        return ["unseen"] if _UNSEEN.search(value) else []
    return re.findall("[a-z]+", f"{name} {value}") if name in _WORDED else []


def _imply(stack: list, name: str) -> None:
    """Close what a start tag ends by implication."""
    if name in _P_ENDS:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == "p":
                del stack[i:]
                return
            if stack[i][0] not in _INLINE:
                return
        return
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == name:
            del stack[i:]
            return
        if stack[i][0] in _SAME[name]:
            return


_BINS = (20, 60, 150, 400)
_KINDS = (
    ("nav", "nav menu menubar navigation breadcrumb breadcrumbs navbar pagination pager tabs toc"),
    ("head", "header masthead banner topbar branding logo"),
    ("foot", "footer copyright legal colophon bottom"),
    ("side", "aside sidebar side widget related recommended recommendations complementary rail promo teaser trending popular more"),
    ("ad", "ad ads advert adverts advertisement advertising sponsored sponsor promotion banner promoted"),
    ("note", "cookie cookies consent notice notices gdpr alert popup modal newsletter subscribe overlay privacy dialog toast"),
    ("form", "form search login signup input subscribe contact fieldset button"),
    ("talk", "comment comments reply replies discussion disqus respond commentlist responses"),
    ("share", "share sharing social follow tags tag meta byline"),
    ("main", "article main content post entry story body text articlebody maincontent"),
)
_KIND_OF: dict[str, list[str]] = {}
for _kind, _words in _KINDS:
    for _word in _words.split():
        _KIND_OF.setdefault(_word, []).append(_kind)


def features(page: list[Block]) -> list[list[str]]:
    """Feature names of each block: ancestors, attribute words, own tag, text shape, neighbours."""
    rows = []
    for n, b in enumerate(page):
        f = {"bias", f"leaf={b.path[-1] if b.path else '-'}"}
        f |= {f"in={t}" for t in b.path if t not in ("html", "body")}
        f |= {f"kind={k}" for w in b.words for k in _KIND_OF.get(w, ())}
        f |= {f"word={w}" for w in b.words}
        block = next((t for t in reversed(b.path) if t not in _INLINE), "-")
        f.add(f"block={block}")
        size = len(b.text)
        f.add(f"size={sum(size > x for x in _BINS)}")
        share = b.linked / max(1, size)
        f.add(f"linked={0 if not b.links else 1 if share < 0.3 else 2 if share < 0.8 else 3}")
        f.add("stop" if b.text[-1] in ".!?…:\"'”»" else "open")
        f.add("first" if n == 0 else "last" if n == len(page) - 1 else "mid")
        if "article" in b.path or "main" in b.path:
            inner = b.path[max(i for i, t in enumerate(b.path) if t in ("article", "main")) :]
            f |= {f"within-{t}" for t in inner if t in ("nav", "aside", "footer", "header", "form")} or {"within"}
        # an article's own line on its rights is part of it
        rights = "©" in b.text or "all rights" in b.text.lower() or b.text[:9].lower() == "copyright"
        f.add("copyright" if rights and "within" not in f else "plain")
        rows.append(sorted(f))
    return rows


class Field:
    """Two labels (0 other, 1 main); weights by feature and label, and transitions."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, transitions: np.ndarray):
        self.names, self.weights, self.transitions = names, weights, transitions

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        names, out = self.names, np.zeros((len(rows), 2))
        for i, row in enumerate(rows):
            known = [names[f] for f in row if f in names]
            if known:
                out[i] = self.weights[known].sum(axis=0)
        return out

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi: the most probable labels of a page."""
        if not rows:
            return []
        s, t = self.scores(rows), self.transitions
        (t00, t01), (t10, t11) = t
        a, b = s[0]
        back = []
        for x, y in s[1:]:
            from0, from1 = (0, a + t00) if a + t00 >= b + t10 else (1, b + t10), (0, a + t01) if a + t01 >= b + t11 else (1, b + t11)
            back.append((from0[0], from1[0]))
            a, b = from0[1] + x, from1[1] + y
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 60, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Maximum likelihood by gradient ascent with forward-backward expectations (AdaGrad steps)."""
    names: dict[str, int] = {}
    coded = []
    for rows, labels in pages:
        coded.append(([np.array([names.setdefault(f, len(names)) for f in row]) for row in rows], np.array(labels)))
    w, t = np.zeros((len(names), 2)), np.zeros((2, 2))
    gw2, gt2 = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    for _ in range(epochs):
        gw, gt = -decay * len(coded) * w, -decay * len(coded) * t
        for rows, y in coded:
            n = len(rows)
            if not n:
                continue
            s = np.array([w[r].sum(axis=0) for r in rows])
            alpha, beta = np.empty((n, 2)), np.zeros((n, 2))
            alpha[0] = s[0]
            for i in range(1, n):
                alpha[i] = s[i] + np.logaddexp(alpha[i - 1, 0] + t[0], alpha[i - 1, 1] + t[1])
            for i in range(n - 2, -1, -1):
                m = s[i + 1] + beta[i + 1]
                beta[i] = np.logaddexp(t[:, 0] + m[0], t[:, 1] + m[1])
            z = np.logaddexp(*alpha[-1])
            marginal = np.exp(alpha + beta - z)
            for i, r in enumerate(rows):
                gw[r] -= marginal[i]
                gw[r, y[i]] += 1
            for i in range(1, n):
                gt -= np.exp(alpha[i - 1][:, None] + t + (s[i] + beta[i])[None, :] - z)
                gt[y[i - 1], y[i]] += 1
        gw2 += gw**2
        gt2 += gt**2
        w += rate * gw / np.sqrt(gw2)
        t += rate * gt / np.sqrt(gt2)
    return Field(names, w, t)


_ASIDES = (
    ('<nav class="{c}"><ul>{links}</ul></nav>', "links"), ('<div class="menu"><a href="/">{s}</a> <a href="/x">{s}</a></div>', ""), ('<div id="nav">{links}</div>', "links"),
    ("<header><h1>{s}</h1><p>{t}</p></header>", ""), ('<div class="header"><a href="/">{s}</a></div>', ""), ("<header><a href='/'>{s}</a>{links}</header>", "links"),
    ("<footer>&copy; 2020 {s} &middot; {t}</footer>", ""), ('<div class="footer"><p>{t}</p><a href="/p">{s}</a></div>', ""), ("<footer><p>{t}</p></footer>", ""),
    ("<aside><h3>{s}</h3><p>{t}</p></aside>", ""), ('<div class="sidebar"><h4>{s}</h4><ul>{links}</ul><p>{t}</p></div>', "links"), ('<section class="related"><h3>{s}</h3>{links}</section>', "links"),
    ('<div class="ad">{t}</div>', ""), ('<div class="advert"><a href="/ad">{t}</a></div>', ""), ('<p class="sponsored">{t}</p>', ""), ('<div id="ads"><p>{t}</p></div>', ""),
    ('<div class="cookie-notice"><p>{t}</p><button>{s}</button></div>', ""), ('<div role="alert">{t}</div>', ""), ('<div class="newsletter"><p>{t}</p><form><input><button>{s}</button></form></div>', ""), ('<div id="consent">{t} <a href="/c">{s}</a></div>', ""), ('<div class="notice"><p>{t}</p></div>', ""),
    ("<form><label>{s}</label><input name=q><button>{s}</button></form>", ""), ('<form action="/s"><p>{t}</p><label>{s}</label></form>', ""),
    ('<div class="comments"><h2>{s}</h2><div class="comment"><p>{t}</p><p>{t}</p></div><div class="comment"><p>{t}</p></div></div>', ""), ('<section id="comments"><h3>{s}</h3><ol><li><p>{t}</p></li><li><p>{t}</p></li></ol></section>', ""), ('<ul class="commentlist"><li>{t}</li><li>{t}</li></ul>', ""),
    ("<p hidden>{t}</p>", ""), ('<div aria-hidden="true">{t}</div>', ""), ('<div style="color:red; display:none"><p>{t}</p></div>', ""), ("<div>Copyright 2020 {s}</div>", ""), ("<div>{links}</div>", "links"),
    ('<div class="share"><a href="#">{s}</a> <a href="#">{s}</a></div>', ""), ('<ul class="breadcrumb"><li><a href="/">{s}</a></li><li>{s}</li></ul>', ""),
)
_MAINS = ("<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main">{}</div>', "<main><article>{}</article></main>", '<div class="post"><div class="entry">{}</div></div>', '<section class="story">{}</section>', "<div>{}</div>", '<div class="article-body">{}</div>', '<div class="">{}</div>', "<div><div>{}</div></div>", '<div class=""><div class=""><span class="">{}</span></div></div>')
_PARTS = ("<p>{t}</p>", "<p>{t}</p>", "<p>{t}</p>", "<p><b>{s}</b> {t}</p>", "<p><b>{t}<br>", "<p>{t}", "<h2>{s}</h2>", "<ul><li>{t}</li><li>{s}</li></ul>", "<ol><li>{s}</li><li>{t}</li></ol>", "<blockquote><p>{t}</p></blockquote>", '<p>{t} <a href="/r">{s}</a> {t}</p>', "<pre>{t}</pre>", "<table><tr><td>{s}</td><td>{t}</td></tr></table>", "<div>{t}</div>", "<figure><img><figcaption>{s}</figcaption></figure>", "<p>{s}</p>", "<p><em>{t}</em></p>", "<h3>{s}</h3>", "<dl><dt>{s}</dt><dd>{t}</dd></dl>", "<p>All rights reserved. {s}</p>", "<div><span>{t}</span></div>", '<div class=""><span class="">{t}</span></div>', '<p style="margin:0">{t}</p>', '<p aria-hidden="false">{t}</p>')
_MARK = ""


def labelled_pages(n: int = 400, seed: int = 4) -> list[tuple[list[list[str]], list[int]]]:
    """Labelled pages: layouts from templates, main text marked, marks taken out after cutting."""
    rnd = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzäéñç"
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 10)))
    short = lambda: " ".join(word() for _ in range(rnd.randrange(1, 8))).capitalize()

    def long() -> str:
        return " ".join(" ".join(word() for _ in range(rnd.randrange(1, 18))).capitalize() + rnd.choice(".....,?!") for _ in range(rnd.randrange(1, 7)))

    def menu() -> str:
        return "".join(rnd.choice(('<li><a href="/{0}">{0}</a></li>', '<a href="/{0}">{0}</a> ')).format(word()) for _ in range(rnd.randrange(2, 9)))

    def aside(inside: bool = False) -> str:
        # a header inside an article is its own
        shape = rnd.choice([s for s, _ in _ASIDES if not (inside and s.startswith("<header"))])
        links = menu()
        shape = re.sub("{t}", lambda _: long() if rnd.random() < 0.8 else short(), shape)
        return re.sub("{s}", lambda _: short(), shape).replace("{links}", links).replace("{c}", rnd.choice(("top", "menu", "nav")))

    def main() -> str:
        # marks stand on both sides of the text so that a block of it is known wherever it is cut
        mark = lambda text: _MARK + text + _MARK
        parts = [f"<h1>{mark(short())}</h1>"] if rnd.random() < 0.8 else []
        own = bool(parts) and rnd.random() < 0.15
        if own:
            parts[0] = f"<header>{parts[0]}</header>"
        for _ in range(rnd.randrange(1, 9)):
            shape = rnd.choice(_PARTS)
            shape = re.sub("{t}", lambda _: mark(long()), shape)
            parts.append(re.sub("{s}", lambda _: mark(short()), shape))
            if rnd.random() < 0.06:
                parts.append(aside(inside=True))
        return rnd.choice([m for m in _MAINS if not own or "<article>" in m]).format("".join(parts))

    out = []
    for _ in range(n):
        before, after = "".join(aside() for _ in range(rnd.randrange(0, 4))), "".join(aside() for _ in range(rnd.randrange(0, 4)))
        middle = main()
        if rnd.random() < 0.08:
            middle = f"<table><tr><td>{menu()}</td><td>{middle}</td></tr><tr><td>{rnd.choice(('&copy; ', 'Copyright ', ''))}{short()} <a href='/i'>{word()}</a></td></tr></table>"
        cut = blocks(f"<html><head><title>{short()}</title><style>p{{}}</style></head><body>{before}{middle}{after}</body></html>"[: None if rnd.random() < 0.8 else -14])
        labels = [int(_MARK in b.text) for b in cut]
        for b in cut:
            b.text = b.text.replace(_MARK, "").strip() or "-"
        out.append((features(cut), labels))
    return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    return fit(labelled_pages())


def main_text(page: str | None, field: Field) -> str:
    cut = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(cut, field.decode(features(cut)), strict=True) if keep)


def extract(pages: DataFrame, html: str = "html", output: str = "text", field: Field | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add the main text of every page: a narrow map, the small field sent along."""
    spark = pages.sparkSession
    ship(spark)
    kept = [c for c in (pages.columns if keep is None else keep) if c != output]
    shared = spark.sparkContext.broadcast(field or default_field())
    schema = ", ".join(f"k{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)) + ", t string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                texts = pa.array([main_text(x, shared.value) for x in batch.column(len(kept)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + [texts], names=[f"k{i}" for i in range(len(kept))] + ["t"])

    mapped = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{html}`").alias("h")).mapInArrow(released(run), schema)
    return mapped.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], F.col("t").alias(output))
