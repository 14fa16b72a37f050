"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of tokens: words score above zero, tags below.  The weights
are learnt from labelled pages, by logistic regression on what stands around a word: the
names of the elements that it is in and the words of their class, id and role.

* A word scores the log odds that a word in its place is content, ``FAINT`` at least.
* A tag costs ``TAG`` and, as far as its own name and class speak against content, more.

A linear scan finds the contiguous region of greatest sum.  It is widened to the element
around it if that adds few words, or if the element's own weight speaks for content: a
last short paragraph belongs to the rest.  Inside the region the same scores decide on
parts: an element that holds a block of text and sums up to less than zero (a menu, an
advert, comments of readers within the article) is left out.  What can be no text by the
rules of HTML (scripts, styles, hidden elements, controls) is never read.

A name tells something only of words that it sets apart from others.  So names of elements
that hold almost all words of a page (``ALL``: the body, a wrapper, the one form of some
sites) count for nothing.  If then no word is likelier content than not, names of elements
that hold a large share count for nothing either (``SHARES``, one after another), and the
best region is taken if it holds a sentence outside links.  Elements that can be no article
(``APART``) keep their weight.  Nor do the names of elements around the best region's
best words speak against the other words in them.

The labelled pages are made by ``labelled_pages`` with random words in many layouts, so
the label of each word is known; weights are fitted once a process, on the driver.

Text: character references decoded, white space within a block made one space,
trimmed, blocks joined by a line feed in page order.  Nothing else is dropped.

Defined cases: a null or empty page gives the empty text; a page without markup
is one block of content; unclosed and stray tags are taken as they come; a page with
markup whose best region holds no word that is likelier content than not gives the empty
text; rows may repeat; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import functools
import html
import itertools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

EXTRACTED = "page_id bigint, url string, text string"
#: Elements that begin and end a block of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript iframe template xmp svg".split())
#: Elements that HTML does not show as text.
UNSEEN = frozenset("head select object canvas audio video".split()) | RAW
#: Least score of a word, cost of a tag, and the most that a word or a tag counts.
FAINT, TAG, MOST, MOST_TAG = 0.01, 0.1, 4.0, 12.0
#: Share of a region's words that widening it may add.
FEW = 0.2
#: Shares of a page's words at which an element's names tell nothing: always, and where no
#: content is found; the element names that tell something even then; words of a sentence.
ALL, SHARES, SENTENCE = 0.98, (0.8, 0.5, 0.3), 6
APART = frozenset("<nav <footer <aside <dialog <header <button <label <ins".split())

# a tag that is not closed ends before the next one, so no part of a page is read twice
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/)?(?P<name>[A-Za-z][A-Za-z0-9:-]*+)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^<>\"']|[\"'])*+)(?:>|\Z|(?=<))",
    re.S,
)
_ATTR = re.compile(r"""([A-Za-z_:][-A-Za-z0-9_:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[a-z]+")
#: HTML's white space and the no-break space.
_SPACE = re.compile("[ \t\n\r\f\v\xa0]+")


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTR.finditer(source)} if source.strip(" /") else {}


def unseen(name: str, attrs: dict[str, str]) -> bool:
    """Whether HTML shows nothing of an element."""
    if name in UNSEEN:
        return True
    return bool(attrs) and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")) is not None)


def features(name: str, source: str) -> tuple[str, ...]:
    """What an element tells of the words in it: its name, and the words of its class, id
    and role, a plural like its singular."""
    return _remembered(name, source) if len(source) < 400 else _features(name, source)


def _features(name: str, source: str) -> tuple[str, ...]:
    attrs = attributes(source)
    found = {f"<{name}"}
    for k in ("class", "id", "role", "itemprop"):
        value = re.sub(r"([a-z])([A-Z])", r"\1 \2", attrs.get(k, ""))
        found.update(w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in _PART.findall(value.lower()))
    return tuple(sorted(found))


_remembered = functools.lru_cache(50_000)(_features)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) with kind "open", "close" or "text"."""
    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["close"]:
            yield "close", name, ""
            continue
        yield "open", name, m["attrs"] or ""
        if name in RAW and not (m["attrs"] or "").rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?![a-z0-9])[^<>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            yield "close", name, ""


@dataclass
class Piece:
    """A tag, or a text with its block; ``score`` is what the scan adds up, ``odds`` the log
    odds that a word here is content, ``words`` their number."""

    name: str
    text: str
    block: int
    score: float = 0.0
    odds: float = 0.0
    words: int = 0
    around: tuple[str, ...] = ()


def count_words(text: str) -> int:
    """Words, or for scripts that write without spaces a dozen letters each."""
    return max(len(text.split()), len(text.strip()) // 12)


@dataclass
class Element:
    """An element that HTML shows: its first piece and the last one (exclusive), what it
    tells of its words, and the weight of that."""

    name: str
    first: int
    last: int
    own: tuple[str, ...]
    weight: float = 0.0


@dataclass
class Page:
    """The pieces of a page that HTML shows, its elements, and both in order: an element's
    beginning (its number), its end (the number's complement), or a piece (None)."""

    pieces: list[Piece]
    elements: list[Element]
    events: list[int | None]

    def muted(self, share: float) -> set[int]:
        """Elements that hold at least so much of the page's words."""
        sums = [0]
        for p in self.pieces:
            sums.append(sums[-1] + p.words)
        return {i for i, e in enumerate(self.elements) if sums[min(e.last, len(self.pieces))] - sums[e.first] >= share * sums[-1]}

    def score(self, w: dict[str, float] | None, share: float = ALL, around: int = -1) -> None:
        """Scores of pieces by the weights ``w``, without: the features around each text.
        Names of elements that hold ``share`` of all words do not count, nor do those that
        speak against content of elements with the piece ``around``."""
        quiet, held, at = self.muted(share), {}, 0
        quiet |= {i for i, e in enumerate(self.elements) if e.first <= around < e.last and e.weight < 0}
        odds = w.get("", 0.0) if w else 0.0
        for event in self.events:
            if event is None:
                p = self.pieces[at]
                at += 1
                p.odds, p.around = odds, () if w else tuple(f for f, k in held.items() if k)
                p.score = p.words * max(FAINT, min(MOST, odds)) if p.words else 0.0
                continue
            i = event if event >= 0 else ~event
            e, step = self.elements[i], 1 if event >= 0 else -1
            for f in e.own:
                if i in quiet and f not in APART:
                    continue
                before = held.get(f, 0)
                held[f] = before + step
                if w and (before == 0 or held[f] == 0):
                    odds += step * w.get(f, 0.0)
            if event >= 0:
                e.weight = sum(w.get(f, 0.0) for f in e.own if i not in quiet or f in APART) if w else 0.0
        for e in self.elements:
            cost = -min(MOST_TAG, TAG + max(0.0, -e.weight))
            for k in (e.first, e.last - 1):
                if k < len(self.pieces) and self.pieces[k].name in (f"<{e.name}", f"</{e.name}"):
                    self.pieces[k].score = cost
        for p in self.pieces:
            if p.name and not p.score:
                p.score = -TAG


def read(page: str) -> Page:
    out: list[Piece] = []
    elements: list[Element] = []
    events: list[int | None] = []
    stack: list[tuple[str, bool, int]] = []
    open_names: dict[str, int] = {}
    hidden = block = 0

    def put(piece: Piece) -> None:
        out.append(piece)
        events.append(None)

    def leave(closed: bool) -> str:
        nonlocal hidden
        name, bad, i = stack.pop()
        open_names[name] -= 1
        hidden -= bad
        if closed and not hidden:
            put(Piece(f"</{name}", "", block))
        elements[i].last = len(out)
        events.append(~i)
        return name

    for kind, value, source in tokens(page):
        if kind == "text":
            if not hidden:
                put(Piece("", value, block, words=count_words(value)))
            continue
        block += value in BLOCKS
        if kind == "open":
            bad = unseen(value, attributes(source)) if source or value in UNSEEN else False
            elements.append(Element(value, len(out), len(out), features(value, source)))
            events.append(len(elements) - 1)
            if not hidden:
                put(Piece(f"<{value}", "", block))
            if value in VOID:
                elements[-1].last = len(out)
                events.append(~(len(elements) - 1))
            else:
                stack.append((value, bad, len(elements) - 1))
                open_names[value] = open_names.get(value, 0) + 1
                hidden += bad
        elif open_names.get(value):
            while leave(stack[-1][0] == value) != value:
                pass
    while stack:
        leave(False)
    return Page(out, elements, events)


def pieces(page: str, w: dict[str, float] | None) -> tuple[list[Piece], list[Element]]:
    """The pieces and elements of a page, scored."""
    found = read(page)
    found.score(w)
    return found.pieces, found.elements


# -- weights

# What the labelled pages are made of: words of classes for parts that are no content, and
# for the content itself.
NOISE = {
    "menu": ("nav ul div section", "menu nav navbar navigation breadcrumb pager pagination toolbar tab skip topbar masthead"),
    "head": ("header div section", "header masthead banner brand logo site topbar"),
    "foot": ("footer div section", "footer copyright legal colophon credits imprint bottom"),
    "side": ("aside div section td", "sidebar side rail widget aside related recommended popular trending latest teaser promo more"),
    "advert": ("div aside section ins", "ad ads advert advertisement advertising sponsor sponsored promoted promotion banner partner affiliate"),
    "notice": ("div section aside dialog", "cookie consent notice gdpr alert popup modal paywall privacy overlay toast"),
    "form": ("form div section", "form newsletter subscribe search login signup register contact field label"),
    "talk": ("div section ol ul aside", "comment comments commentlist reply replies respond response disqus discussion feedback reader thread reaction"),
    "share": ("div ul section p", "share sharing social follow like tweet print tool action"),
    "meta": ("div p ul footer", "byline meta tag author date category posted permalink"),
}
#: Names that sections of an article bear as well as other parts do.
EITHER = "intro summary chapter note search result label field tool action contact author date category tag legal credits privacy"
CONTENT = ("article main div section td", "article content entry post story text body main page prose copy")
PLAIN = "site page post entry story main top box block inner wrap container col row item list body content js".split()


def _names(rng: random.Random, own: str, plain: float) -> str:
    """A class attribute of some of the words, or none."""
    if rng.random() < plain:
        return ""
    words = [rng.choice(own.split())] + [rng.choice(PLAIN)] * (rng.random() < 0.4)
    rng.shuffle(words)
    extra = " " + rng.choice(PLAIN) if rng.random() < 0.2 else ""
    return f' {rng.choice(["class", "class", "id"])}="{rng.choice("-_ ").join(words)}{extra}"'


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[str, set[str]]]:
    """Pages with their content words.  Content words begin with "c", all others
    with "b", so the label of each word is known."""
    rng = random.Random(seed)
    says = lambda letter, lo, hi: " ".join(letter + "".join(rng.choices("aeioulnrst", k=rng.randint(1, 8))) for _ in range(rng.randint(lo, hi)))
    link = lambda letter, lo=1, hi=4: f'<a href="/{rng.randint(1, 99)}">{says(letter, lo, hi)}</a>'

    def noise(kind: str) -> str:
        tags, own = NOISE[kind]
        tag = rng.choice(tags.split())
        telling = tag in ("nav", "header", "footer", "aside", "form", "dialog", "ins")
        inner = {
            "menu": lambda: "".join(f"<li>{link('b')}</li>" for _ in range(rng.randint(3, 12))),
            "head": lambda: rng.choice([f"<h2>{says('b', 1, 4)}</h2>", f"<p>{says('b', 2, 8)}</p>", link("b")]),
            "foot": lambda: rng.choice([says("b", 3, 20), f"<p>{says('b', 3, 40)}</p>{link('b')} {link('b')}"]),
            "side": lambda: rng.choice(["".join(f"<li>{link('b', 2, 8)}</li>" for _ in range(rng.randint(2, 6))), f"<h3>{says('b', 1, 3)}</h3><p>{says('b', 3, 30)}</p>", f"<h4>{link('b', 2, 7)}</h4>" * 3]),
            "advert": lambda: rng.choice([says("b", 3, 15), f"<p>{says('b', 3, 25)}</p>", link("b", 2, 8)]),
            "notice": lambda: f"<p>{says('b', 4, 40)}</p><button>{says('b', 1, 2)}</button>",
            "form": lambda: f"<label>{says('b', 1, 4)}</label><input name=q><p>{says('b', 2, 12)}</p><button>{says('b', 1, 2)}</button>",
            "talk": lambda: "".join(f'<{e}{_names(rng, own, 0.5)}><b>{says("b", 1, 2)}</b><p>{says("b", 3, 60)}</p></{e}>' for e in rng.choices(["div", "li", "article"], k=rng.randint(1, 5))),
            "share": lambda: "".join(link("b", 1, 2) for _ in range(rng.randint(2, 5))),
            "meta": lambda: rng.choice([says("b", 2, 8), f"{says('b', 1, 3)} {link('b')} {link('b')}"]),
        }[kind]()
        if tag in ("ul", "ol") and "<li" not in inner:
            inner = f"<li>{inner}</li>"
        return f"<{tag}{_names(rng, own, 0.4 if telling else 0.0)}>{inner}</{tag}>"

    def section() -> str:
        tag = rng.choice(["section", "section", "div"])
        return f"<{tag}{_names(rng, CONTENT[1] if rng.random() < 0.3 else EITHER, 0.2)}>" + "".join(f"<p>{says('c', 8, 120)}</p>" for _ in range(rng.randint(1, 4))) + f"</{tag}>"

    def text_block() -> str:
        kind = rng.random()
        if kind < 0.66:
            some = says("c", 3, 80)
            return f"<p>{some} {link('c')} {says('c', 1, 20)}</p>" if rng.random() < 0.25 else f"<p><b>{some}</b></p>" if rng.random() < 0.1 else f"<p>{some}</p>"
        if kind < 0.76:
            return f"<{(e := rng.choice(['ul', 'ol']))}>" + "".join(f"<li>{says('c', 2, 14)}</li>" if rng.random() < 0.8 else f"<li>{link('c')} {says('c', 1, 9)}</li>" for _ in range(rng.randint(2, 5))) + f"</{e}>"
        if kind < 0.86:
            return section()
        return rng.choice([f"<h2>{says('c', 1, 6)}</h2>", f"<blockquote><p>{says('c', 4, 30)}</p></blockquote>", f"<pre>{says('c', 3, 20)}</pre>", f"<table><tr><td>{says('c', 1, 3)}</td><td>{says('c', 1, 3)}</td></tr></table>", f"<figure><figcaption>{says('c', 3, 12)}</figcaption></figure>", section()])

    out = []
    for _ in range(n):
        title = f"<h1>{says('c', 2, 8)}</h1>"
        if rng.random() < 0.25:
            title = f"<header{_names(rng, CONTENT[1] + ' header', 0.6)}>{title}{rng.choice(['', f'<p>{says("c", 3, 20)}</p>'])}</header>"
        parts = [title] + [text_block() for _ in range(rng.randint(1, 12))]
        for kind in rng.sample(["advert", "share", "side", "talk", "notice", "form", "meta", "foot"], rng.choice([0, 0, 1, 2])):
            parts.insert(rng.randint(1, len(parts)), noise(kind))
        body = "".join(parts)
        if rng.random() < 0.08:  # a fragment
            page = rng.choice([says("c", 1, 60), "".join(text_block() for _ in range(rng.randint(1, 4)))])
        else:
            wrap = rng.choice(CONTENT[0].split())
            body = body if rng.random() < 0.1 else f"<{wrap}{_names(rng, CONTENT[1], 0.4)}>{body}</{wrap}>"
            if rng.random() < 0.3:
                body = f"<div{_names(rng, ' '.join(PLAIN), 0.4)}>{body}{noise('side') if rng.random() < 0.5 else ''}</div>"
            before = "".join(noise(k) for k in rng.sample(["head", "menu", "notice", "advert", "form", "share"], rng.randint(1, 4)))
            after = "".join(noise(k) for k in rng.sample(["side", "foot", "talk", "form", "advert", "menu"], rng.randint(1, 4)))
            page = f"<html><head><title>{says('b', 2, 6)}</title></head><body{_names(rng, 'home single page ' + ' '.join(PLAIN), 0.7)}>{before}{body}{after}</body></html>"
        out.append((page, set(re.findall(r"\bc[aeioulnrst]+", re.sub(r"<[^>]*>", " ", page)))))
    return out


def fit_weights(pages: list[tuple[str, set[str]]], ridge: float = 1.0, rounds: int = 12) -> dict[str, float]:
    """Weight of each feature, and of "" for every word, by logistic regression; a text
    counts as often as the square root of its words, so that long ones do not decide all."""
    rows, labels, counts = [], [], []
    for page, content in pages:
        for p in pieces(page, None)[0]:
            if p.words:
                words = p.text.split()
                rows.append(p.around)
                labels.append(sum(x in content for x in words) / len(words))
                counts.append(len(words) ** 0.5)
    names = sorted({f for r in rows for f in r})
    place = {f: i + 1 for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, 0] = 1
    for i, r in enumerate(rows):
        x[i, [place[f] for f in r]] = 1
    y, c, b = np.array(labels), np.array(counts), np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (c * (p - y)) + ridge * b
        b -= np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), slope)
    return {"": float(b[0])} | {f: float(v) for f, v in zip(names, b[1:], strict=True)}


@functools.cache
def weights() -> dict[str, float]:
    return fit_weights(labelled_pages())


# -- the scan


def region(scores: list[float]) -> tuple[int, int]:
    """First and last piece (exclusive) of the greatest sum; of equal sums the
    first and longest."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        total += s
        if total <= 0:
            total, start = 0.0, i + 1
        elif total >= best:
            best, span = total, (start, i + 1)
    return span


def left_out(found: list[Piece], elements: list[Element], core: int) -> list[bool]:
    """Which pieces are in an element of blocks that sums up to less than zero; those around
    the core of the region stay."""
    sums, depth = [0.0], [0] * (len(found) + 1)
    for p in found:
        sums.append(sums[-1] + p.score)
    for e in elements:
        if e.name in BLOCKS and not e.first <= core < e.last and sums[e.last] - sums[e.first] < 0:
            depth[e.first] += 1
            depth[e.last] -= 1
    return [d > 0 for d in itertools.accumulate(depth[:-1])]


def widened(found: list[Piece], elements: list[Element], span: tuple[int, int], gone: list[bool]) -> tuple[int, int]:
    """The smallest element around the region, where its own weight speaks for content or
    it would add few words."""
    lo, hi = span
    e = min((e for e in elements if e.first <= lo and e.last >= hi), key=lambda e: e.last - e.first, default=None)
    if e is None:
        return span
    words = lambda a, b: sum(p.words for p, out in zip(found[a:b], gone[a:b], strict=True) if not out)
    inside = words(lo, hi)
    return (e.first, e.last) if e.weight > 0.5 or words(e.first, e.last) - inside <= FEW * inside else span


def linked(page: Page) -> list[bool]:
    """Which pieces stand in links."""
    out, depth = [], 0
    for event in page.events:
        if event is None:
            out.append(depth > 0)
        elif page.elements[event if event >= 0 else ~event].name == "a":
            depth += 1 if event >= 0 else -1
    return out


def core_of(page: Page, w: dict[str, float]) -> tuple[int, int, int]:
    """The best region of a scored page and its best piece, -1 if no word is likelier content
    than not."""
    lo, hi = region([p.score for p in page.pieces])
    core = max(range(lo, hi), key=lambda i: page.pieces[i].score, default=-1)
    return lo, hi, core if core >= 0 and page.pieces[core].odds > 0 else -1


def main_text(page: str | None, w: dict[str, float] | None = None, scan: bool = True) -> str:
    """``scan`` off takes the whole page as region, which shows what the scan is for."""
    if not page:
        return ""
    w, whole, share = w or weights(), read(page), ALL
    whole.score(w)
    lo, hi, core = core_of(whole, w)
    for less in SHARES:
        if core >= 0:
            break
        whole.score(w, share := less)
        lo, hi, core = core_of(whole, w)
        if core >= 0 and (whole.pieces[core].words < SENTENCE or linked(whole)[core]):
            core = -1
    if core < 0:
        return ""
    if any(e.first <= core < e.last and e.weight < 0 for e in whole.elements):
        whole.score(w, share, core)
        lo, hi, core = core_of(whole, w)
    found, elements = whole.pieces, whole.elements
    gone = left_out(found, elements, core)
    lo, hi = widened(found, elements, (lo, hi), gone) if scan else (0, len(found))
    blocks: dict[int, list[str]] = {}
    for p, out in zip(found[lo:hi], gone[lo:hi], strict=True):
        if out:
            continue
        if p.text:
            blocks.setdefault(p.block, []).append(html.unescape(p.text))
        elif p.name == "<br":
            blocks.setdefault(p.block, []).append(" ")
    lines = (_SPACE.sub(" ", "".join(parts)).strip(" ") for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of each page."""
    small_batches(pages.sparkSession)
    w = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, w) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, EXTRACTED)
