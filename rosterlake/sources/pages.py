"""People on roster pages, details of profile pages, links to further pages.

A roster layout is data: which elements are rows, and by which selectors a row
shows a person's name, title, e-mail, link and profile text.  One interpreter
reads all layouts.  A page is read by one call, pages are spread over tasks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import parse_qs, urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame

from .dom import Node, parse, squeeze

ENTRY = "page_id bigint, position int, name string, normalized_name string, title string, email string, profile_url string, profile_text string, source_url string, source_snippet string"
PROFILE = "page_id bigint, title string, email string, profile_text string, source_url string, source_snippet string"
LINK = "page_id bigint, position int, url string"
TEXT_CHARS, SNIPPET_CHARS = 4000, 600
_EMAIL = re.compile(r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}")


def email_in(text: str | None) -> str | None:
    m = _EMAIL.search(text or "")
    return m[0].lower() if m else None


def plain_name(name: str) -> str:
    folded = "".join(c for c in unicodedata.normalize("NFKD", squeeze(name)) if not unicodedata.combining(c))
    return re.sub(r"[^A-Za-z0-9\s-]", "", folded).lower()


def shown(node: Node | None) -> str:
    return node.text() if node is not None else ""


def lines(node: Node) -> list[str]:
    return [squeeze(s) for s in node.strings()]


# -- ways to find a field in a row


def at(*selectors: str, strip: str = "") -> Callable[[Node], str]:
    """The text of the first selector that has one, a pattern cut from it."""

    def read(row: Node) -> str:
        value = next((t for t in (shown(row.first(s)) for s in selectors) if t), "")
        return re.sub(strip, "", value, flags=re.I) if strip else value

    return read


def line_with(selector: str | None, words: tuple[str, ...], skip: int = 0) -> Callable[[Node], str]:
    """The first line with one of some words, of a part of the row."""

    def read(row: Node) -> str:
        part = row.first(selector) if selector else row
        return next((t for t in (lines(part) if part else [])[skip:] if any(w in t.lower() for w in words)), "")

    return read


def line_number(selector: str, n: int) -> Callable[[Node], str]:
    def read(row: Node) -> str:
        part = row.first(selector)
        found = lines(part) if part is not None else []
        return found[n] if len(found) > n else ""

    return read


def first_of(*ways: Callable[[Node], str]) -> Callable[[Node], str]:
    return lambda row: next((t for t in (w(row) for w in ways) if t), "")


def labelled(label: str, value: str, *names: str) -> Callable[[Node], str]:
    """The value beside a label of one of some names."""

    def read(row: Node) -> str:
        found = {}
        tag, _, cls = value.partition(".")
        for node in row.select(label):
            mate = next((n for n in node.following() if n.tag == tag and cls in n.classes), None)
            key, text = shown(node).rstrip(":").lower(), shown(mate)
            if key and text:
                found[key] = text
        return next((found[n] for n in names if n in found), "")

    return read


def script_email(row: Node) -> str:
    """An address that a script puts together from a name and a domain."""
    for node in row.select("script"):
        code = " ".join(x for x in node.items if isinstance(x, str))
        parts = [re.search(rf'var\s+{k}\s*=\s*"([^"]+)"', code, re.I) for k in ("name", "domain")]
        if all(parts):
            return f"{parts[0][1]}@{parts[1][1]}"
    return ""


def link_at(*selectors: str, inside: bool = False) -> Callable[[Node], Node | None]:
    """The anchor at a selector, or the first one inside what is there."""

    def read(row: Node) -> Node | None:
        for s in selectors:
            node = row if s == "" else row.first(s)
            if node is not None:
                if node.tag == "a" and "href" in node.attrs:
                    return node
                return node.first("a[href]")
        return None

    return read


def web_link(row: Node) -> Node | None:
    return next((a for a in row.select("a[href]") if not a.attrs["href"].lower().startswith("mailto:")), None)


@dataclass(frozen=True)
class Layout:
    rows: str
    name: Callable[[Node], str]
    title: Callable[[Node], str] = lambda row: ""
    link: Callable[[Node], Node | None] = link_at("a[href]")
    email: Callable[[Node], str] | None = shown
    profile: Callable[[Node], str] = lambda row: ""
    wanted: Callable[[Node], bool] = field(default=lambda row: True)
    part: str = ""  # the cell of a row that all fields are read from


def _role_is_faculty(row: Node) -> bool:
    cells = row.select("td")
    return len(cells) >= 2 and (len(cells) < 3 or not shown(cells[2]) or "faculty" in shown(cells[2]).lower())


def _cell(n: int) -> Callable[[Node], str]:
    return lambda row: shown(cells[n]) if len(cells := row.select("td")) > n else ""


# Layouts by the name a source gives as hint; selectors are the sites'.
LAYOUTS: dict[str, list[Layout]] = {
    "mit_faculty_cards": [Layout(".card.faculty-card", at("h3"), at(".faculty-card__job-title"), link_at("h3 a"))],
    "mit_dmse_cards": [Layout(".faculty-teaser", at(".faculty-teaser__name"), at(".faculty-teaser__title"), link_at(""))],
    "stanford_hb_cards": [
        Layout(".hb-card.hb-vertical-card", at(".hb-card__title a, h2 a, h3 a"), first_of(at(".hb-card__description, .hb-card__title + div"), lambda row: next((t for t in map(shown, row.select(".field-content")) if "professor" in t.lower()), "")), link_at(".hb-card__title a, h2 a, h3 a")),
        Layout("article.su-card.su-card--minimal", at("h3 a, h2 a"), at(".su-person-short-title, .su-card__description"), link_at("h3 a, h2 a")),
        Layout(".views-row", at(".views-field-view-profile a, h2 a, h3 a"), at(".field-position, .su-person-short-title"), link_at(".views-field-view-profile a, h2 a, h3 a")),
    ],
    "berkeley_people_table": [
        Layout("table tr", _cell(0), _cell(1), link_at("td"), wanted=_role_is_faculty),
        Layout(".views-row", at("h2 a, h3 a"), at(".field-name-field-openberkeley-person-title .field-item"), link_at("h2 a, h3 a")),
    ],
    "caltech_people_listing": [Layout(".person-listing__person-row", at(".person-listing__summary__title"), at(".person-listing__summary__faculty-title"), link_at(".person-listing__person-row__wrapper-link"))],
    "princeton_content_list": [Layout(".content-list-item", at(".field--name-title a", ".field--name-title"), at(".field--name-field-ps-people-position .field__item", ".field--name-field-ps-people-position"), link_at(".field--name-title a"))],
    "penn_people_rows": [Layout(".views-row", at("h3 a[href]"), at("p.title .title"), link_at("h3 a[href]"), at(".email a"))],
    "ucla_faculty_table": [Layout("tr", at("h5"), line_number("p", 0), web_link, first_of(script_email, shown), part="td")],
    "umd_k2_faculty": [Layout(".catItemView.groupPrimary", at(".catItemTitle a[href]", ".catItemTitle"), labelled(".catItemExtraFieldsLabel", "span.catItemExtraFieldsValue", "title"), link_at(".catItemTitle a[href]"), labelled(".catItemExtraFieldsLabel", "span.catItemExtraFieldsValue", "e-mail", "email"))],
    "washington_views_rows": [Layout(".thin-top-border-gray.views-row", at(".views-field-title a[href], h3.field-content a[href]"), at(".views-field-field-job-title .field-content"), link_at(".views-field-title a[href], h3.field-content a[href]"), at(".views-field-field-email a[href^='mailto:']"), at(".views-field-term-node-tid"))],
    "gatech_people_grid": [Layout(".people ul.grid > li, .people .grid > li", at(".p-name a[href], h3 a[href]"), link=link_at(".p-name a[href], h3 a[href]"), email=None)],
    "northwestern_people_articles": [Layout("article.people", at("h3 a[href]", strip=r"\s*\([^)]*\)\s*$"), at("p.title"), link_at("h3 a[href]"), at("a[href^='mailto:']"))],
    "wisc_faculty_cards": [Layout(".faculty-member", at("a.faculty-name[href]"), at(".position-title", strip=r"^Position title:\s*"), link_at("a.faculty-name[href]"))],
    "uchicago_people_list": [Layout("li.mix.faculty", at(".people_img h5", ".people_content h3 span"), at(".people_content h3 b"), link_at("a[href]"))],
    "yale_people_table": [Layout("table.views-table tr", at("td.views-field-name a.username, td.views-field-name a[href]"), line_number("td.views-field-name", 1), link_at("td.views-field-name a.username, td.views-field-name a[href]"))],
    "ucsb_directory_rows": [Layout(".views-row", at(".group-second h3 a"), line_with(".group-second", ("professor", "lecturer"), skip=1), link_at(".group-second h3 a"), profile=at(".group-third"))],
}
# Elements that may be a person's card, tried in this order.
CARDS = [".person", ".faculty-card", ".faculty-teaser", ".hb-card", "article", ".views-row", "li"]
# Where profile pages show title and biography, in this order.
PROFILE_TITLES = [".field-position", ".su-person-short-title", ".field-name-field-openberkeley-person-title .field-item", ".faculty-card__job-title", ".faculty-teaser__title", ".field--name-field-title", ".person-title", ".gtppl-header-txt p"]
PROFILE_TEXTS = [".su-person-long-bio", ".su-person-short-bio", ".su-person-research-interests", ".field-name-field-research", ".field-name-body", ".field--name-body", ".person-bio", ".profile-bio", ".research", ".biography"]
NOISE = ["home people faculty", "contact info", "office phone", "assistant email", "assistant name", "assistant phone", "website/lab", "affiliated center", "primary impact", "research type"]
#: Layouts whose pages are not followed to further ones.
SINGLE_PAGE = {"princeton_content_list"}


def entry(url: str, name: str, title: str | None, email: str | None, link: Node | None, snippet: str, profile: str = "") -> dict | None:
    """A person, if the name has two words at least."""
    name = squeeze(name)
    if len(name.split()) < 2:
        return None
    return {
        "name": name,
        "normalized_name": plain_name(name),
        "title": squeeze(title) or None,
        "email": email_in(email),
        "profile_url": urljoin(url, link.attrs["href"]) if link is not None else None,
        "profile_text": squeeze(profile)[:TEXT_CHARS] or None,
        "source_url": url,
        "source_snippet": squeeze(snippet)[:SNIPPET_CHARS],
    }


def by_layout(root: Node, url: str, layout: Layout) -> Iterator[dict | None]:
    for row in root.select(layout.rows):
        row = row.first(layout.part) if layout.part else row
        if row is None or not layout.wanted(row):
            continue
        name = layout.name(row)
        if name:
            yield entry(url, name, layout.title(row), layout.email(row) if layout.email else None, layout.link(row), shown(row), layout.profile(row))


def by_cards(root: Node, url: str) -> list[dict]:
    """Cards that mention a professor and hold a link named like a person; the first
    kind of element that yields any decides."""
    for selector in CARDS:
        found = []
        for node in root.select(selector):
            whole, link = shown(node), node.first("a[href]")
            if "professor" not in whole.lower() or link is None:
                continue
            name = shown(link)
            title = next((t for t in lines(node) if "professor" in t.lower() and t != name), None)
            found.append(entry(url, name, title, whole, link, whole))
        if found := once(found, "normalized_name", "profile_url"):
            return found
    return []


def once(entries: list[dict | None], *keys: str) -> list[dict]:
    seen: dict[tuple, dict] = {}
    for e in entries:
        if e is not None:
            seen.setdefault(tuple(e[k] for k in keys), e)
    return list(seen.values())


def roster_entries(page: str, url: str, hint: str | None = None) -> list[dict]:
    root = parse(page)
    layouts = LAYOUTS.get(hint or "")
    found = [e for layout in layouts for e in by_layout(root, url, layout)] if layouts else by_cards(root, url)
    return once(found, "normalized_name", "profile_url", "source_url")


def _passages(nodes: list[Node]) -> list[str]:
    texts = dict.fromkeys(shown(n) for n in nodes)
    return [t for t in texts if len(t.split()) >= 8 and not any(w in t.lower() for w in NOISE)]


def profile_of(page: str, url: str) -> dict:
    root = parse(page)
    title = next((t for t in (shown(root.first(s)) for s in PROFILE_TITLES) if t), "") or next((t for t in lines(root) if "professor" in t.lower()), "")
    chunks = next((c for c in (_passages(root.select(s)) for s in PROFILE_TEXTS) if c), [])
    if not chunks:
        body = root.first("main") or root.first("article") or root.first("body")
        chunks = _passages(body.select("p, li")) if body is not None else []
    text, whole = squeeze(" ".join(chunks))[:TEXT_CHARS] or None, root.text()
    return {"title": title or None, "email": email_in(whole), "profile_text": text, "source_url": url, "source_snippet": title or text or whole[:SNIPPET_CHARS]}


def further_pages(page: str, url: str) -> list[str]:
    """Links to the same host and path with a page number, without fragments."""
    here, out = urlparse(url), {}
    for a in parse(page).select("a[href]"):
        target = urljoin(url, a.attrs["href"].split("#", 1)[0])
        there = urlparse(target)
        if (there.netloc, there.path) == (here.netloc, here.path) and "page" in parse_qs(there.query) and target != url:
            out.setdefault(target)
    return list(out)


def enrich(row: dict, page: str | None, url: str) -> dict:
    """An entry with what its profile page adds; the page counts only if it shows a
    title or an address."""
    if page is None or not row["profile_url"] or (row["title"] and row["email"]):
        return row
    more = profile_of(page, url)
    if not more["title"] and not more["email"]:
        return row
    out = row | {k: more[k] or row[k] for k in ("title", "email", "profile_text", "source_snippet")}
    return out | {"source_url": url if more["title"] else row["source_url"]}


# -- over tables of pages (page_id, url, html[, parser_hint])


def _each(pages: DataFrame, schema: str, read: Callable[[dict], list[dict]]) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"page_id": r["page_id"], "position": k} | e for r in batch.to_dict("records") for k, e in enumerate(read(r))]
            yield pd.DataFrame(rows, columns=columns)

    return pages.mapInPandas(run, schema)


def rosters(pages: DataFrame) -> DataFrame:
    return _each(pages, ENTRY, lambda r: roster_entries(r["html"] or "", r["url"] or "", r.get("parser_hint")))


def profiles(pages: DataFrame) -> DataFrame:
    return _each(pages, PROFILE, lambda r: [profile_of(r["html"] or "", r["url"] or "")])


def pagination(pages: DataFrame) -> DataFrame:
    return _each(pages, LINK, lambda r: [{"url": u} for u in further_pages(r["html"] or "", r["url"] or "")])
