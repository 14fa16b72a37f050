"""A small document tree and CSS selector over the standard library's parser."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "items")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []

    @property
    def children(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def strings(self) -> Iterator[str]:
        """Trimmed texts below that are not empty; an element's own scripts and styles
        count only when asked of themselves."""
        stack: list[Node | str] = list(reversed(self.items))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                if x.strip():
                    yield x.strip()
            elif x.tag not in ("script", "style", "template"):
                stack.extend(reversed(x.items))

    def text(self) -> str:
        return squeeze(" ".join(self.strings()))

    def select(self, selector: str) -> list[Node]:
        """Elements below that match, in document order."""
        wanted = parse_selector(selector)
        return [n for n in self.walk() if any(_matches(n, s) for s in wanted)]

    def first(self, selector: str) -> Node | None:
        wanted = parse_selector(selector)
        return next((n for n in self.walk() if any(_matches(n, s) for s in wanted)), None)

    def following(self) -> list[Node]:
        """Later elements under the same parent."""
        if self.parent is None:
            return []
        around = self.parent.children
        return around[next(i for i, n in enumerate(around) if n is self) + 1 :]


def squeeze(text: str | None) -> str:
    return _SPACE.sub(" ", text or "").strip()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.items.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.items.append(data)


def parse(page: str) -> Node:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


# -- selectors: tag, .class, #id, [a], [a=v], [a^=v]; descendant, >, +; comma lists

_SIMPLE = re.compile(r"""([\w-]+|\*)|\.([\w-]+)|\#([\w-]+)|\[([\w-]+)(?:(\^?=)['"]?([^'"\]]*)['"]?)?\]""")


@functools.lru_cache(512)
def parse_selector(selector: str) -> tuple:
    out = []
    for part in selector.split(","):
        steps, link = [], " "
        for word in re.findall(r"[>+]|(?:\[[^\]]*\]|[^\s>+\[])+", part):
            if word in (">", "+"):
                link = word
                continue
            tests = tuple(m.groups() for m in _SIMPLE.finditer(word))
            steps.append((link, tests))
            link = " "
        out.append(tuple(steps))
    return tuple(out)


def _fits(node: Node, tests: tuple) -> bool:
    for tag, cls, ident, attr, op, value in tests:
        if tag and tag not in ("*", node.tag):
            return False
        if cls and cls not in node.classes:
            return False
        if ident and node.attrs.get("id") != ident:
            return False
        if attr and (attr not in node.attrs or op == "=" and node.attrs[attr] != value or op == "^=" and not node.attrs[attr].startswith(value)):
            return False
    return True


def _matches(node: Node, steps: tuple) -> bool:
    link, tests = steps[-1]
    if not _fits(node, tests):
        return False
    if len(steps) == 1:
        return True
    if link == "+":
        around = node.parent.children if node.parent else []
        at = next(i for i, n in enumerate(around) if n is node)
        return at > 0 and _matches(around[at - 1], steps[:-1])
    up = node.parent
    while up is not None and up.parent is not None:
        if _matches(up, steps[:-1]):
            return True
        if link == ">":
            return False
        up = up.parent
    return False
