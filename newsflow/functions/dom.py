"""A small document tree with class, tag and attribute selectors, for use inside Arrow functions only.

A selector is a comma list of chains; a chain is compounds in descendant order, a compound is `tag.class[attribute='value']`.
Unclosed paragraphs, items, cells and options end where HTML ends them; end tags without a start are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Starts that end an open paragraph.
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Starts that end an open element of the listed names, searched up to the barrier.
SIBLINGS = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
HIDDEN = frozenset(("script", "style", "template"))
COMPOUND = re.compile(r"\[\s*([\w:-]+)\s*(?:=\s*['\"]?([^'\"\]]*)['\"]?\s*)?\]|\.([\w-]+)|([\w-]+)")
CHAIN = re.compile(r"(?:\[[^\]]*\]|[^\s\[])+")


class Node:
    __slots__ = ("attributes", "children", "classes", "name", "parent")

    def __init__(self, name: str, attributes: dict[str, str], parent: Node | None):
        self.name, self.attributes, self.parent = name, attributes, parent
        self.classes = attributes.get("class", "").split()
        self.children: list[Node | str] = []

    def get(self, name: str) -> str:
        return self.attributes.get(name, "")

    def nodes(self) -> Iterator[Node]:
        """All elements below, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        """The texts below, white space collapsed; scripts and styles have none."""
        words, todo = [], [self]
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                words += item.split()
            elif item is self or item.name not in HIDDEN:
                todo.extend(reversed(item.children))
        return " ".join(words)

    def parents(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def select(self, selector: str) -> Iterator[Node]:
        chains = compiled(selector)
        return (n for n in self.nodes() if any(n.matches(chain) for chain in chains))

    def first(self, selector: str) -> Node | None:
        return next(self.select(selector), None)

    def matches(self, chain: tuple) -> bool:
        if not self.fits(chain[-1]):
            return False
        left = len(chain) - 2
        for above in self.parents() if left >= 0 else ():
            if above.fits(chain[left]):
                left -= 1
                if left < 0:
                    break
        return left < 0

    def fits(self, compound: tuple) -> bool:
        tag, classes, attributes = compound
        return (not tag or tag == self.name) and all(c in self.classes for c in classes) and all(k in self.attributes and (v is None or self.attributes[k] == v) for k, v in attributes)


@lru_cache(256)
def compiled(selector: str) -> list[tuple]:
    chains = []
    for part in selector.split(","):
        chain = []
        for compound in CHAIN.findall(part):
            tag, classes, attributes = "", [], []
            for key, value, name, element in ((m[1], m[2], m[3], m[4]) for m in COMPOUND.finditer(compound)):
                if key:
                    attributes.append((key, value))
                elif name:
                    classes.append(name)
                else:
                    tag = element
            chain.append((tag, tuple(classes), tuple(attributes)))
        chains.append(tuple(chain))
    return chains


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.top = Node("", {}, None)

    def _leave(self, names: tuple[str, ...], barrier: tuple[str, ...]) -> None:
        node = self.top
        while node.parent is not None and node.name not in barrier:
            if node.name in names:
                self.top = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._leave(("p",), ("td", "th", "table", "button"))
        if tag in SIBLINGS:
            self._leave(*SIBLINGS[tag])
        attributes: dict[str, str] = {}
        for key, value in attrs:
            attributes.setdefault(key, value or "")
        node = Node(tag, attributes, self.top)
        self.top.children.append(node)
        if tag not in VOID:
            self.top = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.top.name == tag:
            self.top = self.top.parent

    def handle_endtag(self, tag):
        self._leave((tag,), ())

    def handle_data(self, data):
        self.top.children.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; NULL and empty pages have an empty root."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
