"""A tolerant document tree for stored pages and feeds, and a matcher for CSS selectors.

Helpers of the page jobs: small, per page, without Spark.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

# --- fixed values: elements without content, and elements whose start ends an open paragraph
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: What a start tag closes, and the elements beyond which it does not look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
#: Inline elements whose end tag never closes a block.
INLINE = frozenset("a abbr b code em font i small span strong sub sup u".split())


class Node:
    """An element; children are elements and strings."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def descendants(self) -> Iterator[Node]:
        """Elements below, in document order; without recursion, as pages may nest deeply."""
        todo = self.elements()[::-1]
        while todo:
            node = todo.pop()
            yield node
            todo += node.elements()[::-1]

    def text(self) -> str:
        parts, todo = [], self.children[::-1]
        while todo:
            one = todo.pop()
            if isinstance(one, str):
                parts.append(one)
            else:
                todo += one.children[::-1]
        return "".join(parts)


class _Builder(HTMLParser):
    def __init__(self, xml: bool):
        super().__init__(convert_charrefs=True)
        self.xml, self.root = xml, Node("", {}, None)
        self.open = [self.root]

    def _close(self, tags: set[str], until: set[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return
            if self.open[k].tag in until:
                return

    def handle_starttag(self, tag, attrs):
        if not self.xml:
            if tag in ENDS_P:
                self._close({"p"}, {"table", "td", "th", "caption", "button"})
            if tag in CLOSES:
                self._close(*CLOSES[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1])  # the first of repeated attributes counts
        self.open[-1].children.append(node)
        if self.xml or tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.xml:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if not self.xml and tag in INLINE and self.open[k].tag not in INLINE:
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.open[-1].children.append(data[6:])


def parsed(body: str | None, xml: bool = False) -> Node:
    """The tree of a page, or of an XML document with ``xml``; a null body is empty."""
    builder = _Builder(xml)
    builder.feed(body or "")
    builder.close()
    return builder.root


# One step of a selector: tests of one element, and the sign that joins it to the step on its left.
_Test = Callable[[Node], bool]
_TOKEN = re.compile(r"""\s*([>+~,])\s*|(\s+)|([*]|[A-Za-z_][\w|-]*)|\.([\w-]+)|\#([\w-]+)|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]|:(first-child|last-child|nth-child\((\d+)\)|not\(([^()]*)\))""")


def _named(tag: str) -> _Test:
    return lambda n: n.tag == tag


def _with_class(name: str) -> _Test:
    return lambda n: name in n.attrs.get("class", "").split()


def _attribute(name: str, sign: str, value: str) -> _Test:
    compare = {
        "=": lambda v: v == value, "~=": lambda v: value in v.split(), "^=": lambda v: bool(value) and v.startswith(value), "$=": lambda v: bool(value) and v.endswith(value),
        "*=": lambda v: bool(value) and value in v, "|=": lambda v: v == value or v.startswith(value + "-"), "": lambda v: True,
    }[sign]
    return lambda n: name in n.attrs and compare(n.attrs[name])


def _place(node: Node) -> int:
    return 1 + node.parent.elements().index(node)


@lru_cache(maxsize=512)
def compiled(selector: str) -> tuple[tuple[tuple[str, tuple[_Test, ...]], ...], ...]:
    """The alternatives of a selector, each a chain of steps (sign to its left, tests) from left to right.

    Tags, ``*``, classes, ids, attribute tests, ``:first-child``, ``:last-child``, ``:nth-child(n)``, ``:not(...)`` of
    one step, the signs of descendants, children and siblings, and lists. Anything else is an error. A
    backslash before a colon makes it part of a tag's name.
    """
    chains: list[tuple] = []
    chain: list[tuple[str, tuple[_Test, ...]]] = []
    sign, tests, at, text = "", [], 0, selector.strip().replace("\\:", "|")
    if not text:
        raise ValueError("an empty selector")

    def step() -> None:
        nonlocal tests
        if not tests:
            raise ValueError(f"not a selector: {selector}")
        chain.append((sign, tuple(tests)))
        tests = []

    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None or m.end() == at:
            raise ValueError(f"not a selector: {selector}")
        at = m.end()
        joint, space, tag, class_, id_, name, compare, *values, pseudo, nth, inner = m.groups()
        if joint == ",":
            step()
            chains.append(tuple(chain))
            chain, sign = [], ""
        elif joint or space:
            step()
            sign = joint or " "
        elif tag:
            tests.append((lambda n: True) if tag == "*" else _named(tag.replace("|", ":").lower()))
        elif class_:
            tests.append(_with_class(class_))
        elif id_:
            tests.append(_attribute("id", "=", id_))
        elif name:
            tests.append(_attribute(name.lower(), compare or "", next((v for v in values if v is not None), "")))
        elif nth:
            tests.append(lambda n, k=int(nth): _place(n) == k)
        elif pseudo == "first-child":
            tests.append(lambda n: _place(n) == 1)
        elif pseudo == "last-child":
            tests.append(lambda n: n.parent.elements()[-1] is n)
        elif inner is not None:
            (((_, out),),) = compiled(inner)
            tests.append(lambda n, out=out: not all(t(n) for t in out))
        else:
            raise ValueError(f"not a selector: {selector}")
    step()
    return (*chains, tuple(chain))


def _left(node: Node, sign: str) -> Iterator[Node]:
    """The elements that may stand for the step to the left of ``sign``."""
    if sign == ">":
        if node.parent.parent:
            yield node.parent
    elif sign == " ":
        while node.parent.parent:
            node = node.parent
            yield node
    else:
        before = node.parent.elements()
        before = before[: next(k for k, n in enumerate(before) if n is node)]
        yield from before[-1:] if sign == "+" else before


def _fits(node: Node, chain: tuple, last: int) -> bool:
    sign, tests = chain[last]
    return all(t(node) for t in tests) and (last == 0 or any(_fits(n, chain, last - 1) for n in _left(node, sign)))


def matches(node: Node, selector: str) -> bool:
    return any(_fits(node, chain, len(chain) - 1) for chain in compiled(selector))


def select(root: Node, selector: str) -> Iterator[Node]:
    """The elements below ``root`` that a selector matches, in document order."""
    return (n for n in root.descendants() if matches(n, selector))


def first(root: Node, selector: str | None) -> Node | None:
    return next(select(root, selector), None) if selector else None


def drop(root: Node, selector: str) -> None:
    """Takes matching elements out of the tree."""
    for node in list(select(root, selector)):
        node.parent.children = [c for c in node.parent.children if c is not node]
