"""A page as a tree of nodes, found by simple selectors. Broken markup is taken as it comes: an end tag closes the nearest
open element of its name and all inside it, one without such an element is passed over, what is left open ends with the page.
Elements deeper than DEPTH stand beside each other at that depth, as browsers have it, which bounds the cost of any page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

#: Fixed value: elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: The most elements that are open at a time.
DEPTH = 512
#: Elements whose text is not text of the page.
HIDDEN = frozenset(("script", "style", "template"))

_STEP = re.compile(r"(?P<tag>[a-zA-Z][\w-]*)?(?P<rest>(?:\.[\w-]+|\[[^\]]+\])*)$")
_PART = re.compile(r"\.([\w-]+)|\[([\w-]+)(?:(\*?=)'([^']*)')?\]")


class Node:
    __slots__ = ("tag", "attrs", "parent", "parts")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []

    def inside(self) -> Iterator[Node | str]:
        """All nodes and texts inside, in the page's order."""
        stack = [iter(self.parts)]
        while stack:
            for part in stack[-1]:
                yield part
                if isinstance(part, Node):
                    stack.append(iter(part.parts))
                    break
            else:
                stack.pop()

    def all(self, selector: str) -> Iterator[Node]:
        """Nodes inside that a selector finds. Selectors are steps of ``tag.class[attr][attr='v'][attr*='v']`` with blanks
        (inside) or ``>`` (child) between; what stands before the last step may lie outside this node."""
        steps = _steps(selector)
        return (n for n in self.inside() if isinstance(n, Node) and _found(n, steps, len(steps) - 1))

    def first(self, selector: str) -> Node | None:
        return next(self.all(selector), None)

    def text(self, between: str = " ") -> str:
        """The texts inside without blanks at their ends; scripts and styles only of a node that is one."""
        found, stack = [], [iter(self.parts)]
        while stack:
            for part in stack[-1]:
                if isinstance(part, str):
                    if clean := part.strip():
                        found.append(clean)
                elif part.tag not in HIDDEN:
                    stack.append(iter(part.parts))
                    break
            else:
                stack.pop()
        return between.join(found)

    def raw(self) -> str:
        """Everything that is written inside: values of attributes and texts, one on a line."""
        lines = list(self.attrs.values())
        for part in self.inside():
            lines += [part] if isinstance(part, str) else part.attrs.values()
        return "\n".join(lines)


@lru_cache(maxsize=256)
def _steps(selector: str) -> tuple[tuple[bool, str | None, tuple[tuple[str, str, str], ...]], ...]:
    """``(is a child of the step before, tag, tests)`` for each step."""
    steps, child = [], False
    for word in selector.split():
        if word == ">":
            child = True
            continue
        step = _STEP.match(word)
        if step is None:
            raise ValueError(f"not a selector: {selector}")
        tests = tuple(("class", "~=", c) if c else (attr, op, value) for c, attr, op, value in _PART.findall(step["rest"]))
        steps.append((child, step["tag"], tests))
        child = False
    return tuple(steps)


def _is(node: Node, tag: str | None, tests: tuple[tuple[str, str, str], ...]) -> bool:
    if tag is not None and node.tag != tag:
        return False
    for attr, op, value in tests:
        given = node.attrs.get(attr)
        if given is None or (op == "~=" and value not in given.split()) or (op == "=" and given != value) or (op == "*=" and value not in given):
            return False
    return True


def _found(node: Node, steps: tuple, i: int) -> bool:
    child, tag, tests = steps[i]
    if not _is(node, tag, tests):
        return False
    if i == 0:
        return True
    above = node.parent
    while above is not None:
        if _found(above, steps, i - 1):
            return True
        above = None if child else above.parent
    return False


class Tolerant(HTMLParser):
    """A parser that takes unknown marked sections for comments instead of failing."""

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)


class _Builder(Tolerant):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {}, self.at)
        for k, v in attrs:
            node.attrs[k] = v or ""
        self.at.parts.append(node)
        if tag not in VOID and self.depth < DEPTH:
            self.at, self.depth = node, self.depth + 1

    def handle_startendtag(self, tag, attrs):
        at, depth = self.at, self.depth
        self.handle_starttag(tag, attrs)
        self.at, self.depth = at, depth

    def handle_endtag(self, tag):
        node, closed = self.at, 1
        while node is not self.root:
            if node.tag == tag:
                self.at, self.depth = node.parent, self.depth - closed
                return
            node, closed = node.parent, closed + 1

    def handle_data(self, data):
        self.at.parts.append(data)


def parsed(html: str | None) -> Node:
    """The root of a page; of a null page one without parts."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
