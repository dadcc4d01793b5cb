"""Binary trees in one line of Newick text; distances are read and let go."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Node:
    number: int  # in post-order
    name: str | None  # of a leaf
    children: tuple["Node", ...] = ()

    def leaves(self) -> list[str]:
        return [self.name] if self.name is not None else [x for c in self.children for x in c.leaves()]

    def post_order(self) -> list["Node"]:
        return [x for c in self.children for x in c.post_order()] + [self]


def parse_newick(text: str, known: set[str] | None = None) -> Node:
    """The tree's root. known: the names a leaf may have; any other is an error."""
    tokens = re.findall(r"[(),;]|[^(),;\s]+", re.sub(r":[^(),;]*", "", text.strip()))
    at, number = 0, 0

    def node() -> Node:
        nonlocal at, number
        if at >= len(tokens):
            raise ValueError("the tree ends too early")
        if tokens[at] != "(":
            name = tokens[at]
            if name in "),;" or known is not None and name not in known:
                raise ValueError(f"not a leaf: {name}")
            at += 1
            number += 1
            return Node(number - 1, name)
        children = []
        while not children or tokens[at] == ",":
            at += 1
            children.append(node())
        if tokens[at] != ")" or len(children) != 2:
            raise ValueError("not a binary tree")
        at += 1
        if at < len(tokens) and tokens[at] not in "(),;":  # an inner node's name
            at += 1
        number += 1
        return Node(number - 1, None, tuple(children))

    root = node()
    if at < len(tokens) and tokens[at] != ";":
        raise ValueError("text after the tree")
    return root
