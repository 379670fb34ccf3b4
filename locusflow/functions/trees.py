"""Small driver-side trees: Newick text, rooted quartets and labels."""

from __future__ import annotations

import re
from itertools import combinations


class Tree:
    def __init__(self, name: str = "", children: tuple[Tree, ...] = ()):
        self.name, self.children = name, children

    @property
    def tips(self) -> list[str]:
        return [t for c in self.children for t in c.tips] if self.children else [self.name]

    def clades(self):
        yield self
        for c in self.children:
            yield from c.clades()


def parse_newick(text: str) -> Tree:
    """A rooted tree; branch lengths and comments are dropped. Empty or unbalanced text is an error."""
    tokens = re.findall(r"'(?:[^']|'')*'|[(),;:]|[^(),;:\s\[\]]+|\[[^\]]*\]", text.strip())
    tokens = [t for t in tokens if not t.startswith("[")]
    at = 0

    def node() -> Tree:
        nonlocal at
        kids: list[Tree] = []
        if at < len(tokens) and tokens[at] == "(":
            at += 1
            kids.append(node())
            while at < len(tokens) and tokens[at] == ",":
                at += 1
                kids.append(node())
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError("unbalanced Newick text")
            at += 1
        name = ""
        if at < len(tokens) and tokens[at] not in "(),;:":
            name = tokens[at].strip("'").replace("''", "'")
            at += 1
        if at < len(tokens) and tokens[at] == ":":
            at += 2
        if not kids and not name:
            raise ValueError("empty Newick label")
        return Tree(name, tuple(kids))

    if not tokens:
        raise ValueError("empty Newick text")
    tree = node()
    if at < len(tokens) and tokens[at] != ";":
        raise ValueError("text after the Newick tree")
    return tree


def _split(tree: Tree, tips: set[str]) -> list[set[str]]:
    """The tips under each child of the smallest clade that holds them all."""
    while True:
        parts = [s for c in tree.children if (s := set(c.tips) & tips)]
        if len(parts) != 1:
            return parts
        tree = next(c for c in tree.children if set(c.tips) & tips)


def rooted_quartets(tree: Tree) -> list[tuple[str, str, str, str]]:
    """(P1, P2, P3, outgroup) of every four tips that resolve as (((P1, P2), P3), O), P1 before P2 by name; balanced ones are skipped."""
    out = []
    for four in combinations(sorted(tree.tips), 4):
        top = _split(tree, set(four))
        if len(top) != 2 or sorted(map(len, top)) != [1, 3]:
            continue
        o, three = sorted(top, key=len)
        nxt = _split(tree, three)
        if len(nxt) != 2 or sorted(map(len, nxt)) != [1, 2]:
            continue
        p3, two = sorted(nxt, key=len)
        out.append((*sorted(two), *p3, *o))
    return out


def quote(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z0-9._-]+", name) else "'" + name.replace("'", "''") + "'"


def polytomy(names: list[str]) -> str:
    return "(" + ",".join(map(quote, names)) + ");"


def branches(tree: Tree) -> list[tuple[str, str, list[str], list[str]]]:
    """(branch, sister, descendants, sister's tips) of every non-root branch with a sister."""
    out = []
    for c in tree.clades():
        for a in c.children:
            for b in c.children:
                if a is not b:
                    out.append((",".join(sorted(a.tips)), ",".join(sorted(b.tips)), sorted(a.tips), sorted(b.tips)))
    return out
