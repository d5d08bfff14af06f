"""Groups of rules that cannot make equal quads, from what is constant in their terms."""

from __future__ import annotations

import re
from itertools import pairwise

from ..frontend.mapping import SCHEME, template_parts
from ..model import Rule, TermMap


def invariant(t: TermMap | None) -> tuple[str, str, bool]:
    """kind of term, the text that its values start with, and whether that is the whole text."""
    if t is None:
        return "default", "", True
    if t.kind == "constant":
        return t.term, str(t.value), True
    if t.kind == "template":
        parts = template_parts(str(t.value))
        start = parts[0][1] if parts and not parts[0][0] else ""
        if t.term == "iri" and not re.match(SCHEME, start):  # the base comes first, or does not, row by row
            return t.term, "", False
        return t.term, start, len(parts) == 1 and bool(start)
    if t.kind == "parent":
        return invariant(t.value.subject)
    return t.term, "", False


def apart(a: tuple[str, str, bool], b: tuple[str, str, bool]) -> bool:
    """No value can have both invariants."""
    if a[0] != b[0]:
        return True
    (x, whole_x), (y, whole_y) = a[1:], b[1:]
    if whole_x and whole_y:
        return x != y
    return not (x.startswith(y) if whole_x else y.startswith(x) if whole_y else x.startswith(y) or y.startswith(x))


def may_meet(a: Rule, b: Rule) -> bool:
    """Both rules could make the same quad."""
    return not any(apart(invariant(getattr(a, x)), invariant(getattr(b, x))) for x in ("subject", "predicate", "object", "graph"))


def disjoint_groups(rules: list[Rule]) -> dict[str, list[Rule]]:
    """Connected groups under may_meet. Rules are few; each pair with equal predicate invariants is looked at."""
    own = [r for r in rules if r.asserted]
    parent = list(range(len(own)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(own)):
        for j in range(i):
            if root(i) != root(j) and may_meet(own[i], own[j]):
                parent[root(i)] = root(j)
    groups: dict[int, list[Rule]] = {}
    for i, r in enumerate(own):
        groups.setdefault(root(i), []).append(r)
    return {f"{n + 1}": g for n, g in enumerate(groups.values())}


def invertible(t: TermMap, options_safe: str = "") -> bool:
    """A template IRI determines its columns: references are encoded and separated by characters that encoding never leaves."""
    if t.kind != "template" or t.term != "iri" or options_safe:
        return False
    parts = template_parts(str(t.value))
    if not parts or parts[0][0] or not re.match(SCHEME, parts[0][1]):
        return False
    unreserved = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~%")
    for a, b in pairwise(parts):
        if a[0] and b[0]:
            return False
    # what follows a reference must begin with a character that encoding never leaves, unless it is the end
    return all(not a[0] or b[1][0] not in unreserved or i == len(parts) - 2 for i, (a, b) in enumerate(pairwise(parts)))
