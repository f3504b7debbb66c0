"""Boolean trigram queries: what a text must contain for a regular expression to match in it.

An expression is read once, by descent, into strings where it has few of them and
into "anything" elsewhere. Neighbouring strings are joined, and their trigrams are
mandatory. The query is a list of alternatives, each a set of trigrams that all must
occur; an empty alternative (``ANY``) says that nothing is mandatory. A query may be
weaker than the expression, never stronger, so no match is lost.
"""

from __future__ import annotations

from typing import NamedTuple

Query = list[frozenset[str]]
ANY: Query = [frozenset()]
#: Strings, or alternatives, that are followed one by one; characters of a class that are.
MOST, CLASS_MOST = 64, 8


class Part(NamedTuple):
    """The strings that a part of an expression matches, if they are few, else what it needs."""

    strings: frozenset[str] | None
    needs: Query


NOTHING = Part(frozenset({""}), ANY)
ANYTHING = Part(None, ANY)


def _least(query: set[frozenset[str]]) -> Query:
    """The alternatives that contain no other one, in a fixed order."""
    return sorted((a for a in query if not any(b < a for b in query)), key=sorted)


def _of(strings: frozenset[str]) -> Query:
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _both(a: Query, b: Query) -> Query:
    joined = {x | y for x in a for y in b}
    return _least(joined) if len(joined) <= MOST else max(a, b, key=lambda q: min(map(len, q)))


def _sequence(parts: list[Part]) -> Part:
    run, needs, whole = frozenset({""}), ANY, True
    for part in parts:
        if part.strings is not None:
            joined = frozenset(a + b for a in run for b in part.strings)
            if len(joined) <= MOST:
                run = joined
                continue
        needs, whole = _both(needs, _of(run)), False
        run = part.strings if part.strings is not None else frozenset({""})
        if part.strings is None:
            needs = _both(needs, part.needs)
    return Part(run if whole else None, _both(needs, _of(run)))


def _either(parts: list[Part]) -> Part:
    if all(p.strings is not None for p in parts):
        strings = frozenset().union(*(p.strings for p in parts))
        return Part(strings if len(strings) <= MOST else None, _of(strings))
    needs = {a for p in parts for a in (p.needs if p.strings is None else _of(p.strings))}
    return Part(None, _least(needs) if len(needs) <= MOST else ANY)


def _repeated(part: Part, least: int, most: int | None) -> list[Part]:
    """What follows on one another when a part is repeated."""
    if least == 0:
        return [Part(part.strings | {""}, ANY) if most == 1 and part.strings is not None else ANYTHING]
    times = min(least, 3)
    return [part] * times + ([] if most == times else [ANYTHING])


class _Reader:
    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def more(self, *stops: str) -> bool:
        return self.i < len(self.p) and self.p[self.i] not in stops

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def alternatives(self) -> Part:
        found = [self.sequence()]
        while self.more(")"):
            self.take()  # the bar
            found.append(self.sequence())
        return _either(found) if len(found) > 1 else found[0]

    def sequence(self) -> Part:
        parts = []
        while self.more("|", ")"):
            parts += self.quantified(self.atom())
        return _sequence(parts)

    def quantified(self, part: Part) -> list[Part]:
        if not self.more() or self.p[self.i] not in "?*+{":
            return [part]
        sign = self.take()
        if sign == "{":
            end = self.p.index("}", self.i)
            low, comma, high = self.p[self.i : end].partition(",")
            self.i = end + 1
            parts = _repeated(part, int(low or 0), int(high) if high else None if comma else int(low))
        else:
            parts = _repeated(part, int(sign == "+"), 1 if sign == "?" else None)
        if self.more() and self.p[self.i] in "?+":  # lazy or possessive: the same strings
            self.take()
        return parts

    def atom(self) -> Part:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.characters()
        if c in "^$":
            return NOTHING
        if c == ".":
            return ANYTHING
        if c == "\\":
            known = self.escaped()
            return known if isinstance(known, Part) else Part(frozenset({known}), ANY)
        return Part(frozenset({c}), ANY)

    def group(self) -> Part:
        zero_width = False
        if self.p[self.i : self.i + 1] == "?":
            head = next((h for h in ("?:", "?=", "?!", "?<=", "?<!") if self.p.startswith(h, self.i)), None)
            if head is None:
                raise ValueError(f"a group of unknown kind in {self.p}")
            self.i += len(head)
            zero_width = head != "?:"
        inner = self.alternatives()
        self.take()  # the bracket
        return NOTHING if zero_width else inner

    def escaped(self) -> str | Part:
        c = self.take()
        if c == "x":
            self.i += 2
            return chr(int(self.p[self.i - 2 : self.i], 16))
        if c in "bB":
            return NOTHING
        if c in "dDwWsS":
            return ANYTHING
        if c.isalnum() and c not in "tnrf":
            raise ValueError(f"an escape of unknown kind in {self.p}: {c}")
        return {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}.get(c, c)

    def characters(self) -> Part:
        negated = self.p[self.i] == "^"
        self.i += negated
        members: set[str] | None = set()
        begun = self.i
        while self.p[self.i] != "]" or self.i == begun:
            c = self.take()
            c = self.escaped() if c == "\\" else c
            if isinstance(c, Part):
                members = None
            elif self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.take()
                end = self.take()
                end = self.escaped() if end == "\\" else end
                if members is not None:
                    members.update(map(chr, range(ord(c), ord(end) + 1)))
            elif members is not None:
                members.add(c)
        self.take()
        return ANYTHING if negated or members is None or len(members) > CLASS_MOST else Part(frozenset(members), ANY)


def query(pattern: str, ignore_case: bool = False) -> Query:
    """The alternatives of trigrams, one of which a text needs; of lower-cased ones to ``ignore_case``.

    It reads literals, escapes, classes, groups, alternation and quantifiers, takes
    anchors and lookarounds for nothing, and raises on what it doesn't know.
    """
    part = _Reader(pattern).alternatives()
    needs = part.needs if part.strings is None else _of(part.strings)
    return _least({frozenset(t.lower() for t in a) for a in needs}) if ignore_case else needs
