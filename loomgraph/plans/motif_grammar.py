"""The motif language: `(a)-[e]->(b); !(b)-[]->(a); (c)`."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class EdgePattern:
    src: str
    dst: str
    edge: str | None
    negated: bool = False


@dataclass(frozen=True)
class VertexPattern:
    name: str


Clause = EdgePattern | VertexPattern
ANONYMOUS = "__v"

_SCANNER = re.compile(r"\s*(?:(?P<name>\w+)|(?P<mark>->|[()\[\]\-!]))")


def is_named(vertex: str) -> bool:
    return not vertex.startswith(ANONYMOUS)


def _tokens(clause: str) -> list[str]:
    out, at = [], 0
    clause = clause.rstrip()
    while at < len(clause):
        found = _SCANNER.match(clause, at)
        if not found:
            raise ValueError(f"cannot parse the clause {clause!r} at {clause[at:]!r}")
        out.append(found["name"] or found["mark"])
        at = found.end()
    return out


class _Reader:
    def __init__(self, clause: str):
        self.clause, self.tokens, self.at = clause, _tokens(clause), 0

    def take(self, *expected: str) -> None:
        for mark in expected:
            if self.at >= len(self.tokens) or self.tokens[self.at] != mark:
                raise ValueError(f"cannot parse the clause {self.clause!r}: {mark!r} is missing")
            self.at += 1

    def optional(self, mark: str) -> bool:
        found = self.at < len(self.tokens) and self.tokens[self.at] == mark
        self.at += found
        return found

    def name(self) -> str:
        if self.at < len(self.tokens) and re.fullmatch(r"\w+", self.tokens[self.at]):
            self.at += 1
            return self.tokens[self.at - 1]
        return ""

    def done(self) -> bool:
        return self.at == len(self.tokens)


def parse_motif(pattern: str) -> list[Clause]:
    """The clauses of a pattern; vertices without a name get names of their own."""
    clauses: list[Clause] = []
    unnamed = 0
    for text in pattern.split(";"):
        if not text.strip():
            continue
        r = _Reader(text.strip())
        negated = r.optional("!")
        r.take("(")
        src = r.name()
        r.take(")")
        if r.done():
            if negated:
                raise ValueError(f"a vertex cannot be negated: {text!r}")
            if not src:
                raise ValueError(f"cannot parse the clause {text!r}: a lone vertex needs a name")
            clauses.append(VertexPattern(src))
            continue
        r.take("-", "[")
        edge = r.name()
        r.take("]", "->", "(")
        dst = r.name()
        r.take(")")
        if not r.done():
            raise ValueError(f"cannot parse the clause {text!r}: more follows after the edge")
        if negated and edge:
            raise ValueError(f"a negated edge cannot have a name: {text!r}")
        if not src:
            src, unnamed = f"{ANONYMOUS}{unnamed}", unnamed + 1
        if not dst:
            dst, unnamed = f"{ANONYMOUS}{unnamed}", unnamed + 1
        clauses.append(EdgePattern(src, dst, edge or None, negated))
    if not clauses:
        raise ValueError("the pattern is empty")
    return clauses
