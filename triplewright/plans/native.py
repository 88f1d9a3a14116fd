"""The rule language: statements, patterns and rules as text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from triplewright.terms import Atom, Fact, SetTerm, Term, Var, compact_list, make_list, show, variables


class SyntaxFault(ValueError):
    """The text isn't a statement of the rule language."""


@dataclass(frozen=True)
class Pattern:
    """Holds for each match of a fact."""

    fact: Fact


@dataclass(frozen=True)
class Not:
    """Holds if the fact has no match."""

    fact: Fact


@dataclass(frozen=True)
class Differs:
    left: Term
    right: Term


@dataclass(frozen=True)
class Near:
    """Holds where a network scores the fact above a half."""

    network: str
    fact: Fact


Condition = Pattern | Not | Differs | Near


@dataclass(frozen=True)
class Rule:
    """``body => heads``; without heads, a match is a contradiction."""

    body: tuple[Condition, ...]
    heads: tuple[Fact, ...]
    name: str = ""

    @property
    def deferred(self) -> bool:
        """Whether it waits until the positive rules have nothing to add."""
        return any(isinstance(c, Not) for c in self.body)


@dataclass(frozen=True)
class Negated:
    term: Term


@dataclass(frozen=True)
class Approximate:
    network: str
    term: Term


@dataclass(frozen=True)
class Conjunction:
    parts: tuple


def show_rule(rule: Rule) -> str:
    """The rule as text that reads as the same rule."""

    def bare(x: Fact) -> str:
        return " ".join(map(show, (x.s, x.p, *x.objects)))

    def condition(c: Condition) -> str:
        if isinstance(c, Differs):
            return f"{show(c.left)} != {show(c.right)}"
        if isinstance(c, Not):
            return f"¬({bare(c.fact)})"
        return f"≈{c.network}({bare(c.fact)})" if isinstance(c, Near) else bare(c.fact)

    return f"({', '.join(map(condition, rule.body))}) => " + (f"({', '.join(map(bare, rule.heads))})" if rule.heads else "!")


_SPACE = " \t\r\n\f\v\0"
_RESERVED = set(_SPACE + '<"(){}*>,¬')
_ARROWS = ("<=>", "-->", "=>", "->", "<=", ">=")
_VARIABLE = re.compile(r"_.*|[A-Z]\Z", re.DOTALL)


def digits(token: str) -> Term:
    """A number literal: its digits as a list, the last one outermost; leading zeros don't count."""
    return compact_list(token.lstrip("0") or "0")


class Reader:
    """Recursive descent over the text.  ``number`` reads what follows ``&``; ``names`` are values for ``,name``."""

    def __init__(self, text: str, number: Callable[[str], Term] = digits, names: dict[str, Term] | None = None):
        self.text, self.at, self.number, self.names = text, 0, number, names or {}

    def space(self) -> bool:
        start = self.at
        while self.at < len(self.text) and self.text[self.at] in _SPACE:
            self.at += 1
        return self.at > start

    def starts(self, what: str) -> bool:
        return self.text.startswith(what, self.at)

    def fail(self, why: str):
        raise SyntaxFault(f"{why} at {self.text[self.at:self.at + 20]!r}")

    def expect(self, what: str) -> None:
        self.space()
        if not self.starts(what):
            self.fail(f"expected {what}")
        self.at += len(what)

    def symbol(self) -> str:
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in _RESERVED:
            self.at += 1
        if start == self.at:
            self.fail("expected a name")
        return self.text[start : self.at]

    def whole(self):
        """The text as one statement, or as conditions parted by commas."""
        parts = [self.statement()]
        while True:
            self.space()
            if not self.starts(","):
                break
            self.at += 1
            parts.append(self.statement())
        if self.at < len(self.text):
            self.fail("unexpected text")
        return parts[0] if len(parts) == 1 else Conjunction(tuple(parts))

    def statement(self):
        values = [self.value()]
        while True:
            spaced = self.space()
            if self.at >= len(self.text) or self.text[self.at] in ")}" or (self.starts(",") and not self.unquoted()):
                break
            if not spaced:
                self.fail("expected a blank")
            values.append(self.value())
        if len(values) == 1:
            return values[0]
        if len(values) == 2:
            self.fail("a fact needs a subject, a predicate and an object")
        return Fact(values[0], values[1], tuple(dict.fromkeys(values[2:])))

    def unquoted(self) -> bool:
        return self.at + 1 < len(self.text) and self.text[self.at + 1] not in _RESERVED

    def value(self):
        self.space()
        if self.at >= len(self.text):
            self.fail("expected a value")
        c = self.text[self.at]
        if c == "*":
            self.at += 1
            if self.at < len(self.text) and self.text[self.at] not in _SPACE + "),":
                return self.value()  # the focused part stands for itself
            return Atom("*")
        if c == "¬":
            self.at += 1
            return Negated(self.value())
        if c == "≈":
            self.at += 1
            return Approximate(self.symbol(), self.value())
        if c == ":":
            self.at += 1
            name = self.symbol()
            inner = self.value()
            return Fact(inner, self.name(name), (inner,))
        if c == ",":
            self.at += 1
            name = self.symbol()
            if name not in self.names:
                self.fail(f"{name} has no value")
            return self.names[name]
        if c == "&":
            self.at += 1
            return self.number(self.symbol())
        for arrow in _ARROWS:
            if self.starts(arrow):
                self.at += len(arrow)
                return Atom(arrow)
        if c == "<":
            return self.list()
        if c == '"':
            end = self.text.find('"', self.at + 1)
            if end < 0:
                self.fail("unclosed quote")
            out = Atom(self.text[self.at + 1 : end])
            self.at = end + 1
            return out
        if c == "(":
            return self.nested()
        if c == "{":
            self.at += 1
            elements = []
            while True:
                self.space()
                if self.starts("}"):
                    self.at += 1
                    return SetTerm(tuple(dict.fromkeys(elements)))
                elements.append(self.value())
        if c == ">":
            self.at += 1
            return Atom(">")
        return self.name(self.symbol())

    @staticmethod
    def name(text: str) -> Term:
        return Var(text) if _VARIABLE.match(text) else Atom(text)

    def list(self) -> Term:
        compact = re.compile(r"<([^> \t\r\n]+)>").match(self.text, self.at)
        if compact:
            self.at = compact.end()
            return compact_list(compact[1])
        mark, elements = self.at, []
        self.at += 1
        try:
            while True:
                self.space()
                if self.starts(">"):
                    self.at += 1
                    return make_list(elements)
                if self.at >= len(self.text) or self.text[self.at] in "),":
                    raise SyntaxFault("no list")
                elements.append(self.value())
        except SyntaxFault:
            self.at = mark + 1
            return Atom("<")

    def nested(self):
        self.at += 1
        parts = [self.statement()]
        while True:
            self.space()
            if self.starts(")"):
                self.at += 1
                return parts[0] if len(parts) == 1 else Conjunction(tuple(parts))
            if not self.starts(","):
                self.fail("expected , or )")
            self.at += 1
            parts.append(self.statement())


def conditions(x) -> tuple[Condition, ...]:
    """The conditions of a body; conjunctions inside one are part of it."""
    if isinstance(x, Conjunction):
        return tuple(c for part in x.parts for c in conditions(part))
    if isinstance(x, Negated):
        if not isinstance(x.term, Fact):
            raise SyntaxFault("only a fact can be negated")
        return (Not(x.term),)
    if isinstance(x, Approximate):
        if not isinstance(x.term, Fact):
            raise SyntaxFault("only a fact can be scored")
        return (Near(x.network, x.term),)
    if isinstance(x, Fact) and x.p == Atom("!=") and len(x.objects) == 1:
        return (Differs(x.s, x.objects[0]),)
    if isinstance(x, Fact):
        return (Pattern(x),)
    raise SyntaxFault(f"{x} is no condition")


def heads(x) -> tuple[Fact, ...]:
    if x == Atom("!"):
        return ()
    parts = x.parts if isinstance(x, Conjunction) else (x,)
    if not all(isinstance(p, Fact) for p in parts):
        raise SyntaxFault("a consequence must be a fact, several, or !")
    return tuple(parts)


def read(text: str, number: Callable[[str], Term] = digits, names: dict[str, Term] | None = None):
    """A ``Rule``, a ground ``Fact`` or other term, or a tuple of conditions (a query)."""
    x = Reader(text.strip(), number, names).whole()
    if isinstance(x, Fact) and x.p == Atom("=>") and len(x.objects) == 1:
        return Rule(conditions(x.s), heads(x.objects[0]), text.strip())
    if isinstance(x, (Conjunction, Negated, Approximate)):
        return conditions(x)
    if isinstance(x, Fact) and variables(x):
        return conditions(x)
    return x
