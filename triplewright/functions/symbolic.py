"""Rewriting of single terms: simplification, differentiation, and the exp-minus-log form.

Terms are those of the rule language: ``(a + b)``, ``(a * b)``, ``(a / b)``,
``(f of a)``, ``(a eml b)``; numbers are digit lists (``&5``).  Atoms must be
declared as symbols: a term with others has no result (``None``).  This works
on terms of the size people write; it is no data operation.
"""

from __future__ import annotations

from functools import lru_cache

from triplewright.plans.native import digits
from triplewright.terms import NIL, Atom, Fact, Term, list_elements

ZERO, ONE = digits("0"), digits("1")
INVERSES = (("exp", "ln"), ("ln", "exp"))


def number(term: Term) -> int | None:
    """The value of a digit list."""
    cells = list_elements(term)
    if not cells or not all(isinstance(c, Atom) and len(c.name) == 1 and c.name.isdigit() for c in cells):
        return None
    return int("".join(c.name for c in reversed(cells)))


def made(a: Term, op: str, b: Term) -> Fact:
    return Fact(a, Atom(op), (b,))


def applied(f: str, a: Term) -> Fact:
    return Fact(Atom(f), Atom("of"), (a,))


def parts(term: Term) -> tuple[Term, str, Term] | None:
    if isinstance(term, Fact) and isinstance(term.p, Atom) and len(term.objects) == 1 and term.p.name != "cons":
        return term.s, term.p.name, term.objects[0]
    return None


def rewrite(term: Fact, inverses: tuple = INVERSES, known: dict[Term, Term] | None = None) -> Term:
    """One step at the top of a term whose parts are in normal form; the term itself if nothing applies."""
    a, op, b = parts(term)
    if op == "+":
        if b == ZERO:
            return a
        if a == ZERO:
            return b
    if op == "*":
        if ZERO in (a, b):
            return ZERO
        if b == ONE:
            return a
        if a == ONE:
            return b
    if op == "/":
        if b == ONE:
            return a
        if a == ZERO and b != ZERO:
            return ZERO
    if op == "of" and isinstance(a, Atom):
        inner = parts(b)
        if inner and inner[1] == "of" and isinstance(inner[0], Atom) and (a.name, inner[0].name) in inverses:
            return inner[2]
        if a.name == "exp" and b == ONE:
            return Atom("e")
    if op == "eml":
        if b == ONE:
            return rewrite(applied("exp", a), inverses, known)
        outer = parts(b)
        if a == ONE and outer and outer[1] == "of" and outer[0] == Atom("exp"):
            inner = parts(outer[2])
            if inner and inner[1] == "eml" and inner[0] == ONE:
                return rewrite(applied("ln", inner[2]), inverses, known)
    x, y = number(a), number(b)
    if x is not None and y is not None:
        if op == "+":
            return digits(str(x + y))
        if op == "*":
            return digits(str(x * y))
        if op == "/" and y and x % y == 0:
            return digits(str(x // y))
    return (known or {}).get(term, term)


def simplify(term: Term, symbols: set[str], inverses: tuple = INVERSES, known: dict[Term, Term] | None = None) -> Term | None:
    """The normal form: neutral and absorbing elements, inverse pairs, arithmetic, and what ``known`` equates."""
    if isinstance(term, Atom):
        return term if term.name in symbols or term.name == "e" else None
    if number(term) is not None or term == Atom(NIL):
        return term
    split = parts(term)
    if not split or split[1] not in ("+", "*", "/", "of", "eml"):
        return None
    a, op, b = split
    left = a if op == "of" else simplify(a, symbols, inverses, known)
    right = simplify(b, symbols, inverses, known)
    if left is None or right is None:
        return None
    return rewrite(made(left, op, right), inverses, known)


def mentions(term: Term, x: str) -> bool:
    if isinstance(term, Atom):
        return term.name == x
    split = parts(term)
    return bool(split) and (mentions(split[0], x) or mentions(split[2], x))


def _derived(term: Term, x: str) -> Term | None:
    if not mentions(term, x):
        return ZERO
    if isinstance(term, Atom):
        return ONE
    a, op, b = parts(term)
    if op == "of":
        inner = _derived(b, x)
        if inner is None:
            return None
        if a == Atom("exp"):
            return made(term, "*", inner)
        if a == Atom("ln"):
            return made(inner, "/", b)
        return None
    da, db = _derived(a, x), _derived(b, x)
    if da is None or db is None:
        return None
    if op == "+":
        return made(da, "+", db)
    if op == "*":
        return made(made(da, "*", b), "+", made(a, "*", db))
    if op == "/" and not mentions(b, x):
        return made(da, "/", b)
    return None


def differentiate(term: Term, x: str, symbols: set[str]) -> Term | None:
    """The simplified derivative by ``x``: sums, products, constant divisors, exp and ln by the chain rule."""
    out = _derived(term, x) if simplify(term, symbols | {x}) is not None else None
    return None if out is None else simplify(out, symbols | {x})


def compile_eml(term: Term, symbols: set[str]) -> Term | None:
    """The term in ``eml(a, b) = exp(a) - ln(b)`` alone; numbers and symbols are leaves."""

    @lru_cache(None)
    def go(t: Term) -> Term | None:
        if isinstance(t, Atom):
            return t if t.name in symbols or t.name == "e" else None
        if number(t) is not None:
            return t
        split = parts(t)
        if not split:
            return None
        a, op, b = split
        if op == "of" and isinstance(a, Atom):
            p = go(b)
            if a.name == "exp":
                return p and made(p, "eml", ONE)
            if a.name == "ln":
                return p and made(ONE, "eml", made(made(ONE, "eml", p), "eml", ONE))
            if a.name == "neg":
                return go(made(applied("ln", ONE), "-", b))
            if a.name == "inv":
                return go(applied("exp", applied("neg", applied("ln", b))))
            return None
        if op == "eml":
            p, q = go(a), go(b)
            return p and q and made(p, "eml", q)
        if op == "-":
            p, q = go(a), go(b)
            return p and q and made(made(ONE, "eml", made(made(ONE, "eml", p), "eml", ONE)), "eml", made(q, "eml", ONE))
        if op == "+":
            return go(made(a, "-", applied("neg", b)))
        if op == "*":
            return go(applied("exp", made(applied("ln", a), "+", applied("ln", b))))
        if op == "/":
            return go(made(a, "*", applied("inv", b)))
        return None

    return go(term)
