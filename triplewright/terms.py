"""Terms of facts, patterns and rules, and the keys under which they are stored.

A name is stored as itself.  A fact that is used as a term is stored under its
``fact_id``, a digest of its parts with their lengths, so that equal structure
has one key and no two structures share one.  A list is nested ``cons`` facts
that end in ``nil``, as is a number, whose digits are its elements.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

NIL, CONS = "nil", "cons"


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Atom:
    name: str


@dataclass(frozen=True)
class Fact:
    """A statement as a term: one subject, one predicate, a set of objects."""

    s: Term
    p: Term
    objects: tuple[Term, ...]


@dataclass(frozen=True)
class SetTerm:
    """A set of terms; as a statement's part it is a node of its own with ``in`` facts."""

    elements: tuple[Term, ...]


Term = Var | Atom | Fact | SetTerm


def make_list(elements: list[Term]) -> Term:
    """A list; its first element is the outermost cell."""
    out: Term = Atom(NIL)
    for e in reversed(elements):
        out = Fact(e, Atom(CONS), (out,))
    return out


def compact_list(text: str) -> Term:
    """The characters of a text as a list, the last one first and outermost: ``abc`` is ``<c b a>``."""
    return make_list([Atom(c) for c in reversed(text)])


def list_elements(term: Term) -> list[Term]:
    out = []
    while isinstance(term, Fact) and term.p == Atom(CONS):
        out.append(term.s)
        term = term.objects[0]
    return out


def variables(term: Term) -> list[str]:
    """Names of the variables, in order, each once."""
    if isinstance(term, Var):
        return [term.name]
    if isinstance(term, Fact):
        return list(dict.fromkeys(v for part in (term.s, term.p, *term.objects) for v in variables(part)))
    if isinstance(term, SetTerm):
        return list(dict.fromkeys(v for e in term.elements for v in variables(e)))
    return []


def _digest(parts: list[str]) -> str:
    return "f:" + hashlib.sha256("".join(f"{len(x)}:{x}" for x in parts).encode()).hexdigest()


def fact_key(s: str, p: str, objects: list[str]) -> str:
    """The key of a fact from the keys of its parts; objects are a set."""
    return _digest([s, p, *sorted(set(objects))])


def key(term: Term) -> str:
    """The key of a term without variables."""
    if isinstance(term, Atom):
        return term.name
    if isinstance(term, Fact):
        return fact_key(key(term.s), key(term.p), [key(o) for o in term.objects])
    if isinstance(term, SetTerm):
        return "s:" + _digest(sorted({key(e) for e in term.elements}))[2:]
    raise ValueError(f"{term} is not ground")


def inner_facts(term: Term) -> list[Fact]:
    """The facts inside a ground term, innermost first, itself last if it is one."""
    if isinstance(term, Fact):
        return [f for part in (term.s, term.p, *term.objects) for f in inner_facts(part)] + [term]
    if isinstance(term, SetTerm):
        return [f for e in term.elements for f in inner_facts(e)]
    return []


def fact_key_column(s: Column, p: Column, objects: Column) -> Column:
    """``fact_key`` over columns; ``objects`` is an array."""
    part = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    each = F.array_join(F.transform(F.array_sort(F.array_distinct(objects)), part), "")
    return F.concat(F.lit("f:"), F.sha2(F.concat(part(s), part(p), each).cast("binary"), 256))


def show(term: Term) -> str:
    """The term in the rule language."""
    if isinstance(term, Var):
        return term.name
    if isinstance(term, Atom):
        return f'"{term.name}"' if not term.name or any(c in ' \t\n<>(){}*,¬"' for c in term.name) else term.name
    if isinstance(term, SetTerm):
        return "{" + " ".join(map(show, term.elements)) + "}"
    cells = list_elements(term)
    if cells:
        return "<" + " ".join(show(c) for c in cells) + ">"
    return "(" + " ".join(show(x) for x in (term.s, term.p, *term.objects)) + ")"
