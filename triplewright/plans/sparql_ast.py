"""SELECT queries as data, and the parser that makes them from text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class QueryError(ValueError):
    """The text isn't a query of this language."""


class UnsupportedFeature(QueryError):
    """A keyword of the wider language that this one leaves out."""


@dataclass(frozen=True)
class Ref:
    """A variable."""

    name: str


@dataclass(frozen=True)
class Const:
    """A node by its key."""

    key: str


Node = Ref | Const


@dataclass(frozen=True)
class Step:
    """One element of a path: a predicate, with ``+`` or ``*`` or nothing."""

    predicate: str
    modifier: str = ""


@dataclass(frozen=True)
class Triple:
    s: Node
    p: Node
    o: Node


@dataclass(frozen=True)
class Closure:
    """A transitive step between two ends."""

    s: Node
    predicate: str
    modifier: str
    o: Node


@dataclass(frozen=True)
class Call:
    function: str
    variable: str


@dataclass(frozen=True)
class Compare:
    left: Node | Call
    op: str
    right: Node | Call


@dataclass(frozen=True)
class Group:
    elements: tuple = ()


@dataclass(frozen=True)
class Optional_:
    group: Group


@dataclass(frozen=True)
class Minus:
    group: Group


@dataclass(frozen=True)
class Union_:
    branches: tuple[Group, ...]


@dataclass(frozen=True)
class Count:
    variable: str
    alias: str
    distinct: bool = False


@dataclass(frozen=True)
class Select:
    projection: tuple  # str or Count; ("*",) for all
    where: Group
    distinct: bool = False
    group_by: str | None = None
    order_by: tuple[str, bool] | None = None  # variable, descending
    limit: int | None = None


KEYWORDS = {"SELECT", "DISTINCT", "WHERE", "OPTIONAL", "MINUS", "UNION", "FILTER", "PREFIX", "GROUP", "ORDER", "BY", "LIMIT", "AS", "COUNT", "ASC", "DESC"}
REJECTED = {"BIND", "VALUES", "SERVICE", "CONSTRUCT", "DESCRIBE", "GRAPH", "HAVING"}
#: Prefixes that are known without a declaration, and what they put before a local name.
KNOWN_PREFIXES = {"wd": "", "wdt": "", "p": "p:", "pq": "pq:", "ps": "ps:", "psv": "psv:", "pqv": "pqv:", "wdtn": "wdtn:", "wikibase": "wikibase:"}
#: The same for whole IRIs; longer ones first.
KNOWN_IRIS = (
    ("http://www.wikidata.org/prop/qualifier/", "pq:"), ("http://www.wikidata.org/prop/statement/", "ps:"), ("http://www.wikidata.org/prop/direct/", ""),
    ("http://www.wikidata.org/entity/", ""), ("http://www.wikidata.org/prop/", "p:"), ("http://wikiba.se/ontology#", "wikibase:"),
)

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n]+|\#[^\n]*)
      | (?P<iri><[^>\s=][^>]*>)
      | (?P<var>[?$][A-Za-z0-9_-]+)
      | (?P<string>"[^"]*"|'[^']*')(?P<lang>@[A-Za-z0-9_-]+)?
      | (?P<pname>[A-Za-z0-9_]*:[A-Za-z0-9_-]*)
      | (?P<number>-?[0-9]+(?:\.[0-9]+)?)
      | (?P<word>[A-Za-z_][A-Za-z0-9_-]*)
      | (?P<mark><=|>=|!=|[{}().,;=<>+*/])""",
    re.VERBOSE,
)


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, value) pairs; keywords are of one case throughout."""
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"can't read {text[at:at + 20]!r}")
        kind, value = m.lastgroup if m.lastgroup != "lang" else "string", m.group()
        if kind == "string":
            value = m["string"][1:-1]
        if kind == "word" and value.upper() in REJECTED and value in (value.upper(), value.lower()):
            raise UnsupportedFeature(value.upper())
        if kind == "word" and value.upper() in KEYWORDS and value in (value.upper(), value.lower()):
            kind, value = "keyword", value.upper()
        if kind != "space":
            out.append((kind, value))
        at = m.end()
    return out


@dataclass
class Parser:
    """Recursive descent over the tokens."""

    items: list[tuple[str, str]]
    at: int = 0
    prefixes: dict[str, str] = field(default_factory=dict)
    fresh: int = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def take(self, kind: str | None = None, value: str | None = None) -> str:
        k, v = self.peek()
        if (kind and k != kind) or (value and v != value):
            raise QueryError(f"expected {value or kind}, found {v or 'the end'!r}")
        self.at += 1
        return v

    def has(self, kind: str, value: str | None = None) -> bool:
        k, v = self.peek()
        if k == kind and (value is None or v == value):
            self.at += 1
            return True
        return False

    def query(self) -> Select:
        while self.has("keyword", "PREFIX"):
            name = self.take("pname")
            if not name.endswith(":"):
                raise QueryError(f"{name} is no prefix")
            self.prefixes[name[:-1]] = self.take("iri")[1:-1]
        out = self.select()
        if self.peek()[0] != "end":
            raise QueryError(f"nothing may follow the query, found {self.peek()[1]!r}")
        return out

    def select(self) -> Select:
        self.take("keyword", "SELECT")
        distinct = self.has("keyword", "DISTINCT")
        projection: list = []
        while True:
            if self.peek()[0] == "var":
                projection.append(self.take()[1:])
            elif self.has("mark", "*"):
                projection.append("*")
            elif self.has("mark", "("):
                self.take("keyword", "COUNT")
                self.take("mark", "(")
                each = self.has("keyword", "DISTINCT")
                variable = self.take("var")[1:]
                self.take("mark", ")")
                self.take("keyword", "AS")
                projection.append(Count(variable, self.take("var")[1:], each))
                self.take("mark", ")")
            else:
                break
        if not projection:
            raise QueryError("SELECT needs variables, counts or *")
        self.has("keyword", "WHERE")
        where = self.group()
        group_by = order_by = limit = None
        while True:
            if self.has("keyword", "GROUP"):
                self.take("keyword", "BY")
                group_by = self.take("var")[1:]
            elif self.has("keyword", "ORDER"):
                self.take("keyword", "BY")
                if self.peek() in (("keyword", "ASC"), ("keyword", "DESC")):
                    down = self.take() == "DESC"
                    self.take("mark", "(")
                    order_by = (self.take("var")[1:], down)
                    self.take("mark", ")")
                else:
                    order_by = (self.take("var")[1:], False)
            elif self.has("keyword", "LIMIT"):
                limit = int(self.take("number"))
            else:
                return Select(tuple(projection), where, distinct, group_by, order_by, limit)

    def group(self) -> Group:
        self.take("mark", "{")
        elements: list = []
        while not self.has("mark", "}"):
            elements += self.element()
            self.has("mark", ".")
        return Group(tuple(elements))

    def element(self) -> list:
        if self.has("keyword", "OPTIONAL"):
            return [Optional_(self.one_group())]
        if self.has("keyword", "MINUS"):
            return [Minus(self.group())]
        if self.has("keyword", "FILTER"):
            return [self.filter()]
        if self.peek() == ("mark", "{"):
            return [self.braces()]
        return self.triples()

    def one_group(self) -> Group:
        found = self.braces()
        return found if isinstance(found, Group) else Group((found,))

    def braces(self):
        """A subquery, a union, or a nested group."""
        if self.peek(1) == ("keyword", "SELECT"):
            self.take("mark", "{")
            inner = self.select()
            self.take("mark", "}")
            return inner
        branches = [self.group()]
        while self.has("keyword", "UNION"):
            branches.append(self.group())
        return Union_(tuple(branches)) if len(branches) > 1 else branches[0]

    def filter(self) -> Compare:
        depth = 0
        while self.has("mark", "("):
            depth += 1
        if not depth:
            raise QueryError("FILTER needs parentheses")
        left = self.operand()
        op = self.take("mark")
        if op not in ("=", "!=", "<", ">", "<=", ">="):
            raise QueryError(f"{op} is no comparison")
        right = self.operand()
        self.take("mark", ")")
        while self.has("mark", ")"):
            pass
        return Compare(left, op, right)

    def operand(self) -> Node | Call:
        kind, value = self.peek()
        if kind == "word" and self.peek(1) == ("mark", "("):
            if value not in ("str", "STR", "lang", "LANG"):
                raise QueryError(f"{value} is no function")
            self.take()
            self.take("mark", "(")
            out = Call(value.lower(), self.take("var")[1:])
            self.take("mark", ")")
            return out
        return self.term()

    def term(self) -> Node:
        kind, value = self.peek()
        self.at += 1
        if kind == "var":
            return Ref(value[1:])
        if kind == "iri":
            return Const(self.iri(value[1:-1]))
        if kind == "pname":
            prefix, local = value.split(":", 1)
            if prefix in KNOWN_PREFIXES:
                return Const(KNOWN_PREFIXES[prefix] + local)
            if prefix in self.prefixes:
                return Const(self.iri(self.prefixes[prefix] + local))
            return Const(value)
        if kind in ("string", "number", "word"):
            return Const(value)
        raise QueryError(f"expected a term, found {value or 'the end'!r}")

    @staticmethod
    def iri(text: str) -> str:
        for start, put in KNOWN_IRIS:
            if text.startswith(start):
                return put + text[len(start) :]
        return text

    def triples(self) -> list:
        subject, out = self.term(), []
        while True:
            verb = self.verb()
            while True:
                out += self.expand(subject, verb, self.term())
                if not self.has("mark", ","):
                    break
            if not self.has("mark", ";"):
                return out

    def verb(self) -> Ref | list[Step]:
        if self.peek()[0] == "var":
            return Ref(self.take()[1:])
        steps = []
        while True:
            where = self.term()
            if not isinstance(where, Const):
                raise QueryError("a path has no variables")
            modifier = self.take() if self.peek() in (("mark", "+"), ("mark", "*")) else ""
            steps.append(Step(where.key, modifier))
            if not self.has("mark", "/"):
                return steps

    def expand(self, s: Node, verb: Ref | list[Step], o: Node) -> list:
        """Triples and transitive steps, by hidden variables between a path's elements."""
        if isinstance(verb, Ref):
            return [Triple(s, verb, o)]
        out, here = [], s
        for k, step in enumerate(verb):
            if k + 1 < len(verb):
                self.fresh += 1
                there: Node = Ref(f"__path{self.fresh}")
            else:
                there = o
            out.append(Closure(here, step.predicate, step.modifier, there) if step.modifier else Triple(here, Const(step.predicate), there))
            here = there
        return out


def parse(text: str) -> Select:
    """The query of a text; raises ``QueryError``."""
    return Parser(tokens(text)).query()
