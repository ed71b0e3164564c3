"""Boolean retrieval: a query string compiled to one predicate over term flags.

Grammar, by precedence: NOT (to the right), AND, OR (both to the left), parentheses; operators in any case.
There is no implicit AND. All terms of a query are looked up in one filtered scan of the postings and one
aggregation by document. The universe is joined only if documents without any of the terms can match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import LOWER, UPPER, normalize
from tessera.session import cut

_SPACE = " \t\n\v\f\r"
_TO_LOWER, _TO_UPPER = str.maketrans(UPPER, LOWER), str.maketrans(LOWER, UPPER)


@dataclass(frozen=True)
class Term:
    text: str

    def flag(self, has: dict[str, Column]) -> Column:
        return has[self.text]

    def holds(self, terms: frozenset[str]) -> bool:
        return self.text in terms

    def terms(self) -> Iterator[str]:
        yield self.text


@dataclass(frozen=True)
class Not:
    of: Node

    def flag(self, has: dict[str, Column]) -> Column:
        return ~self.of.flag(has)

    def holds(self, terms: frozenset[str]) -> bool:
        return not self.of.holds(terms)

    def terms(self) -> Iterator[str]:
        return self.of.terms()


@dataclass(frozen=True)
class Pair:
    both: bool
    left: Node
    right: Node

    def flag(self, has: dict[str, Column]) -> Column:
        a, b = self.left.flag(has), self.right.flag(has)
        return a & b if self.both else a | b

    def holds(self, terms: frozenset[str]) -> bool:
        a, b = self.left.holds(terms), self.right.holds(terms)
        return a and b if self.both else a or b

    def terms(self) -> Iterator[str]:
        yield from self.left.terms()
        yield from self.right.terms()


Node = Term | Not | Pair


def tokenize(query: str) -> list[str]:
    """Parentheses, AND, OR, NOT, and terms lower-cased by ASCII rules."""
    for c in _SPACE:
        query = query.replace(c, " ")
    out = []
    for word in query.replace("(", " ( ").replace(")", " ) ").split(" "):
        if word:
            upper = word.translate(_TO_UPPER)
            out.append(upper if upper in ("AND", "OR", "NOT") else word.translate(_TO_LOWER))
    return out


class _Parser:
    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def level(self, operator: str) -> Node:
        """A chain of one binary operator; OR's operands are chains of AND."""
        below = (lambda: self.level("AND")) if operator == "OR" else self.operand
        node = below()
        while self.peek() == operator:
            self.at += 1
            node = Pair(operator == "AND", node, below())
        return node

    def operand(self) -> Node:
        token = self.peek()
        if token is None:
            raise ValueError("incomplete query: an operand is missing")
        self.at += 1
        if token == "NOT":
            return Not(self.operand())
        if token == "(":
            node = self.level("OR")
            if self.peek() != ")":
                raise ValueError("mismatched parentheses" if self.peek() is None else f"an operator is missing before {self.peek()!r}")
            self.at += 1
            return node
        if token in ("AND", "OR"):
            raise ValueError(f"{token} lacks its left operand")
        if token == ")":
            raise ValueError("')' where an operand is expected")
        return Term(token)


def parse(query: str) -> Node:
    """The query's tree; ValueError for malformed queries, before any job runs."""
    parser = _Parser(tokenize(query))
    node = parser.level("OR")
    if (rest := parser.peek()) is not None:
        raise ValueError("mismatched parentheses" if rest == ")" else f"an operator is missing before {rest!r}")
    return node


def _mapped(node: Node, names: dict[str, str]) -> Node:
    if isinstance(node, Term):
        return Term(names[node.text])
    if isinstance(node, Not):
        return Not(_mapped(node.of, names))
    return Pair(node.both, _mapped(node.left, names), _mapped(node.right, names))


def _tree(postings: DataFrame, query: str, normalize_terms: bool) -> Node:
    node = parse(query)
    if normalize_terms:
        found = sorted(set(node.terms()))
        row = postings.sparkSession.range(1).select(*[normalize(F.lit(t)).alias(f"t{i}") for i, t in enumerate(found)]).first()
        node = _mapped(node, dict(zip(found, row, strict=True)))
    return node


def search(postings: DataFrame, universe: DataFrame, query: str, *, normalize_terms: bool = False) -> DataFrame:
    """(doc_id) of the documents that match, each once."""
    node = _tree(postings, query, normalize_terms)
    terms = sorted(set(node.terms()))
    flags = postings.where(F.col("term").isin(terms)).groupBy("doc_id").agg(*[F.max(F.col("term") == t).alias(f"__t{i}") for i, t in enumerate(terms)])
    has = {t: F.col(f"__t{i}") for i, t in enumerate(terms)}
    if node.holds(frozenset()):
        flags = universe.join(flags, "doc_id", "left").na.fill(False)
    return flags.where(node.flag(has)).select("doc_id")


def search_by_sets(postings: DataFrame, universe: DataFrame, query: str) -> DataFrame:
    """The same result by set operations, one for each operator of the query.

    The postings of the query's terms are stored first, and the universe if it is wanted, so that they are made once.
    """
    node = parse(query)
    postings = cut(postings.where(F.col("term").isin(sorted(set(node.terms())))))
    if "NOT" in tokenize(query):
        universe = cut(universe)

    def of(node: Node) -> DataFrame:
        if isinstance(node, Term):
            return postings.where(F.col("term") == node.text).select("doc_id")
        if isinstance(node, Not):
            return universe.join(of(node.of), "doc_id", "left_anti")
        if not node.both:
            return of(node.left).union(of(node.right)).distinct()
        if isinstance(node.right, Not):
            return difference(of(node.left), of(node.right.of))
        return of(node.left).join(of(node.right), "doc_id", "left_semi")

    return of(node)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_id", "left_anti")
