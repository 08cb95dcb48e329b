"""Boolean retrieval: a query language of AND, OR, NOT and parentheses, compiled to a predicate.

Operators are in upper case; words side by side mean AND; NOT binds closest, then AND, then OR. A word goes through the
analyzer: what vanishes there is ignored, and what becomes several terms is their conjunction.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.analyzer import analyze
from quillon.operators.index import Index


class QuerySyntaxError(ValueError):
    """A query that is not of the language."""


@dataclass(frozen=True)
class Term:
    name: str


@dataclass(frozen=True)
class Not:
    part: Node


@dataclass(frozen=True)
class And:
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Or:
    parts: tuple[Node, ...]


Node = Term | Not | And | Or


def _join(kind: type[And] | type[Or], parts: list[Node | None]) -> Node | None:
    left = tuple(p for p in parts if p is not None)
    return kind(left) if len(left) > 1 else left[0] if left else None


def parse(query: str, analyzer: Callable[[str], list[str]] = analyze) -> Node | None:
    """The tree of a query; None if nothing of it is left."""
    words = re.findall(r"[()]|[^\s()]+", query)
    words.reverse()  # the next one is the last
    ahead = lambda: words[-1] if words else None

    def operand() -> Node | None:
        turns = 0
        while ahead() == "NOT":
            words.pop()
            turns += 1
        if ahead() in (None, "AND", "OR", ")"):
            raise QuerySyntaxError(f"expected a term, found {ahead()!r}")
        word = words.pop()
        if word == "(":
            node = group()
            if ahead() is None:
                raise QuerySyntaxError("missing closing parenthesis")
            words.pop()
        else:
            node = _join(And, [Term(t) for t in analyzer(word)])
        for _ in range(turns if node is not None else 0):
            node = Not(node)
        return node

    def group() -> Node | None:
        """Up to a closing parenthesis or the end: alternatives of conjunctions."""
        alternatives = [[operand()]]
        while ahead() not in (None, ")"):
            if ahead() == "OR":
                words.pop()
                alternatives.append([operand()])
            else:
                if ahead() == "AND":
                    words.pop()
                alternatives[-1].append(operand())
        return _join(Or, [_join(And, a) for a in alternatives])

    if not words:
        return None
    tree = group()
    if words:
        raise QuerySyntaxError(f"unexpected {ahead()!r} in query")
    return tree


def terms_of(node: Node | None) -> list[str]:
    if node is None:
        return []
    if isinstance(node, Term):
        return [node.name]
    parts = (node.part,) if isinstance(node, Not) else node.parts
    return sorted({t for p in parts for t in terms_of(p)})


def holds(node: Node, present: Callable[[str], object], land: Callable, lor: Callable, lnot: Callable) -> object:
    """The value of a tree, of Booleans or of Columns."""
    if isinstance(node, Term):
        return present(node.name)
    if isinstance(node, Not):
        return lnot(holds(node.part, present, land, lor, lnot))
    return reduce(land if isinstance(node, And) else lor, [holds(p, present, land, lor, lnot) for p in node.parts])


def matches_without_terms(node: Node) -> bool:
    """Whether a document with none of the query's terms matches, as for NOT x."""
    return bool(holds(node, lambda _: False, lambda a, b: a and b, lambda a, b: a or b, lambda a: not a))


def boolean_matches(index: Index, query: str) -> DataFrame:
    """(doc_ord) of all documents that match.

    The postings of the query's terms become one row of flags for each document, on which the tree is a predicate. Only a
    query that also matches documents without any of its terms has to see the table of all documents.
    """
    node = parse(query, lambda w: analyze(w, index.remove_stopwords, index.stem))
    if node is None:
        return index.doc_stats.select("doc_ord").where(F.lit(False))
    names = terms_of(node)
    flags = index.postings.where(F.col("term").isin(names)).groupBy("doc_ord").agg(*[F.max(F.col("term") == t).alias(f"t{k}") for k, t in enumerate(names)])
    if matches_without_terms(node):
        flags = index.doc_stats.select("doc_ord").join(flags, "doc_ord", "left")
    at = {t: F.coalesce(F.col(f"t{k}"), F.lit(False)) for k, t in enumerate(names)}
    predicate = holds(node, at.__getitem__, Column.__and__, Column.__or__, Column.__invert__)
    return flags.where(predicate).select("doc_ord")


def boolean_search(index: Index, query: str, k: int = 10) -> DataFrame:
    """(rank, doc_ord, score, total): the first k matches in the order of documents; there is no score."""
    if k < 0:
        raise ValueError("k must not be negative")
    found = boolean_matches(index, query)
    total = found.agg(F.count("*").alias("total"))
    first = found.orderBy("doc_ord").limit(k).agg(F.sort_array(F.collect_list("doc_ord")).alias("ids"))  # k rows
    return first.crossJoin(total).select(F.posexplode("ids").alias("rank", "doc_ord"), "total").select((F.col("rank") + 1).cast("long").alias("rank"), "doc_ord", F.lit(None).cast("double").alias("score"), "total")
