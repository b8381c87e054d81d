"""Predicates and ranked filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_term(column: str, terms: list[str]) -> Column:
    low = F.lower(F.col(column))
    return reduce(lambda a, b: a | b, (low.contains(t.lower()) for t in terms), F.lit(False))


def must(fields: dict[str, list[str]]) -> Column:
    """All fields, any value of each, as lower-case substrings."""
    return reduce(lambda a, b: a & b, (any_term(c, v) for c, v in fields.items()), F.lit(True))


def should_share(fields: dict[str, list[str]]) -> Column:
    """Share of the optional clauses that match."""
    clauses = [any_term(c, [t]).cast("int") for c, v in fields.items() for t in v]
    return reduce(lambda a, b: a + b, clauses, F.lit(0)) / max(1, len(clauses))


def boolean_search(df: DataFrame, score: Column, must_have: dict, should: dict, must_not: dict, weight: float = 0.2) -> DataFrame:
    """Rows that have all of ``must_have`` and none of ``must_not``, with ``score`` raised by the share of ``should``."""
    none = reduce(lambda a, b: a | b, (any_term(c, v) for c, v in must_not.items()), F.lit(False))
    return df.where(must(must_have) & ~none).withColumn("score", score * (1 + weight * should_share(should)))


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page (from 1) of the ordered rows."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
