"""Scoring of answers and grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import number_matches, numbers_in


def rate(flag: Column, of: Column | None = None, digits: int = 4) -> Column:
    """Share of rows with the flag among those of the condition; null without any."""
    x = F.when(flag, 1.0).otherwise(0.0)
    return F.round(F.avg(x if of is None else F.when(of, x)), digits)


def summary(results: DataFrame, key: str, flags: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """Counts and rates of each group."""
    return results.groupBy(key).agg(F.count("*").alias("n"), *(rate(f, c).alias(n) for n, (f, c) in flags.items()))


def precision_recall(found: Column, gold: Column) -> dict[str, Column]:
    """Precision, recall and equality of two arrays as sets; null where the denominator is empty."""
    shared = F.size(F.array_intersect(found, gold))
    return {
        "precision": F.when(F.size(found) > 0, shared / F.size(F.array_distinct(found))),
        "recall": F.when(F.size(gold) > 0, shared / F.size(F.array_distinct(gold))),
        "exact": (F.size(F.array_except(found, gold)) == 0) & (F.size(F.array_except(gold, found)) == 0),
    }


def all_numbers_stated(text: Column, expected: Column) -> Column:
    """whether each expected number is among the text's numbers; null if none is expected."""
    have = numbers_in(text)
    return F.when(F.size(expected) > 0, F.forall(expected, lambda e: F.exists(have, lambda a: number_matches(a, e))))


def plan_signature(text: Column) -> dict[str, Column]:
    """in order, tokens of four digits are periods, other tokens of two characters or more metrics."""
    tokens = F.split(F.trim(text), r"\s+")
    year = lambda x: x.rlike(r"^\d{4}$")
    return {"periods": F.transform(F.filter(tokens, year), lambda x: x.cast("int")), "metrics": F.filter(tokens, lambda x: ~year(x) & (F.length(x) > 1))}
