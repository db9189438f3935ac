"""Scores as column expressions."""

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Words that do not count as fabricated.
FILLERS = tuple(
    "the a an is are was were be been have has had do does did will would can could shall should may might must and or but if then so to of in for on at by with from as into that this it its i we you they my our your their not no yes".split()
)


def edits(a: Sequence[str], b: Sequence[str]) -> int:
    """Levenshtein distance of two lists of words, a column of the table at a time as the bits of whole numbers."""
    if not len(a) or not len(b):
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    every, last, distance = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    more, less = every, 0  # where a cell is one above, one below the one before it
    for word in b:
        met = places.get(word, 0)
        level = (((met & more) + more) ^ more) | met | less
        up, down = less | (every & ~(level | more)), more & level
        distance += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & every, down << 1 & every
        more, less = down | (every & ~(met | less | up)), up & (met | less)
    return distance


@F.pandas_udf(IntegerType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Levenshtein distance of two arrays of words, in Arrow batches; null for a null array."""
    return pd.Series([None if x is None or y is None else edits(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits per word of the reference; for an empty reference 0 or 1."""
    return F.when(F.size(reference) == 0, F.when(F.size(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(word_distance(reference, hypothesis) / F.size(reference))


def fabricated(reference: Column, hypothesis: Column) -> Column:
    """Words of the hypothesis, repeats included, that are neither in the reference nor fillers."""
    fillers = F.array(*map(F.lit, FILLERS))
    return F.size(F.filter(hypothesis, lambda w: ~F.array_contains(reference, w) & ~F.array_contains(fillers, w)))


def citation_precision(found: Column, expected: Column) -> Column:
    correct = F.size(F.array_intersect(found, expected))
    return F.when((F.size(found) > 0) & (F.size(expected) > 0), correct / F.size(found)).when((F.size(found) == 0) & (F.size(expected) == 0), 1.0).otherwise(0.0)


def citation_recall(found: Column, expected: Column) -> Column:
    hits = F.size(F.filter(expected, lambda e: F.array_contains(found, e)))
    return F.when(F.size(expected) > 0, hits / F.size(expected)).otherwise(1.0)
