"""Singular/plural forms of keywords by rule, with an override table for irregular words."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words the rules would get wrong, both directions.
IRREGULAR = {
    "gas": "gases",
    "gases": "gas",
    "bus": "buses",
    "buses": "bus",
    "analysis": "analyses",
    "analyses": "analysis",
}

# Fixed value: keywords up to this length are matched only as they stand.
SHORT_WORD = 5


def _ends(word: Column, *endings: str) -> Column:
    return functools.reduce(operator.or_, [word.endswith(e) for e in endings])


def _without(word: Column, n: int) -> Column:
    return F.left(word, F.length(word) - n)


def singular(word: Column | str) -> Column:
    """The singular of a plural word by rule, any other word as it is."""
    word = F.col(word) if isinstance(word, str) else word
    return (
        F.when(word.endswith("ies") & (F.length(word) > 4), F.concat(_without(word, 3), F.lit("y")))
        .when(_ends(word, "sses", "xes", "zes", "ches", "shes"), _without(word, 2))
        .when(word.endswith("s") & ~_ends(word, "ss", "us", "is"), _without(word, 1))
        .otherwise(word)
    )


def plural(word: Column | str) -> Column:
    """The plural of a singular word by rule."""
    word = F.col(word) if isinstance(word, str) else word
    after_consonant = word.endswith("y") & F.substring(word, -2, 1).isin(list("bcdfghjklmnpqrstvwxz"))
    return (
        F.when(after_consonant & (F.length(word) > 1), F.concat(_without(word, 1), F.lit("ies")))
        .when(_ends(word, "s", "x", "z", "ch", "sh"), F.concat(word, F.lit("es")))
        .otherwise(F.concat(word, F.lit("s")))
    )


def other_number(word: str, one: str, irregular: Mapping[str, str] = IRREGULAR) -> Column:
    """The singular of a plural word, the plural of any other.

    Takes the names of two columns, the word and its ``singular``, so that the rules are worked out once per word.
    """
    by_rule = F.when(F.col(one) != F.col(word), F.col(one)).otherwise(plural(word))
    if not irregular:
        return by_rule
    table = F.create_map(*[F.lit(x) for pair in irregular.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(word)), by_rule)
