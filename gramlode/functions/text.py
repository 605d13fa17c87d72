"""Text cleaning, boiler-plate trimming and n-grams as built-in column expressions.

Builders that name their argument ``tokens`` read it several times. Give them an attribute made by an earlier
``select`` and not a long expression: Catalyst keeps such projections apart, so the tokens are made once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Adverts with at most MIN_TOKENS tokens give nothing; MARGIN tokens are cut at either end of the others.
MIN_TOKENS = 100
MARGIN = 51

# Fixed value: a word (inner hyphens and apostrophes kept) or any other single non-space character. The repeated group is
# possessive, which changes no match but is a loop and no recursion, so that long chains do not overflow the stack.
TOKEN_RE = r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*+|[^\s\p{L}\p{N}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def clean_tokens(text: Column | str) -> Column:
    """Lower-case words of ``a-z``; every other character separates."""
    # one space per run of other characters leaves at most one empty piece at either end
    spaced = F.regexp_replace(F.lower(_col(text)), "[^a-z]+", " ")
    return F.array_remove(F.split(spaced, " "), "")


def trim_boilerplate(tokens: Column | str) -> Column:
    """Drop the head and tail of an advert.

    More than two margins: the middle is kept. One token over the minimum: the tail cut removes a single token, because
    the tail is counted back from a shorter list. Otherwise nothing is left.
    """
    tokens = _col(tokens)
    n = F.size(tokens)
    return (
        F.when(n > 2 * MARGIN, F.slice(tokens, F.lit(MARGIN + 1), n - 2 * MARGIN))
        .when(n == MIN_TOKENS + 1, F.slice(tokens, MARGIN + 1, MIN_TOKENS - MARGIN))
        .otherwise(_no_strings())
    )


def ngrams(tokens: Column | str, n: int = 2) -> Column:
    """Neighbouring tokens joined by one space, ``n`` at a time."""
    tokens = _col(tokens)
    last = F.size(tokens) - (n - 1)
    if n == 2:
        grams = F.zip_with(
            F.slice(tokens, F.lit(1), last),
            F.slice(tokens, F.lit(2), last),
            lambda a, b: F.concat(a, F.lit(" "), b),
        )
    else:
        grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(last > 0, grams).otherwise(_no_strings())


def all_grams(tokens: Column | str) -> Column:
    """Bigrams and single words together, duplicates kept."""
    return F.concat(ngrams(tokens, 2), _col(tokens))


def raw_tokens(text: Column | str) -> Column:
    """Tokens with case and punctuation kept."""
    return F.regexp_extract_all(_col(text), F.lit(TOKEN_RE), F.lit(0))


def snippet_text(text: Column | str) -> Column:
    """The whole advert, lower-cased, every character outside a-z replaced by a space of its own."""
    return F.regexp_replace(F.lower(_col(text)), "[^a-zA-Z ]", " ")


def explode_rows(df: DataFrame, keep: list[str], items: Column, name: str) -> DataFrame:
    """One row per array item.

    The outer form is used on purpose: with the inner one the optimizer adds a ``size(items) > 0`` filter and pushes it
    to the scan, which builds the whole array twice per row.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def with_clean_tokens(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    return df.select(*keep, clean_tokens(text).alias("tokens"))


def with_trimmed_tokens(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    return with_clean_tokens(df, keep, text).select(*keep, trim_boilerplate("tokens").alias("tokens"))


def with_raw_tokens(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    return df.select(*keep, raw_tokens(text).alias("tokens"))


def _pair_rows(df: DataFrame, keep: list[str], tokens: str) -> DataFrame:
    """``(keep…, word, bigram)`` per token, the bigram null at the last one.

    The strings are joined after the explode, where the concat is compiled into the loop that uses them; a lambda over
    the array would be interpreted.
    """
    after = F.slice(tokens, F.lit(2), F.size(tokens))
    pairs = F.when(F.size(tokens) > 0, F.arrays_zip(F.col(tokens).alias("a"), after.alias("b")))
    rows = explode_rows(df, keep, pairs, "_pair")
    return rows.select(*keep, F.col("_pair.a").alias("word"), F.concat("_pair.a", F.lit(" "), "_pair.b").alias("bigram"))


def token_gram_rows(
    df: DataFrame, keep: list[str], tokens: str = "tokens", starts: DataFrame | None = None
) -> DataFrame:
    """``(keep…, gram)``: the bigrams and single words of a token column, duplicates kept.

    ``starts`` is a small table of words: only grams that begin with one of them are made. It is broadcast.
    """
    rows = _pair_rows(df, keep, tokens)
    if starts is not None:
        rows = rows.join(F.broadcast(starts), "word", "left_semi")
    return rows.select(*keep, F.stack(F.lit(2), "word", "bigram").alias("gram")).where(F.col("gram").isNotNull())


def gram_rows(df: DataFrame, keep: list[str], text: str, starts: DataFrame | None = None) -> DataFrame:
    """``(keep…, gram)``: the single words and bigrams of every trimmed advert."""
    return token_gram_rows(with_trimmed_tokens(df, keep, text), keep, starts=starts)


def bigram_rows(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(bigram)`` for every neighbouring pair in a token column."""
    return _pair_rows(df, [], tokens).select("bigram").where(F.col("bigram").isNotNull())
