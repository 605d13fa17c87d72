"""Keyword counts per advert.

``key`` names the columns that identify one advert; they are unique per advert, so no group is larger than one advert's
text. Columns in ``carry`` depend on the key and are taken along.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlode.functions.sampling import hash_sample
from gramlode.functions.text import explode_rows, gram_rows, snippet_text, with_trimmed_tokens
from gramlode.operators.membership import Forms, bloom_filter, hashed_forms
from gramlode.operators.sizing import fits_broadcast, heavy_hitters, lookup_join
from gramlode.session import spread_by_size, stored

# A dictionary up to this many surface forms, of this many bytes, may be written into the plan as a hash table.
INLINE_FORMS, INLINE_BYTES = 250_000, 8 << 20

# One advert in so many is looked at to find the grams that are hot. That decides how rows are joined, not which.
HOT_SAMPLE = 64

# Up to this many base words the wide counts are plain conditional sums.
FEW_COLUMNS = 64


def gram_counts(adverts: DataFrame, key: list[str], text: str) -> DataFrame:
    """Every single word and bigram of every advert with its count.

    All grams come from the advert's own row. The adverts are moved to their key before the grams are made, and the
    count then needs no shuffle of its own: the text crosses the network once instead of its several times larger grams.
    A task gets so much text that its table of grams stays small, whatever the number of adverts.
    """
    placed = spread_by_size(adverts.select(*key, text), text, *key)
    return gram_rows(placed, key, text).groupBy(*key, "gram").agg(F.count(F.lit(1)).alias("n"))


def first_words(dictionary: DataFrame) -> DataFrame:
    """``(word)``: how the surface forms begin."""
    return dictionary.select(F.substring_index("surface", " ", 1).alias("word"))


def hits(
    adverts: DataFrame,
    dictionary: DataFrame,
    key: list[str],
    text: str,
    carry: list[str] | None = None,
    small: bool | None = None,
) -> DataFrame:
    """One row per gram found in ``dictionary`` (a stored table with a ``surface`` column) and per row it has there.

    With a dictionary within the broadcast bound, words with which no surface form begins are dropped before any gram is
    built. With a larger one, grams that a filter of all forms rules out are dropped before the shuffle, and the hot
    grams are joined where they are made.
    """
    keep = [*key, *(carry or [])]
    if small is None:
        small = fits_broadcast(dictionary)
    if small:
        return lookup_join(gram_rows(adverts, keep, text, first_words(dictionary)), dictionary, "gram", "surface", small=True)
    looked_at = adverts.where(F.pmod(F.xxhash64(*key), F.lit(HOT_SAMPLE)) == 0)
    hot = heavy_hitters(gram_rows(looked_at, key, text), "gram")
    bloom = bloom_filter(dictionary, "surface")
    grams = gram_rows(adverts, keep, text)
    return lookup_join(grams, dictionary, "gram", "surface", small=False, hot=hot, may_hold=bloom and bloom.may_hold)


def surface_counts(adverts: DataFrame, surfaces: DataFrame, key: list[str], text: str, **join) -> DataFrame:
    """Count per advert and surface form; a single word inside a matched bigram counts too."""
    found = hits(adverts, surfaces.select("surface"), key, text, **join)
    return found.groupBy(*key, "gram").agg(F.count(F.lit(1)).alias("n"))


def keyword_counts(
    adverts: DataFrame, matches: DataFrame, key: list[str], text: str, carry: list[str] | None = None, **join
) -> DataFrame:
    """Count per advert, technology and base word: all surface forms of a base word together.

    The grams are matched where they are made; only one row per advert, technology and base word is shuffled.
    """
    found = hits(adverts, matches, key, text, carry, **join)
    return found.groupBy(*key, *(carry or []), "tech", "base").agg(F.count(F.lit(1)).alias("n"))


def wide_counts(counts: DataFrame, bases: list[str], key: list[str], n: str | None = "n") -> DataFrame:
    """One row per group of ``key``, one column per base word in sorted order, null where there was no hit.

    Takes the long counts, or with ``n=None`` the hits themselves; then the counting and the turning are one aggregate
    and one shuffle. The word list is given, so no job is run to find the columns. With many columns the pivot is used,
    which places each count by look-up instead of testing it against every column.
    """
    value = F.lit(1).cast("bigint") if n is None else F.col(n)
    bases = sorted(set(bases))
    if len(bases) > FEW_COLUMNS:
        return counts.groupBy(*key).pivot("base", bases).agg(F.sum(value))
    return counts.groupBy(*key).agg(*[F.sum(F.when(F.col("base") == b, value)).alias(b) for b in bases])


def long_counts(wide: DataFrame, bases: list[str], key: list[str]) -> DataFrame:
    """The wide counts turned back."""
    return wide.unpivot(key, bases, "base", "n").where(F.col("n").isNotNull())


def _field(value: Column) -> Column:
    """A value as a field of a ``|``-separated line, quoted where needed."""
    plain = value.rlike(r"""^[^|"\r\n\\]+$""")
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(plain, value).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def count_lines(counts: DataFrame, keywords: DataFrame, key: list[str], file: list[str], job_id: str) -> DataFrame:
    """The long counts of all technologies as ready lines ``(tech, file…, part, line)``, a header for every technology and
    file: ``job_id|word|word|…`` with the technology's words in sorted order, blank where there was no hit.

    ``file`` names the columns among ``key`` that make up an output file. A header has part 0 and comes first. The words
    come from the stored table ``keywords`` by join, so the number of jobs does not depend on the number of technologies, and no
    list of words is read into the program.
    """
    words = keywords.groupBy("tech").agg(F.sort_array(F.collect_set("base")).alias("bases"))
    words = F.broadcast(words) if fits_broadcast(keywords) else words
    rows = counts.groupBy("tech", *key, job_id).agg(F.map_from_entries(F.collect_list(F.struct("base", "n"))).alias("found"))
    cells = F.transform("bases", lambda base: F.coalesce(F.try_element_at("found", base).cast("string"), F.lit("")))
    line = F.concat(_field(F.col(job_id).cast("string")), F.lit("|"), F.array_join(cells, "|"))
    body = rows.join(words, "tech").select("tech", *file, F.lit(1).alias("part"), line.alias("line"))
    names = F.concat(F.lit("job_id|"), F.array_join(F.transform("bases", _field), "|"))
    heads = counts.select("tech", *file).distinct().join(words, "tech")
    return heads.select("tech", *file, F.lit(0).alias("part"), names.alias("line")).unionByName(body)


def advert_techs(found: DataFrame, key: list[str]) -> DataFrame:
    """Technologies hit per advert, from hits or counts."""
    return found.groupBy(*key).agg(F.sort_array(F.collect_set("tech")).alias("techs"))


def _in_dictionary(surfaces: DataFrame) -> Forms | None:
    """The surface forms as a table inside the plan; None when they must stay a table of their own."""
    forms = surfaces.select("surface").distinct()
    if not fits_broadcast(forms, rows=INLINE_FORMS, size=INLINE_BYTES):
        return None
    return hashed_forms(forms, "surface")


def found_forms(tokens: str, forms: Forms) -> Column:
    """The grams of a token column that are among ``forms``, duplicates kept.

    A hash look-up per word and per pair of words, at the same cost for any number of forms.
    """
    pairs = F.arrays_zip(F.col(tokens).alias("a"), F.slice(tokens, F.lit(2), F.size(tokens)).alias("b"))
    grams = F.flatten(F.transform(pairs, lambda p: F.array(p["a"], F.concat(p["a"], F.lit(" "), p["b"]))))
    return F.when(F.size(tokens) > 0, F.filter(grams, lambda gram: gram.isNotNull() & forms.holds(gram)))


def _by_key(adverts: DataFrame, keys: DataFrame, key: list[str], how: str) -> DataFrame:
    """``adverts`` joined with a stored table of keys. Few keys are broadcast; with many, adverts that a filter of the keys
    rules out are dropped in the scan, so that hardly any other text moves."""
    if fits_broadcast(keys):
        return adverts.join(F.broadcast(keys), key, how)
    bloom = bloom_filter(keys, *key)
    kept = adverts if bloom is None else adverts.where(bloom.may_hold(*key))
    return kept.join(keys.hint("merge"), key, how)


def _sure_hit(adverts: DataFrame, surfaces: DataFrame, key: list[str], text: str) -> Column:
    """Whether the ``tokens`` of an advert hold one of the dictionary's hot words. Hot words are found in a part of the adverts;
    they decide which way a hit is found, not whether."""
    looked_at = adverts.where(F.pmod(F.xxhash64(*key), F.lit(HOT_SAMPLE)) == 0)
    words = [gram for gram in heavy_hitters(gram_rows(looked_at, key, text), "gram") if " " not in gram]
    hot = [row.surface for row in surfaces.where(F.col("surface").isin(words)).distinct().collect()] if words else []
    return F.arrays_overlap("tokens", F.array(*[F.lit(w) for w in sorted(hot)])) if hot else F.lit(False)


def adverts_with_hits(adverts: DataFrame, surfaces: DataFrame, key: list[str], text: str) -> DataFrame:
    """The adverts with at least one dictionary hit.

    A dictionary that can be part of the plan is looked up inside the advert's row: nothing is exploded and nothing moves.
    A larger one gives the set of keys with a hit first; an advert with one of its hot words has one for certain, and only the
    grams of the others are made.
    """
    forms = _in_dictionary(surfaces)
    if forms is None:
        known = surfaces.select("surface")
        sure = _sure_hit(adverts, known, key, text)
        tokens = with_trimmed_tokens(adverts, [*key, text], text).select(*key, text, F.size("tokens").alias("_n"), sure.alias("_sure"))
        # stored, so that texts are cut into tokens once and few of them are looked at again
        unsure = F.when((F.col("_n") > 0) & ~F.col("_sure"), F.col(text)).alias(text)
        marked = stored(tokens.select(*key, unsure, "_sure"), "hit-marks")
        left = marked.where(F.col(text).isNotNull()).select(*key, text)
        found = marked.where("_sure").select(*key).unionByName(hits(left, known, key, text).select(*key))
        return _by_key(adverts, stored(found.distinct(), "hit-keys"), key, "left_semi")
    trimmed = with_trimmed_tokens(adverts, adverts.columns, text)
    # the first hit stands for all; as a generator it keeps the test from being pushed into the tokenizer
    first = F.slice(found_forms("tokens", forms), 1, 1)
    return explode_rows(trimmed, adverts.columns, first, "_gram").drop("_gram")


def _repeated_keys(adverts: DataFrame, key: list[str]) -> DataFrame | None:
    """The keys that more than one advert has, as a stored table; None without any. Only the keys are read."""
    counted = adverts.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)
    table = stored(counted, "repeated-keys")
    return None if table.isEmpty() else table


def _row_hits(
    adverts: DataFrame, matches: DataFrame, key: list[str], wanted: list[str], text: str, forms: Forms, p: float
) -> DataFrame:
    """The sampled hits of every advert, found in its own row, ``(wanted…, tech, base)``. Two forms of one base word in an
    advert are one hit: that of the first form, which the row can tell, so that no text moves.

    A text is cleaned once for all its hits as ``_jobtext`` when every hit is taken; of a sample, later and only where needed.
    """
    keep = wanted
    if p >= 1:
        adverts = adverts.select(*wanted, snippet_text(text).alias("_jobtext"))
        keep = [*wanted, "_jobtext"]
    trimmed = with_trimmed_tokens(adverts, keep, text).select(*keep, F.array_distinct(found_forms("tokens", forms)).alias("_found"))
    rows = explode_rows(trimmed, [*keep, "_found"], F.col("_found"), "gram")
    together = matches.groupBy("tech", "base").agg(F.collect_set("surface").alias("_forms"))
    known = stored(together.select("tech", "base", "_forms", F.explode("_forms").alias("surface")), "matches")
    matched = lookup_join(rows, known, "gram", "surface").where(hash_sample(p, *key, "tech", "base"))
    # coalesce: or else a test that the array is not null is pushed to the scan, where it builds the array again
    first = F.array_min(F.array_intersect(F.coalesce("_found", F.array("gram")), "_forms")) == F.col("gram")
    return matched.where(first).drop("gram", "_found", "_forms")


def snippets(
    adverts: DataFrame,
    matches: DataFrame,
    key: list[str],
    text: str,
    job_id: str,
    title: str,
    occupation: str,
    p: float = 0.001,
    forms: Forms | None = None,
) -> DataFrame:
    """A repeatable sample of the (advert, technology, base word) hits with the advert's whole cleaned text.

    Columns ``(key…, tech, job_id, keyword, job_title, occupation, jobtext)``. With a dictionary that can be part of the plan
    the hits are found inside the advert's row and sampled right there, so only sampled texts are ever moved. With a
    larger one the sampled keys fetch their texts. ``forms`` skips the size check.
    """
    forms = _in_dictionary(matches) if forms is None else forms
    attributes = list(dict.fromkeys([job_id, title, occupation, text]))
    wanted = [*key, *(a for a in attributes if a not in key)]
    one = [*key, "tech", "base"]
    if forms is None:
        sampled = hits(adverts, matches, key, text).where(hash_sample(p, *one))
        rows = _by_key(adverts.select(*wanted), stored(sampled.select(*one).distinct(), "sampled-keys"), key, "inner")
    else:
        repeated = _repeated_keys(adverts, key)
        if repeated is None:
            rows = _row_hits(adverts, matches, key, wanted, text, forms, p)
        elif fits_broadcast(repeated):
            among = functools.reduce(operator.and_, [adverts[k].eqNullSafe(repeated[k]) for k in key])
            once, often = (adverts.join(F.broadcast(repeated), among, how) for how in ("left_anti", "left_semi"))
            once, often = (_row_hits(part, matches, key, wanted, text, forms, p) for part in (once, often))
            rows = once.unionByName(often.dropDuplicates(one))
        else:
            rows = _row_hits(adverts, matches, key, wanted, text, forms, p).dropDuplicates(one)
    return rows.select(
        *key,
        "tech",
        F.col(job_id).cast("string").alias("job_id"),
        F.col("base").alias("keyword"),
        F.col(title).alias("job_title"),
        F.col(occupation).alias("occupation"),
        (F.col("_jobtext") if "_jobtext" in rows.columns else snippet_text(text)).alias("jobtext"),
    )
