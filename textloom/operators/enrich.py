"""Enrichment of texts: language, tags, sections, taxonomy."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Frequent function words of the languages told apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are with as be at by this have from or an but not they which you we their has".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este sí".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec cette ces".split(),
}
_WORD = re.compile(r"[^\W\d_]+")


def guess_language(text: str | None) -> str:
    """Language by the share of function words, 'zh' by Han characters, 'unknown' where neither decides."""
    if not text:
        return "unknown"
    han = sum("一" <= c <= "鿿" for c in text)
    if han * 3 > len(text):
        return "zh"
    words = _WORD.findall(text.lower())
    scores = sorted(((sum(w in set_ for w in words), code) for code, set_ in _SETS.items()), reverse=True)
    return scores[0][1] if words and scores[0][0] * 12 >= len(words) and scores[0][0] > scores[1][0] else "unknown"


_SETS = {code: frozenset(words) for code, words in FUNCTION_WORDS.items()}


@F.pandas_udf(T.StringType())
def language(texts: pd.Series) -> pd.Series:
    return texts.map(guess_language)


def ascii_bounded(pattern: str) -> str:
    """The pattern between ASCII word boundaries, the same in every engine."""
    return f"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def _named(name: str):
    return lambda v: F.concat(F.lit(f"{name}:"), v)


def regex_tags(text: Column, rules: dict[str, str]) -> Column:
    """Sorted distinct 'name:value' of all matches; the value is group 1 of the rule's pattern, else the whole match."""
    found = []
    for name, pattern in rules.items():
        group = 1 if re.compile(pattern).groups else 0
        found.append(F.transform(F.regexp_extract_all(text, F.lit(pattern), group), _named(name)))
    return F.array_sort(F.array_distinct(F.concat(*found))) if found else F.array().cast("array<string>")


def first_section(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Name of the first rule whose pattern matches, else null."""
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in rules], F.lit(None).cast("string"))


def taxonomy_tags(text: Column, taxonomy: dict[str, list[str]]) -> Column:
    """Sorted categories of which any term occurs in the text, letter case aside."""
    low = F.lower(text)
    hit = [F.when(F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(low, t)), F.lit(name)) for name, terms in sorted(taxonomy.items())]
    return F.array_compact(F.array(*hit)) if hit else F.array().cast("array<string>")


def enrich_stats(df: DataFrame, language_col: str, tags_col: str, section_col: str) -> DataFrame:
    """One row: rows, rows with tags, rows with a section, tags in all, and a map of languages to counts."""
    by_language = df.groupBy(F.coalesce(language_col, F.lit("unknown")).alias("l")).agg(F.count("*").alias("n"), F.count_if(F.size(tags_col) > 0).alias("t"), F.count_if(F.col(section_col).isNotNull()).alias("s"), F.sum(F.size(tags_col)).alias("k"))
    zero = F.lit(0).cast("bigint")
    return by_language.agg(
        F.coalesce(F.sum("n"), zero).alias("enriched"), F.coalesce(F.sum("t"), zero).alias("tagged"), F.coalesce(F.sum("s"), zero).alias("with_section"), F.coalesce(F.sum("k"), zero).alias("tags"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("l", "n")))).alias("languages"),
    )
