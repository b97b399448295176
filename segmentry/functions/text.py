"""Text cleaning, casing and keyword predicates as native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from segmentry.functions import constants as K
from segmentry.functions.columns import let, split_list

def _lowered(value: Column) -> Column:
    return F.lower(F.coalesce(value.cast("string"), F.lit("")))


def _blank(text: Column, pattern: str, *hints: str) -> Column:
    """Matches replaced by a blank; texts without any hint skip the pattern."""
    def replace(t: Column) -> Column:
        hit = F.contains(t, F.lit(hints[0]))
        for hint in hints[1:]:
            hit = hit | F.contains(t, F.lit(hint))
        return F.when(hit, F.regexp_replace(t, pattern, " ")).otherwise(t)

    return let(text, replace)


def _kept(words: Column, stopwords: Sequence[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stopwords))


def _runs(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def description_words(value: Column, stopwords: Sequence[str] = K.CATALOG_STOPWORDS) -> Column:
    """Cleaned words of a description, a word equal to the one before it dropped.

    Blanking all but letters and hyphens, splitting, stripping hyphens and dropping
    short words is one search for runs that start and end with a letter.
    """
    text = _blank(_lowered(value), K.URL, "http", "www.")
    text = _blank(text, "(?U)" + K.EMAIL, "@")
    text = _blank(text, K.HTML_TAG, "<")
    return let(_kept(_runs(text, "[a-z][a-z-]+[a-z]"), stopwords), lambda words: F.filter(
        words, lambda w, i: (i == 0) | (w != F.get(words, i - 1))))


def clean_description(value: Column, stopwords: Sequence[str] = K.CATALOG_STOPWORDS) -> Column:
    """Description reduced to meaningful lower-case words."""
    return F.array_join(description_words(value, stopwords), " ")


def clean_review(value: Column, stopwords: Sequence[str] = K.REVIEW_STOPWORDS) -> Column:
    """Review reduced to meaningful lower-case words; repeats are kept."""
    text = _blank(_lowered(value), K.URL, "http", "www.")
    return F.array_join(_kept(_runs(text, "[a-z][a-z'-]+[a-z]"), stopwords), " ")


def genre_terms(value: Column, stopwords: Sequence[str] = K.CATALOG_STOPWORDS) -> Column:
    """Genre words written twice, which doubles their weight in a corpus."""
    words = _kept(_runs(_lowered(value), "[a-z-]{3,}"), stopwords)
    return let(F.array_join(words, " "),
               lambda genres: F.trim(F.concat(genres, F.lit(" "), genres)))


def corpus_text(description: Column, genres: Column | None) -> Column:
    """Cleaned description followed by the genre terms; titles stay out on purpose."""
    cleaned = clean_description(description)
    if genres is None:
        return cleaned
    return F.trim(F.concat(cleaned, F.lit(" "), genre_terms(genres)))


def title_case(value: Column) -> Column:
    """Upper-case the first letter of each run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(value, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda run: F.concat(
        F.upper(F.substring(run, 1, 1)), F.lower(F.substr(run, F.lit(2))))), "")


def capitalize(value: Column) -> Column:
    """First character upper-case, everything after it lower-case."""
    return F.concat(F.upper(F.substring(value, 1, 1)), F.lower(F.substr(value, F.lit(2))))


def is_useful_keyword(keyword: Column) -> Column:
    """Keyword is neither empty nor generic and holds a letter."""
    word = F.lower(F.trim(keyword))
    return (word != F.lit("")) & ~word.isin(*K.GENERIC_KEYWORDS) & word.rlike("[a-zA-Z]")


def clip_example(value: Column, limit: int = 250) -> Column:
    """Example on one line; longer than `limit` -> cut with three dots at the end."""
    text = F.replace(value, F.lit("\n"), F.lit(" "))
    return F.when(F.length(text) > limit,
                  F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def complaint_label(keywords: Column) -> Column:
    """First three keywords in title case, or a general label."""
    terms = F.slice(split_list(keywords), 1, 3)
    label = F.array_join(F.transform(terms, title_case), " / ")
    return F.when(F.size(terms) > 0, label).otherwise(F.lit("Player complaint"))
