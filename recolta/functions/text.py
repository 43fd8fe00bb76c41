"""Text and array expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# Words that are no topics, and words that are no tokens.
TOPIC_STOPWORDS = "this that with from have will about there would could should their because while where".split()
TOKEN_STOPWORDS = "the and for that with this from your you are was were have has had will can not but about into https http www com".split()


def text_or_empty(c: str | Column) -> Column:
    """The string, '' for null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def py_or(c: Column, default: float) -> Column:
    """c, or the default where c is null or zero."""
    return F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(c)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def collapse(c: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_text(c: Column, most: int = 2000) -> Column:
    return F.substring(collapse(text_or_empty(c)), 1, most)


def clip(c: Column, size: int, strip: bool = True) -> Column:
    """Collapsed; a longer text is cut to size - 3 characters and gets an ellipsis."""
    made = collapse(text_or_empty(c))
    cut = F.substring(made, 1, size - 3)
    return F.when(F.length(made) > size, F.concat(F.rtrim(cut) if strip else cut, F.lit("..."))).otherwise(made)


def first_words(c: Column, n: int = 140) -> Column:
    made = collapse(text_or_empty(c))
    return F.when(made == "", "").otherwise(F.array_join(F.slice(F.split(made, " "), 1, n), " "))


def distinct_first(c: Column, n: int) -> Column:
    """The first n different elements in their order."""
    return F.slice(F.array_distinct(c), 1, n)


def topics(c: Column) -> Column:
    words = F.transform(F.regexp_extract_all(text_or_empty(c), F.lit("[A-Za-z][A-Za-z0-9_#@-]{2,}"), 0), F.lower)
    return distinct_first(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*TOPIC_STOPWORDS)), 8)


def entities(c: Column) -> Column:
    return distinct_first(F.regexp_extract_all(text_or_empty(c), F.lit(r"(@[A-Za-z0-9_]+|#[A-Za-z0-9_]+|\b[A-Z]{2,}\b)"), 0), 8)


def semantic_group(topic: Column, entity: Column) -> Column:
    """Twelve hex digits of the first topics and entities; null without any."""
    seed = F.array_join(F.concat(F.slice(topic, 1, 3), F.slice(entity, 1, 2)), "|")
    return F.when(seed != "", F.substring(F.sha1(seed), 1, 12))


def tokens(c: Column) -> Column:
    """Lower-case search tokens without stopwords, repeated ones kept."""
    found = F.transform(F.regexp_extract_all(text_or_empty(c), F.lit(r"[A-Za-z0-9_@#][A-Za-z0-9_@#\-/.:]{1,40}"), 0), F.lower)
    return F.filter(found, lambda t: ~t.isin(*TOKEN_STOPWORDS))


def _marked() -> tuple[str, str]:
    """Small Latin letters with marks and what they are without; the marks themselves, which have no counterpart, at the end."""
    parts = {c: unicodedata.normalize("NFD", c) for c in map(chr, range(0xC0, 0x1F00)) if c == c.lower()}
    base = {c: d[0] for c, d in parts.items() if len(d) > 1 and "a" <= d[0] <= "z"}
    return "".join(base) + "".join(map(chr, range(0x300, 0x370))), "".join(base.values())


MARKED, UNMARKED = _marked()


def folded(c: Column) -> Column:
    """Lower case, Latin letters without diacritics."""
    return F.translate(F.lower(c), MARKED, UNMARKED)


def terms(c: Column) -> Column:
    """Index terms: lower case, split at all but letters and digits."""
    return F.filter(F.split(F.lower(text_or_empty(c)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(query: str, most: int = 16) -> list[str]:
    """The first terms of a query, all of which must match."""
    import re

    return [t.lower() for t in re.findall(r"[^\W_]+", query)][:most]


def embedding_text(text: Column, captions: Column, tags: Column, author: Column, words: int = 512) -> Column:
    """Text, captions, tags and author as one text of at most `words` words."""
    parts = F.concat_ws(" ", text, F.concat_ws(" ", captions), F.concat_ws(" ", tags), author)
    return first_words(parts, words)


def json_list(c: Column) -> Column:
    """A JSON list of strings; [] where it is none."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def json_object(c: Column) -> Column:
    """A JSON object as a map of strings; {} where it is none."""
    made = F.when(F.ltrim(c).startswith("{"), F.from_json(c, "map<string,string>"))
    return F.coalesce(made, F.create_map().cast("map<string,string>"))


def iso_time(c: Column) -> Column:
    """An ISO time as an instant, null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))
