"""Text functions for search: normal form, trigrams, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, and what search takes them for; the last four of FROM have no counterpart and are deleted.
FROM = "çäžşňüöýÇÄŽŞŇÜÖÝёЁıİабвгдежзийклмнопрстуфхцчшщыэюяАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯъьЪЬ"
TO = "cajsnuoycajsnuoyeeiiabvgdejziiklmnoprstufhccssyeuaabvgdejziiklmnoprstufhccssyeua"


def search_norm(text: Column) -> Column:
    """Lower case, letters mapped to plain ones, all else to single spaces, trimmed; null is empty."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), FROM, TO)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9 ]+", " "), " +", " "))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a normalised text, each word with two spaces before it and one behind."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, 3)))))


def word_similarity(query: Column, text: Column) -> Column:
    """The share of the query's trigrams that the text has: an approximation of the best-extent measure."""
    q = trigrams(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, trigrams(text))) / F.size(q)).otherwise(0.0)
