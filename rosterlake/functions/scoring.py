"""How well a work answers a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of a person's best works, best first.
TOP_WORK_WEIGHTS = (1.0, 0.6, 0.35, 0.2, 0.1)


def query_terms(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: F.char_length(t) > 2)


def keyword_overlap(query_tokens: Column, text_tokens: Column) -> Column:
    """Share of the query's different terms that the text has."""
    terms = F.array_distinct(query_terms(query_tokens))
    return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, text_tokens)) / F.size(terms)).otherwise(0.0)


def phrase_overlap(query_tokens: Column, text_tokens: Column) -> Column:
    """1 if the query's terms, at least two, stand in the text in one string.  The
    text keeps its short words, so a query with one inside does not match itself."""
    terms = query_terms(query_tokens)
    found = (F.size(terms) >= 2) & F.array_join(text_tokens, " ").contains(F.array_join(terms, " "))
    return F.when(found, 1.0).otherwise(0.0)


def work_score(semantic: Column, title: Column, abstract: Column, title_phrase: Column, abstract_phrase: Column) -> Column:
    phrase = F.greatest(title_phrase, F.lit(0.5) * abstract_phrase)
    return F.lit(0.65) * semantic + F.lit(0.2) * title + F.lit(0.1) * abstract + F.lit(0.05) * phrase


def discounted(score: Column, place: Column, k: int) -> Column:
    """A work's part in the sum of the best k; no more than five count."""
    weights = F.array(*[F.lit(w) for w in TOP_WORK_WEIGHTS])
    return F.when(place <= min(k, len(TOP_WORK_WEIGHTS)), score * F.get(weights, place - 1)).otherwise(0.0)


def discounted_sum(scores: Column, k: int) -> Column:
    """The same over an array of scores, summed best first."""
    best = F.slice(F.sort_array(scores, asc=False), 1, min(k, len(TOP_WORK_WEIGHTS)))
    weights = F.array(*[F.lit(w) for w in TOP_WORK_WEIGHTS])
    return F.aggregate(F.transform(best, lambda s, i: s * F.get(weights, i)), F.lit(0.0), lambda a, x: a + x)
