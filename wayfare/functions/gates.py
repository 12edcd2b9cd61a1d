"""Rule gates over text: which posts announce a disruption of a road."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfare.functions import vocabulary as V
from wayfare.functions.text import fold


@dataclass(frozen=True)
class Vocabulary:
    """Alternatives of a trigger and of a road's context, and how near they must be, both from their first characters."""

    triggers: str = V.DISRUPTION_TRIGGERS
    context: str = V.ROAD_CONTEXT
    window: int = V.TRIGGER_CONTEXT_WINDOW
    closure: str = V.CLOSURE_PREFIXES

    @property
    def proximity(self) -> str:
        """Looks ahead from each trigger and from each term of context, nearest first, so no positions are joined."""
        trigger, road, gap = rf"(?:{self.triggers})\b", rf"(?:{self.context})", f".{{0,{self.window}}}?"
        return rf"(?s)\b(?={trigger})(?={gap}\b{road})|\b(?={road})(?={gap}\b{trigger})"


ROADS = Vocabulary()


def distinct_matches(folded: Column, alternatives: str) -> Column:
    """Different matches in order of their first places."""
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(rf"\b({alternatives})\b"), F.lit(1)))


def trigger_keywords(folded: Column, vocabulary: Vocabulary = ROADS) -> Column:
    return distinct_matches(folded, vocabulary.triggers)


def has_trigger(folded: Column, vocabulary: Vocabulary = ROADS) -> Column:
    return folded.rlike(rf"\b(?:{vocabulary.triggers})\b")


def near_road(folded: Column, vocabulary: Vocabulary = ROADS) -> Column:
    return folded.rlike(vocabulary.proximity)


def rejection(folded: Column, vocabulary: Vocabulary = ROADS) -> Column:
    """no-trigger, no-road-context, or null for text that passes."""
    return F.when(~has_trigger(folded, vocabulary), F.lit("no-trigger")).when(~near_road(folded, vocabulary), F.lit("no-road-context"))


def closure_category(keywords: Column, vocabulary: Vocabulary = ROADS) -> Column:
    return F.when(F.exists(keywords, lambda k: k.rlike(vocabulary.closure)), F.lit("road_closure")).otherwise(F.lit("road_work"))


def road_mentions(text: Column, pattern: str = V.ROAD_MENTION, keep: int = V.ROAD_MENTIONS_KEPT) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.slice(F.array_distinct(F.transform(found, lambda m: F.trim(m))), 1, keep)


def in_lima(folded: Column) -> Column:
    # All names begin with a letter, so ends of words are passed over.
    return folded.rlike(rf"\b(?=[a-z])(?:{V.LIMA_CONTEXT})\b")


def passes_listing(title: Column, description: Column, vocabulary: Vocabulary = ROADS) -> Column:
    return has_trigger(fold(F.concat(title, F.lit("\n"), F.coalesce(description, F.lit("")))), vocabulary)


def arteries(folded: Column) -> Column:
    return F.array_compact(F.array(*[F.when(folded.rlike(pattern), F.lit(name)) for name, pattern in V.ARTERIES]))


def past_hits(folded: Column) -> Column:
    return distinct_matches(folded, V.PAST_TENSE)
