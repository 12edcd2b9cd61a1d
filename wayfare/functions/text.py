"""String expressions: folding, slugs, labels, joins of parts."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARKS = "".join(map(chr, range(0x0300, 0x0370)))


@cache
def fold_table() -> tuple[str, str]:
    """Precomposed letters that are a single character once their marks are gone, and those characters; then the marks themselves, for nothing."""
    pairs = []
    for point in range(0x80, 0x10000):
        letter = chr(point)
        if 0xAC00 <= point <= 0xD7A3 or 0xD800 <= point <= 0xDFFF or letter in _MARKS:
            continue
        bare = "".join(c for c in unicodedata.normalize("NFD", letter) if c not in _MARKS)
        if bare != letter and len(bare) == 1:
            pairs.append((letter, bare))
    return "".join(a for a, _ in pairs) + _MARKS, "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without diacritics; ASCII has none, so only other text is searched for them."""
    letters, bare = fold_table()
    lower = F.lower(text)
    return F.when(F.length(text) == F.octet_length(text), lower).otherwise(F.translate(lower, letters, bare))


def slug(text: Column) -> Column:
    """Folded, runs of anything but a-z and 0-9 as one hyphen, none at the ends; null if nothing is left."""
    joined = F.regexp_replace(fold(text), "[^a-z0-9]+", "-")
    return F.nullif(F.regexp_replace(joined, "^-+|-+$", ""), F.lit(""))


def spanish_slug(text: Column) -> Column:
    """The slug of the backfill: only Spanish letters are folded."""
    folded = F.lower(F.translate(text, "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunaeiouun"))
    return F.nullif(F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def looked_up(code: Column, values: Mapping[str, str], fallback: Column | None = None) -> Column:
    """The value of a code; unknown codes give the fallback, or null."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for item in values.items() for x in item]), code)
    return found if fallback is None else F.coalesce(found, fallback)


def category_label(category: Column) -> Column:
    from wayfare.functions.vocabulary import CATEGORY_LABELS

    return looked_up(category, CATEGORY_LABELS, F.concat(F.upper(F.substring(category, 1, 1)), F.substring(category, 2, 1 << 30)))


def source_label(source: Column) -> Column:
    from wayfare.functions.vocabulary import SOURCE_LABELS

    return looked_up(source, SOURCE_LABELS, source)


def state_label(state: Column) -> Column:
    from wayfare.functions.vocabulary import CANCELLED_LABEL, STATE_LABELS

    return looked_up(state, STATE_LABELS, F.lit(CANCELLED_LABEL))


def joined_parts(*parts: Column) -> Column:
    """Parts that are neither null nor empty, with a middle dot between them."""
    return F.concat_ws(" · ", *[F.nullif(p, F.lit("")) for p in parts])


def extracted(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def absolute_url(href: Column, origin: str) -> Column:
    return F.when(href.startswith("http"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(F.concat(F.lit(origin), href))


def is_web_url(url: Column) -> Column:
    return url.rlike(r"^https?://[^\s/]+")


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^\\ufeff+", "")


def json_class(body: Column, shape: str = "array", field: str | None = None) -> Column:
    """What a captured body is: ``ok``, ``not-json``, or ``wrong-shape``: JSON of another kind than ``shape`` (array or object), or whose first element (itself, if an object) lacks ``field``. Null for a null body."""
    parsed = F.try_parse_json(body)
    kind = F.lower(F.regexp_extract(F.schema_of_variant(parsed), r"^(\w+)", 1))
    fits = kind == shape
    if field is not None:
        path = f"$[0].{field}" if shape == "array" else f"$.{field}"
        empty = F.lit(False) if shape == "object" else F.schema_of_variant(parsed) == "ARRAY<VOID>"
        fits &= empty | F.try_variant_get(parsed, path, "string").isNotNull()
    return F.when(body.isNull(), None).when(parsed.isNull(), "not-json").when(F.coalesce(fits, F.lit(False)), "ok").otherwise("wrong-shape")


def require(condition: Column, value: Column, message: str | Column) -> Column:
    """The value; a row for which the condition isn't true fails the query with the message."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message) if isinstance(message, str) else message))
