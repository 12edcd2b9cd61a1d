"""Date and time expressions: Spanish dates in text, Lima's clock, relative ages.

Lima keeps UTC-5 all year. Civil dates are DATE columns; instants are strings
with an offset until they are stored as TIMESTAMP.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfare.functions.text import extracted, fold, looked_up
from wayfare.functions.vocabulary import MONTHS, SPACE, YEAR_ROLLS_AFTER_DAYS

LIMA_OFFSET = "-05:00"
RANGE = "struct<start:date,end:date,raw:string>"

_S = SPACE + "+"
_DAY = r"(\d{1,2})"
_MONTH = f"({'|'.join(MONTHS)})"
_YEAR = rf"(?:{_S}de{_S}(\d{{4}}))?"
# The patterns of announced dates, from the most to the least specific.
CROSS_MONTH = rf"(?:del|desde el){_S}{_DAY}{_S}de{_S}{_MONTH}{_YEAR}{_S}(?:al|hasta el){_S}{_DAY}{_S}de{_S}{_MONTH}{_YEAR}"
SAME_MONTH = rf"del{_S}{_DAY}{_S}al{_S}{_DAY}{_S}de{_S}{_MONTH}{_YEAR}"
OPEN_START = rf"a partir del{_S}{_DAY}{_S}de{_S}{_MONTH}{_YEAR}"
SINGLE = rf"\b{_DAY}{_S}de{_S}{_MONTH}(?:{_S}del?{_S}(\d{{4}}))?"
FULL_DATE = rf"{_DAY}{_S}de{_S}{_MONTH}{_S}de{_S}(\d{{4}})"


def month_number(name: Column) -> Column:
    return looked_up(name, {k: str(v) for k, v in MONTHS.items()}).cast("int")


def real_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if the month doesn't have the day."""
    first = F.make_date(year, month, F.lit(1))
    return F.when(day.between(1, F.dayofmonth(F.last_day(first))), F.date_add(first, day - 1))


def resolved_year(explicit: Column, month: Column, day: Column, posted: Column) -> Column:
    """The year said; else the post's, or the next if that day would lie long before the post. A day past the month's end counts on into the next."""
    candidate = F.date_add(F.make_date(F.year(posted), month, F.lit(1)), day - 1)
    return F.when(explicit.isNotNull(), explicit).when(candidate < F.date_sub(posted, YEAR_ROLLS_AFTER_DAYS), F.year(posted) + 1).otherwise(F.year(posted))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _groups(match: Column, pattern: str, n: int) -> Column:
    """All groups of a pattern that matches the whole text, as an array; a group that took no part is empty."""
    return F.split(F.regexp_replace(match, pattern, "|".join(f"${i}" for i in range(1, n + 1))), r"\|")


def _number(groups: Column, i: int) -> Column:
    return F.nullif(F.get(groups, F.lit(i - 1)), F.lit("")).cast("int")


def _month(groups: Column, i: int) -> Column:
    return month_number(F.get(groups, F.lit(i - 1)))


def date_range(text: Column, posted: Column, folded: Column | None = None) -> Column:
    """The dates that Spanish text announces, as ``RANGE``; null without any.

    Patterns go from the most to the least specific. Each has its first match
    tried only; one that isn't a real date gives way to the next pattern. The
    text is folded once, unless that is at hand, and searched once per pattern
    that is reached, and whose words it has.
    """

    def found(start: Column, end: Column | None, raw: Column) -> Column:
        ok = start.isNotNull() if end is None else start.isNotNull() & end.isNotNull()
        return F.when(ok, F.struct(start.alias("start"), (F.lit(None).cast("date") if end is None else end).alias("end"), raw.alias("raw")))

    def start_of(g: Column, day: int, month: int, year: int) -> Column:
        d, m = _number(g, day), _month(g, month)
        return real_date(resolved_year(_number(g, year), m, d, posted), m, d)

    def cross(g: Column, raw: Column) -> Column:
        d, m = _number(g, 4), _month(g, 5)
        year = F.coalesce(_number(g, 6), resolved_year(_number(g, 3), m, d, posted))
        return found(start_of(g, 1, 2, 3), real_date(year, m, d), raw)

    def same(g: Column, raw: Column) -> Column:
        m = _month(g, 3)
        return found(start_of(g, 1, 3, 4), real_date(resolved_year(_number(g, 4), m, _number(g, 1), posted), m, _number(g, 2)), raw)

    def alone(g: Column, raw: Column) -> Column:
        return found(start_of(g, 1, 2, 3), None, raw)

    def tried(t: Column, pattern: str, n: int, read: Callable[[Column, Column], Column]) -> Column:
        return _let(F.regexp_extract(t, pattern, 0), lambda raw: F.when(raw != "", _let(_groups(raw, pattern, n), lambda g: read(g, raw))))

    def has(t: Column, *words: str) -> Column:
        return reduce(or_, [t.contains(w) for w in words])

    def read(t: Column) -> Column:
        return F.coalesce(
            F.when(has(t, "del", "desde el") & has(t, "al", "hasta el"), tried(t, CROSS_MONTH, 6, cross)),
            F.when(has(t, "del") & has(t, "al"), tried(t, SAME_MONTH, 4, same)),
            F.when(has(t, "a partir del"), tried(t, OPEN_START, 3, alone)),
            tried(t, SINGLE, 3, alone),
        )

    return _let(fold(text), read) if folded is None else read(folded)


def ends_before(found: Column, day: Column) -> Column:
    return F.coalesce(found["end"], found["start"]) < day


def spanish_date(text: Column) -> Column:
    """The first full date in the text; null if there is none or it isn't real."""
    read = lambda g: real_date(_number(g, 3), _month(g, 2), _number(g, 1))
    return _let(F.regexp_extract(fold(text), FULL_DATE, 0), lambda raw: F.when(raw != "", _let(_groups(raw, FULL_DATE, 3), read)))


def day_start(day: Column) -> Column:
    return F.when(day.isNotNull(), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(f"T00:00:00{LIMA_OFFSET}")))


def day_end(day: Column) -> Column:
    return F.when(day.isNotNull(), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(f"T23:59:00{LIMA_OFFSET}")))


def dmy_text(text: Column) -> Column:
    """The first dd/MM/yyyy as yyyy-MM-dd, calendar unchecked; null without any."""
    pattern = r"(\d{2})/(\d{2})/(\d{4})"
    return F.regexp_replace(extracted(text, pattern, 0), pattern, "$3-$2-$1")


def dmy_time_text(text: Column) -> Column:
    """The first dd/MM/yyyy H:mm as an instant at Lima's offset; null without any."""
    pattern = r"(\d{2})/(\d{2})/(\d{4})\s+(\d{1,2}):(\d{2})"
    padded = F.regexp_replace(extracted(text, pattern, 0), pattern, f"$3-$2-$1T0$4:$5:00{LIMA_OFFSET}")
    return F.regexp_replace(padded, r"T0(\d{2}:)", "T$1")


def dashed_date(text: Column) -> Column:
    """dd-MM-yyyy as a date; null if it isn't real."""
    pattern = r"^(\d{2})-(\d{2})-(\d{4})$"
    year, month, day = (extracted(text, pattern, i).cast("int") for i in (3, 2, 1))
    return F.when(month.between(1, 12), real_date(year, F.when(month.between(1, 12), month), day))


def relabelled_utc(text: Column) -> Column:
    """A Lima wall clock written as UTC, with its true offset."""
    return F.regexp_replace(text, r"(\.\d+)?Z$", LIMA_OFFSET)


def end_after_start(start: Column, end: Column) -> Column:
    """The end, unless it isn't after the start."""
    return F.when(instant(end) > instant(start), end)


def instant(text: Column) -> Column:
    """An ISO date and time with an offset as a timestamp; anything else is null."""
    return F.when(is_instant(text), text.try_cast("timestamp"))


def is_instant(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})$")


def lima_day(now: Column, days: int = 0) -> Column:
    return F.date_add(F.to_date(now - F.expr("interval 5 hours")), days)


def default_window(now: Column, days: int = 30) -> tuple[Column, Column]:
    """From the start of Lima's day to the end of the one ``days`` later."""
    return (
        F.concat(F.date_format(lima_day(now), "yyyy-MM-dd"), F.lit(f"T00:00:00{LIMA_OFFSET}")),
        F.concat(F.date_format(lima_day(now, days), "yyyy-MM-dd"), F.lit(f"T23:59:59{LIMA_OFFSET}")),
    )


def lima_clock(at: Column) -> Column:
    return at - F.expr("interval 5 hours")


def is_whole_day(at: Column) -> Column:
    """Whether Lima's clock shows the first or last minute of a day."""
    return F.date_format(lima_clock(at), "HH:mm").isin("00:00", "23:59")


WEEKDAYS = ("lun", "mar", "mié", "jue", "vie", "sáb", "dom")
MONTH_NAMES = ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "set", "oct", "nov", "dic")


def display_time(at: Column) -> Column:
    """Weekday, day, month and year in Spanish, with the time unless it is a whole day."""
    local = lima_clock(at)
    day = F.concat(
        F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(local) + 1), F.lit(", "), F.dayofmonth(local).cast("string"), F.lit(" "),
        F.element_at(F.array(*map(F.lit, MONTH_NAMES)), F.month(local)), F.lit(" "), F.year(local).cast("string"),
    )
    return F.when(is_whole_day(at), day).otherwise(F.concat(day, F.lit(", "), F.date_format(local, "HH:mm")))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def relative_age(at: Column, now: Column) -> Column:
    """How long ago, in Spanish; the future counts as now."""
    minutes = F.greatest(half_up((F.unix_micros(now) - F.unix_micros(at)) / 60e6), F.lit(0))
    hours = half_up(minutes / 60)
    return (
        F.when(minutes < 1, F.lit("hace un momento"))
        .when(minutes < 60, F.concat(F.lit("hace "), minutes.cast("string"), F.lit(" min")))
        .when(hours < 48, F.concat(F.lit("hace "), hours.cast("string"), F.lit(" h")))
        .otherwise(F.concat(F.lit("hace "), half_up(hours / 24).cast("string"), F.lit(" días")))
    )


def iso_utc(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
