"""Clock times, weekdays and dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotatlas.functions.patterns import look, word_tree
from slotatlas.rules import DAY_SHORT, DAY_WORDS, DAYS


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    Inside a lambda every mention of an outer expression is evaluated again for
    each element; a one-element transform binds it to a variable instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def minutes(c, strict: bool = False) -> Column:
    """``H:MM`` / ``HH:MM`` to minutes; null when it is not a clock time.

    The default accepts any two-digit parts (``25:70``); ``strict`` does not.
    """
    digits = F.split(F.regexp_extract(F.trim(col(c)), r"^(\d{1,2}:\d{2})$", 1), ":")
    # The text is mentioned once, so a derived column behind it is computed once.
    total = F.aggregate(digits, F.lit(0), lambda acc, x: acc * 60 + x.try_cast("int"))
    if strict:
        return F.when(F.trim(col(c)).rlike(r"^(?:[01]?\d|2[0-3]):[0-5]\d$"), total)
    return total


def duration(start, end) -> Column:
    return minutes(end) - minutes(start)


def clock(total) -> Column:
    """Minutes to ``HH:MM``; runs past ``24:00`` like the data it reads."""
    total = col(total).cast("int")
    return F.concat(F.lpad(F.floor(total / 60).cast("string"), 2, "0"), F.lit(":"),
                    F.lpad((total % 60).cast("string"), 2, "0"))


def end_time(start, length) -> Column:
    """Start plus a duration in minutes as ``HH:MM``."""
    return clock(minutes(start) + col(length).cast("int"))


def pad_clock(c) -> Column:
    """``9.05`` or ``9:05`` to ``09:05``."""
    return F.lpad(F.regexp_replace(col(c), r"[.h]", ":"), 5, "0")


def _day_map(langs) -> Column:
    pairs = {}
    for words in DAY_WORDS.values():
        for i, word in enumerate(words):
            pairs[word] = DAYS[i]
    for lang in langs:
        for i, word in enumerate(DAY_SHORT[lang]):
            pairs.setdefault(word, DAYS[i])
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def day_normalize(c, lang: str | None = None) -> Column:
    """English weekday named by a token of the text, or null.

    Tokens match as whole words, also in the plural ("montags"), so "do" inside
    "Domino" is no day. Two-letter forms count only when the language is known.
    """
    langs = [lang] if lang in DAY_SHORT else []
    words = [w for ws in DAY_WORDS.values() for w in ws] + [w for x in langs for w in DAY_SHORT[x]]
    pattern = word_tree(words)
    found = F.regexp_extract(F.lower(col(c)), rf"{look(pattern)}(?<!\p{{L}})({pattern})s?(?!\p{{L}})", 1)
    return F.try_element_at(_day_map(langs), found)


def day_word_regex(min_length: int = 3) -> str:
    """Alternation of all day words of at least this length, longest first."""
    return word_tree(w for ws in DAY_WORDS.values() for w in ws if len(w) >= min_length)


def day_name(date) -> Column:
    """English weekday of a date or timestamp, independent of any locale."""
    return F.get(F.array(*[F.lit(d) for d in DAYS]), F.weekday(col(date)))


def day_index(day) -> Column:
    """Monday 0 … Sunday 6, anything else 99."""
    pos = F.array_position(F.array(*[F.lit(d) for d in DAYS]), col(day)).cast("int")
    return F.when(pos > 0, pos - 1).otherwise(F.lit(99))


def weekday_of_text(c) -> Column:
    """Weekday of ``dd/mm/yyyy``, an ISO date or an ISO timestamp."""
    text = F.trim(col(c))
    parsed = F.coalesce(
        F.try_to_timestamp(F.regexp_extract(text, r"(\d{2}/\d{2}/\d{4})", 1), F.lit("dd/MM/yyyy")),
        F.try_to_timestamp(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")))
    return day_name(parsed)


def iso_timestamp(c) -> Column:
    """Local clock reading of an ISO text: zone suffix and fractions are cut."""
    head = F.regexp_extract(col(c), r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?)", 1)
    text = F.regexp_replace(head, " ", "T")
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
                      F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm")))


def next_occurrence(today, day, start, end) -> tuple[Column, Column]:
    """Start and end of the next such weekday strictly after ``today``; no end = +1 h."""
    date = F.call_function("next_day", col(today), F.substring(col(day), 1, 3))
    base = date.cast("timestamp")
    first = base + F.make_dt_interval(mins=minutes(start))
    last = F.when(minutes(end).isNotNull(), base + F.make_dt_interval(mins=minutes(end))) \
        .otherwise(first + F.expr("INTERVAL 1 HOUR"))
    return first, last


def in_horizon(ts, today, days: int = 7) -> Column:
    """Starts between today 00:00 and the end of the day ``days`` later."""
    day = F.to_date(col(ts))
    return (day >= col(today)) & (day <= F.date_add(col(today), days))


LANG_FORMATS = {"de": "dd.MM.yyyy", "fr": "dd.MM.yyyy", "it": "dd.MM.yyyy", "en": "dd/MM/yyyy"}


def format_date(c, lang: str = "de") -> Column:
    """Localized day text; '' when it is no date."""
    parsed = F.try_to_timestamp(F.substring(col(c).cast("string"), 1, 10), F.lit("yyyy-MM-dd"))
    return F.coalesce(F.date_format(parsed, LANG_FORMATS.get(lang, "dd/MM/yyyy")), F.lit(""))
