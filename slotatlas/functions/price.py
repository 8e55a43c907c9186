"""Amounts and prices as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotatlas import rules as R
from slotatlas.functions.patterns import led
from slotatlas.functions.text import hash_fraction
from slotatlas.functions.timefn import col, let


def parse_price(c) -> Column:
    """Number of a loosely typed price; the lower bound of a range; null if unusable."""
    text = col(c).cast("string")
    return F.regexp_extract(text, r"^(\d+(?:\.\d+)?)", 1).try_cast("double")


def any_real_price(fields) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(parse_price(f) >= 0, F.lit(False)) for f in fields])


def pricing_struct(fields: dict[str, Column], source, currency: str = "CHF") -> Column:
    """Clean pricing struct from loosely typed fields."""
    return F.struct(*[parse_price(v).alias(k) for k, v in fields.items()],
                    F.lit(currency).alias("currency"), F.lit(True).alias("verified"),
                    F.nullif(col(source), F.lit("")).alias("source"))


def _lower_words(pattern: str) -> str:
    """The pattern for lower-case text; its escapes are lower case already."""
    return pattern.lower()


def _numbers(text: Column, bounds) -> Column:
    """Amounts of a text in lower case, pattern by pattern."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(_lower_words(p)), F.lit(1)) for p in R.AMOUNT_PATTERNS])
    values = F.transform(found, lambda s: F.replace(s, F.lit(","), F.lit(".")).try_cast("double"))
    return F.filter(values, lambda v: (v >= bounds[0]) & (v <= bounds[1]))


def amounts(text) -> Column:
    """All currency amounts of a text in the seven notations."""
    return let(F.lower(col(text)), lambda t: F.when(t.rlike(r"\d"), _numbers(t, R.AMOUNT_BOUNDS)).otherwise(
        F.array().cast("array<double>")))


_HIT, _END = "\x01", "\x02"  # marks; a text that holds them has blanks there


def near_keyword(text, pattern: str, chars: int = R.NEAR_CHARS, bounds=R.NEAR_BOUNDS) -> Column:
    """Lowest amount within ``chars`` of any hit of the keyword pattern.

    One pass marks the hits, and the text is cut at the marks once. The window of a hit is put together from the pieces
    around it, as many as can fill it, so the time grows with the hits and not with hits times text. The text is
    searched in lower case, which plain patterns match faster.
    """
    def windows(parts, plain):
        def window(i):
            first = F.greatest(i - chars, F.lit(0))
            before = F.transform(F.slice(plain, first + 1, i - first), lambda p: F.right(p, F.lit(chars)))
            after = F.transform(F.slice(plain, i + 2, F.lit(chars)), lambda p: F.left(p, F.lit(chars)))
            own = F.get(parts, i)  # hit, mark, text up to the next hit
            gap = F.concat(F.left(F.split_part(own, F.lit(_END), F.lit(-1)), F.lit(chars)), F.array_join(after, ""))
            return F.concat(F.right(F.array_join(before, ""), F.lit(chars)), F.split_part(own, F.lit(_END), F.lit(1)), F.left(gap, F.lit(chars)))

        lowest = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: let(window(i), lambda w: F.when(
            w.rlike(r"\d"), F.array_min(_numbers(w, bounds)))))
        return F.array_min(lowest)

    def scan(t):
        marked = F.regexp_replace(t, f"({led(pattern.lower())})", f"{_HIT}$1{_END}")
        return let(F.split(marked, _HIT, -1), lambda parts: F.when(F.size(parts) > 1, let(
            F.transform(parts, lambda p: F.replace(p, F.lit(_END))), lambda plain: windows(parts, plain))))

    def unmarked(t):
        return F.when(F.contains(t, F.lit(_HIT)) | F.contains(t, F.lit(_END)), F.translate(t, _HIT + _END, "  ")).otherwise(t)

    return let(let(F.lower(col(text)), unmarked), scan)


def free_trial(text) -> Column:
    """A trial word and a free word in the same sentence, outside config noise."""
    guard = "|".join(g.replace(".", r"\.") for g in R.FREE_TRIAL_GUARD)

    def hit(t, p):
        # 50 characters around the first hit, without a search that backs up at every position
        def around(sides):
            context = F.concat(F.right(F.get(sides, F.lit(0)), F.lit(50)), F.regexp_extract(t, p, 0),
                               F.left(F.get(sides, F.lit(1)), F.lit(50)))
            return ~context.rlike(guard)
        return F.when(t.rlike(p), let(F.split(t, p, 2), around)).otherwise(F.lit(False))

    clean = F.regexp_replace(F.lower(col(text)), led(R.FREE_TRIAL_NOISE), "")
    return let(clean, lambda t: reduce(lambda a, b: a | b, [hit(t, led(p)) for p in R.FREE_TRIAL_PATTERNS]))


def amount_fallback(found, price_page) -> Column:
    """Classify sorted distinct amounts by range; nulls off price pages."""
    sorted_values = F.filter(F.array_sort(F.array_distinct(col(found))), lambda a: (a >= 10) & (a <= 500))

    def tens(values, single):
        near = F.filter(values, lambda t: (t >= 140) & (t <= 450)
                        & (single.isNull() | ((t >= 6 * single) & (t <= 13 * single))))
        return F.get(near, F.lit(0))

    def months(values, single, ten):
        kept = F.filter(values, lambda a: (a >= 80) & (a <= 400) & (a > F.coalesce(single, F.lit(0.0)))
                        & (ten.isNull() | (a != ten)))
        return F.when((F.size(values) >= 3) & (F.size(kept) > 0), F.element_at(kept, -1))

    def classify(values):
        ok = col(price_page) & (F.size(values) >= 2)
        first = F.get(F.filter(values, lambda a: (a >= 15) & (a <= 55)), F.lit(0))
        return let(first, lambda single: let(tens(values, single), lambda ten: F.struct(
            F.when(ok, single).alias("single"), F.when(ok, ten).alias("card_10"),
            F.when(ok, months(values, single, ten)).alias("monthly"))))

    return let(sorted_values, classify)


def pct_change(old, new) -> Column:
    """Absolute change in percent; null without a usable old value."""
    old, new = col(old), col(new)
    return F.when((old != 0) & new.isNotNull(), F.abs(new - old) / old * 100)


def signed_pct(old, new) -> Column:
    old, new = col(old), col(new)
    return F.when((old != 0) & new.isNotNull(), (new - old) / old * 100)


def change_severity(pct) -> Column:
    return F.when(col(pct) > R.CHANGE_PCT_HIGH, F.lit("high")).when(col(pct) > R.CHANGE_PCT, F.lit("medium"))


def round_half_up(c) -> Column:
    return F.floor(col(c) + 0.5)


def tier_estimate(field: str, tier, seed, name, tags) -> Column:
    """Deterministic estimate of one price from a tier range.

    Banker's rounding after every step: range position, ×1.15 hot, ×0.90 small
    or community, up to +10 % from eight tags on.
    """
    n = F.size(col(tags))
    low = F.lower(col(name))
    hot = F.contains(low, F.lit("hot")) | F.exists(col(tags), lambda t: F.contains(F.lower(t), F.lit("hot")))
    small = F.contains(low, F.lit("community")) | F.contains(low, F.lit("verein")) | (n <= 2)

    def bounds(i):
        return F.when(col(tier) == "major", F.lit(R.TIER_RANGES["major"][field][i])) \
            .when(col(tier) == "medium", F.lit(R.TIER_RANGES["medium"][field][i])) \
            .otherwise(F.lit(R.TIER_RANGES["small"][field][i]))

    v = F.rint(bounds(0) + (bounds(1) - bounds(0)) * hash_fraction(seed))
    v = F.when(hot, F.rint(v * 1.15)).otherwise(v)
    v = F.when(small, F.rint(v * 0.90)).otherwise(v)
    bump = F.lit(1) + F.lit(0.02) * F.least(n - 7, F.lit(5))
    return F.when(n >= 8, F.rint(v * bump)).otherwise(v)
