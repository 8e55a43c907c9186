"""Strings, HTML text, slugs and tags as Column expressions."""

from __future__ import annotations

from functools import reduce
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotatlas.functions.patterns import led
from slotatlas.functions.timefn import col, let
from slotatlas.rules import SLUG_PREFIX, SLUG_SUFFIXES

#: Character references: decimal, hexadecimal, named.
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def _named() -> Column:
    """Names of the standard's table that end in a semicolon; nbsp is a blank here.

    One literal, looked up as a map from its front: names that pages use come first, then the older short table.
    """
    names = {name[:-1]: text for name, text in html5.items() if name.endswith(";")} | {"nbsp": " "}
    usual = ["amp", "nbsp", "quot", "lt", "gt", "apos"]
    order = dict.fromkeys([*usual, *sorted(name2codepoint), *sorted(names)])
    spelled = "\x01".join(f"{name}\x02{names[name]}" for name in order)
    return F.str_to_map(F.lit(spelled), F.lit("\x01"), F.lit("\x02"))


def _character(ref: Column) -> Column:
    """Character of a reference; an unknown name stays as it is, an impossible number becomes U+FFFD."""
    body = F.substring(ref, 2, 40)
    number = F.coalesce(F.regexp_extract(body, r"^#([0-9]+);", 1).try_cast("int"),
                        F.conv(F.nullif(F.regexp_extract(body, r"^#[xX]([0-9a-fA-F]+);", 1), F.lit("")), 16, 10).try_cast("int"))
    possible = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    one = F.decode(F.unhex(F.lpad(F.hex(F.when(possible, number).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
    return F.when(number.isNotNull(), one).otherwise(
        F.coalesce(F.try_element_at(_named(), F.regexp_extract(body, r"^([A-Za-z0-9]+);", 1)), ref))


def _decode(c: Column) -> Column:
    """Every reference once, in one pass."""
    def joined(refs: Column) -> Column:
        return F.array_join(F.transform(F.split(c, REFERENCE, -1), lambda piece, i: F.concat(
            piece, F.coalesce(_character(F.get(refs, i)), F.lit("")))), "")
    return let(F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0)), joined)


def unescape(c) -> Column:
    """Named and numeric character references decoded; nothing is decoded twice."""
    return let(col(c), lambda t: F.when(F.contains(t, F.lit("&")), _decode(t)).otherwise(t))


def squash(c) -> Column:
    return F.trim(F.regexp_replace(col(c), r"[\s ]+", " "))


def up_to_last(c, closer: str, edit) -> Column:
    """``edit`` applied to the text up to the last ``closer`` (lower case; found in any case).

    What follows holds no whole element, so a search that starts at an open tag always ends at a closing one: many open
    tags without an end cost no more than any other text.
    """
    def split(t: Column) -> Column:
        return let(F.regexp_extract(t, rf"(?is)^.*{closer}", 0), lambda head: F.when(head == "", t).otherwise(
            F.concat(edit(head), F.substring(t, F.length(head) + 1, F.length(t)))))
    return let(col(c), lambda t: F.when(F.contains(t, F.lit(closer[0])), split(t)).otherwise(t))


def without_element(c, tag: str) -> Column:
    """Elements with the tag become a blank, with all they hold."""
    return up_to_last(c, f"</{tag}>", lambda t: F.regexp_replace(t, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " "))


def without_tags(c, by: str = " ") -> Column:
    return up_to_last(c, ">", lambda t: F.regexp_replace(t, r"<[^>]+>", by))


def inner_text(c) -> Column:
    """Tags and white space to single blanks, entities decoded."""
    # a single blank stays as it is, so most texts have no match; single characters make the class a table
    space = r"\t\n\x0B\f\r\u00a0"
    plain = F.trim(F.regexp_replace(without_tags(c), rf"[{space}][ {space}]*| [ {space}]+", " "))
    return let(plain, lambda t: F.when(F.contains(t, F.lit("&")), squash(_decode(t))).otherwise(t))


def strip_tags(c) -> Column:
    """Visible text: no script or style content, tags to spaces, entities decoded."""
    return inner_text(without_element(without_element(c, "script"), "style"))


def rendered_text(c) -> Column:
    """Second text rendering: like ``strip_tags``, and without noscript content."""
    return strip_tags(without_element(c, "noscript"))


def html_escape(c) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), pairs, col(c))


def strip_edges(c, chars: str = r"\s\-–—|/:,") -> Column:
    """Trim separators at both ends."""
    return F.regexp_replace(col(c), f"^[{chars}]+|[{chars}]+$", "")


def class_name_clean(c) -> Column:
    """Drop date ranges, ``N)`` prefixes, clock ranges and ``Uhr`` / ``h``."""
    text = F.regexp_replace(col(c), led(r"\s*/?\s*\d{2}\.\d{2}\.\d{4}\s*[-–]\s*\d{2}\.\d{2}\.\d{4}"), "")
    text = F.regexp_replace(text, r"^\d+\)\s*", "")
    text = F.regexp_replace(text, r"\d{1,2}[:.]\d{2}\s*[-–—]\s*\d{1,2}[:.]\d{2}", "")
    text = F.regexp_replace(strip_edges(text), led(r"\s*\b(?:Uhr|h)\b\s*", 1), " ")
    return F.trim(text)


GLUED_CLOCK = r"\d{1,2}:\d{2}[A-Za-zÄÖÜ]"
CAMEL_HUMP = r"[a-zäöü][A-ZÄÖÜ][a-zäöü]"


def has_glued_clock(c) -> Column:
    return col(c).rlike(GLUED_CLOCK)


def has_camel_hump(c) -> Column:
    return col(c).rlike(CAMEL_HUMP)


def fold_accents(c) -> Column:
    return F.translate(col(c), "àáâãäåèéêëìíîïòóôõöùúûü", "aaaaaaeeeeiiiiooooouuuu")


def slugify(c) -> Column:
    """Accents folded, other signs dropped, blanks to single hyphens."""
    s = F.regexp_replace(fold_accents(F.lower(F.trim(col(c)))), r"[^a-z0-9\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\s+", "-"), "-+", "-")
    return F.regexp_replace(s, "^-+|-+$", "")


def slugify_plain(c) -> Column:
    """Every run of other signs becomes one hyphen."""
    s = F.regexp_replace(F.lower(F.trim(col(c))), r"[^a-z0-9]+", "-")
    return F.regexp_replace(s, "^-+|-+$", "")


def slug_candidates(entity_id, name, url) -> Column:
    """Ordered distinct slugs to look an entity up under."""
    from slotatlas.functions.urls import host_label

    slug = slugify(name)
    without = [F.when(F.endswith(slug, F.lit(s)), F.regexp_replace(slug, s + "$", ""))
               for s in SLUG_SUFFIXES]
    prefixed = F.when(~F.startswith(slug, F.lit(SLUG_PREFIX)), F.concat(F.lit(SLUG_PREFIX), slug))
    parts = F.array(col(entity_id).cast("string"), slug, *without, prefixed,
                    F.replace(slug, F.lit("-"), F.lit("")), host_label(url))
    return F.array_distinct(F.filter(parts, lambda s: s.isNotNull() & (s != "")))


def truncate_words(c, limit: int = 150, keep: int = 147) -> Column:
    """Over ``limit`` characters: cut at the last blank before ``keep`` and add dots."""
    head = F.substring(col(c), 1, keep)
    cut = F.when(head.rlike(r"(?s)\s"), F.regexp_extract(head, r"(?s)^(.*)\s", 1)).otherwise(head)
    return F.when(F.length(col(c)) > limit, F.concat(cut, F.lit("..."))).otherwise(col(c))


def int_if_whole(c) -> Column:
    """30.0 as ``30``, 29.5 as ``29.5``."""
    v = col(c)
    return F.when(v == F.floor(v), F.floor(v).cast("bigint").cast("string")).otherwise(v.cast("string"))


def any_contains(tags, term: str) -> Column:
    return F.exists(col(tags), lambda t: F.contains(F.lower(t), F.lit(term.lower())))


def tag_matches(tags, roots: list[str]) -> Column:
    """Any tag contains any of the roots (never the other way round)."""
    return F.exists(col(tags), lambda t: reduce(
        lambda a, b: a | b, [F.contains(F.lower(F.trim(t)), F.lit(r)) for r in roots]))


def other_tags(tags, terms: list[str], limit: int = 6) -> Column:
    """Tags that are not one of the terms, the first ``limit``, joined."""
    rest = F.filter(col(tags), lambda t: ~F.lower(t).isin([x.lower() for x in terms]))
    return F.array_join(F.slice(rest, 1, limit), ", ")


def top_tags(tags, n: int) -> Column:
    """First n tags and how many more there are: ``a, b +3``."""
    arr = col(tags)
    more = F.size(arr) - n
    return F.concat(F.array_join(F.slice(arr, 1, n), ", "),
                    F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(F.lit("")))


def name_sentence(names, last: str = " und ", more: str = " weitere") -> Column:
    """A / A, B und C / A, B, C, D und n weitere."""
    arr = col(names)
    n = F.size(arr)
    return (F.when(n == 0, F.lit(""))
            .when(n == 1, F.get(arr, F.lit(0)))
            .when(n <= 4, F.concat(F.array_join(F.slice(arr, F.lit(1), n - 1), ", "), F.lit(last),
                                   F.element_at(arr, -1)))
            .otherwise(F.concat(F.array_join(F.slice(arr, 1, 4), ", "), F.lit(last),
                                (n - 4).cast("string"), F.lit(more))))


def address_line(addresses) -> Column:
    """First address as ``street, zip city``; '' when there is none."""
    a = F.get(col(addresses), F.lit(0))
    place = F.trim(F.concat_ws(" ", F.coalesce(a["zip"], F.lit("")), F.coalesce(a["city"], F.lit(""))))
    street = F.coalesce(a["street"], F.lit(""))
    return F.concat_ws(", ", F.when(street != "", street), F.when(place != "", place))


def hash_fraction(c) -> Column:
    """Deterministic 0..1 from a text: first 8 hex digits of its md5."""
    return F.conv(F.substring(F.md5(col(c)), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
