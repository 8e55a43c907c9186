"""Page text as arrays: tables, cells, leaf elements, anchors and text lines.

Everything stays inside the row of the page. State that a page carries from
one element to the next (the day of a heading) is kept by cutting the page in
front of the elements that set it, so no window and no shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotatlas.functions.patterns import look
from slotatlas.functions.text import inner_text as cell_text
from slotatlas.functions.text import unescape, without_element, without_tags
from slotatlas.functions.timefn import col, day_word_regex, let

DAY = rf"{look(day_word_regex(3))}(?<!\p{{L}})(?:{day_word_regex(3)})s?(?!\p{{L}})"
CLOCK = r"\d{1,2}[:.]\d{2}"
RANGE = rf"({CLOCK})\s*[-–—]\s*({CLOCK})"


def found(c, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def closed(c, closer: str) -> Column:
    """The text up to the last closing tag (lower case, found in any case): behind it no element ends."""
    return F.regexp_extract(col(c), rf"(?is)^.*{closer}", 0)


def tables(html) -> Column:
    return found(closed(html, "</table>"), r"(?is)<table\b[^>]*>.*?</table>")


def table_rows(html) -> Column:
    return found(closed(html, "</tr>"), r"(?is)<tr\b[^>]*>(.*?)</tr>", 1)


def cells(row) -> Column:
    return F.transform(found(row, r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>", 1), cell_text)


def header_text(table) -> Column:
    return F.lower(F.array_join(F.transform(found(table, r"(?is)<th\b[^>]*>(.*?)</th>", 1), cell_text), " "))


def leaves(html, tags: str) -> Column:
    """Texts between the borders of elements with one of the tags; other tags inside them are part of the text."""
    border = rf"/?(?:{tags})\b[^>]*>"  # found rather than split by, as Spark compiles the pattern of a split for each text
    pieces = F.transform(found(html, rf"(?is)((?:[^<]++|<(?!{border}))*+)(?:<{border}|\z)", 1), cell_text)
    return F.filter(pieces, lambda t: t != "")


def cut_before(c, pattern: str) -> Column:
    """Pieces that start where the pattern matches; the first one holds what comes before."""
    if pattern.startswith("<"):  # looked for at tags only, with a pattern that is compiled once
        rest = rf"[^<]*+(?:(?!{pattern})<[^<]*+)*+"
        return found(c, rf"(?is)<{rest}|\A[^<]{rest}")
    return F.split(col(c), rf"(?ism)(?={pattern})", -1)


def block_lines(html) -> Column:
    """Visible text with one line per element."""
    text = unescape(without_tags(without_element(without_element(html, "script"), "style"), "\n"))
    text = F.regexp_replace(text, r"[^\S\n]+", " ")
    return F.trim(F.regexp_replace(text, r"\s*\n\s*", "\n"))


def anchors(html) -> Column:
    """(href, text) of every anchor."""
    hits = found(closed(html, "</a>"), r"(?is)<a\b[^>]*?href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>")
    return F.transform(hits, lambda a: F.struct(
        F.trim(unescape(F.regexp_extract(a, r"(?is)href\s*=\s*[\"']([^\"']*)", 1))).alias("href"),
        F.lower(cell_text(a)).alias("text")))
