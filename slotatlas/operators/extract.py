"""Extraction of weekly slots and prices from page text and payloads.

Every extractor is a Column: page text in, array of slot structs out. Keyed
DataFrames come from :func:`extract`, which unfolds the array and keeps the
first slot per (day, start, name) of a page. No step leaves the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotatlas import rules as R
from slotatlas.functions import price, urls
from slotatlas.functions.patterns import led
from slotatlas.functions.text import class_name_clean, rendered_text, strip_edges, strip_tags
from slotatlas.functions.timefn import (clock, col, day_name, day_normalize, end_time, iso_timestamp, let, pad_clock)
from slotatlas.operators import html as H

SLOT_TYPE = ("array<struct<day:string,time_start:string,time_end:string,class_name:string,teacher:string>>")


def class_row(name, teacher, default: str = "Class", level: str = "all", name_chars: int | None = None,
              teacher_chars: int | None = None) -> list[Column]:
    """Canonical slot columns: trimmed, never empty; cut only where a number of characters is given."""
    def clean(c, chars):
        whole = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"^\s+|\s+$", "")
        return F.substring(whole, 1, chars) if chars else whole
    return [F.coalesce(F.nullif(clean(name, name_chars), F.lit("")), F.lit(default)).alias("class_name"),
            clean(teacher, teacher_chars).alias("teacher"), F.lit(level).alias("level")]


def slot(day, start, end, name, teacher=None) -> Column:
    """Slot struct; null when there is no day, start or name."""
    made = F.struct(
        day.alias("day"), start.alias("time_start"),
        F.coalesce(end if end is not None else F.lit(""), F.lit("")).alias("time_end"),
        F.coalesce(name, F.lit("")).alias("class_name"),
        F.coalesce(teacher if teacher is not None else F.lit(""), F.lit("")).alias("teacher"))
    return let(made, lambda s: F.when(
        s["day"].isNotNull() & (F.coalesce(s["time_start"], F.lit("")) != "") & (s["class_name"] != ""), s))


def clean(slots: Column) -> Column:
    """Without nulls, first slot per (day, start, name): sorted by key and place, first of each key, back in place order."""
    def keyed(s, i):
        return F.struct(F.concat_ws("\x01", s["day"], s["time_start"], s["class_name"]).alias("key"), i.alias("place"), s.alias("slot"))

    def firsts(found):
        alone = F.filter(found, lambda x, i: (i == 0) | (x["key"] != F.get(found, i - 1)["key"]))
        placed = F.sort_array(F.transform(alone, lambda x: F.struct(x["place"].alias("place"), x["slot"].alias("slot"))))
        return F.transform(placed, lambda x: x["slot"])

    return let(F.sort_array(F.transform(F.filter(slots, lambda s: s.isNotNull()), keyed)), firsts)


def extract(pages: DataFrame, key: str, slots: Column) -> DataFrame:
    """One row per slot: (key, pos, day, time_start, time_end, class_name, teacher)."""
    rows = pages.select(key, F.posexplode(clean(slots)).alias("pos", "s"))
    return rows.select(key, "pos", "s.*")


def _first(arr: Column, cond) -> Column:
    return F.try_element_at(F.filter(arr, cond), F.lit(1))


def _range(text: Column) -> tuple[Column, Column]:
    def part(g):
        return F.replace(F.nullif(F.regexp_extract(text, H.RANGE, g), F.lit("")), F.lit("."), F.lit(":"))
    return part(1), part(2)


# --- tables -------------------------------------------------------------------

def table_slots(html, lang: str | None = None) -> Column:
    """Tables with a schedule header, or without header cells but with days and clock times: per row the first day
    cell (else the day of the last row that began with one), the first cell with clock times, and the first other cell
    as the name."""
    words = "|".join(R.TABLE_HEADER_WORDS)
    day_row = rf"<tr\b[^>]*>\s*<t[dh]\b[^>]*>(?:\s|<(?!/)[^>]+>)*+{H.DAY}"

    def scheduled(t):
        bare = ~t.rlike(r"(?i)<th\b") & t.rlike(rf"(?i){H.DAY}") & t.rlike(H.CLOCK)
        return H.header_text(t).rlike(words) | bare

    def piece(p):
        cell = H.cell_text(F.regexp_extract(p, r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>", 1))
        above = F.when(p.rlike(rf"(?is)^{day_row}"), day_normalize(cell, lang))
        return let(above, lambda day: F.transform(H.table_rows(p), lambda row: one(row, day)))

    def one(row, above):
        numbered = F.transform(H.cells(row), lambda c, i: F.struct(
            i.alias("i"), c.alias("t"), day_normalize(c, lang).alias("d"),
            F.transform(H.found(c, r"(?=\d)\b\d{1,2}[:.]\d{2}\b(?!\.)"), lambda x: F.replace(x, F.lit("."), F.lit(":"))).alias("times")))

        def pick(n):
            day = _first(n, lambda c: c["d"].isNotNull())
            return let(day, lambda d: let(
                _first(n, lambda c: (F.size(c["times"]) > 0) & ~c["i"].eqNullSafe(d["i"])), lambda t: slot(
                    F.coalesce(d["d"], above), F.get(t["times"], F.lit(0)), F.get(t["times"], F.lit(1)),
                    _first(n, lambda c: (c["t"] != "") & ~c["i"].eqNullSafe(d["i"]) & ~c["i"].eqNullSafe(t["i"])
                           & ~c["t"].rlike(r"^\d{1,2}[:.]\d{2}\b"))["t"])))
        return let(numbered, pick)

    pieces = F.flatten(F.transform(F.filter(H.tables(html), scheduled), lambda t: H.cut_before(t, day_row)))
    return F.flatten(F.transform(pieces, piece))


def day_header_table_slots(html) -> Column:
    """One-cell colspan rows set the day; the rows below bring range, name, teacher."""
    header = rf"<tr\b[^>]*>\s*<td\b[^>]*colspan[^>]*>[^<]*{H.DAY}"
    pieces = F.filter(H.cut_before(html, header), lambda p: p.rlike(rf"(?is)^{header}"))

    def piece(p):
        day = day_normalize(F.regexp_extract(p, r"(?is)^<tr\b[^>]*>\s*<td\b[^>]*>([^<]*)", 1))

        def row(d, c):
            start, end = _range(F.get(c, F.lit(0)))
            teacher = F.trim(F.regexp_replace(F.get(c, F.lit(2)), r"^\d+\)\s*", ""))
            return F.when(F.size(c) >= 3, slot(d, start, end, class_name_clean(F.get(c, F.lit(1))), teacher))
        return let(day, lambda d: F.transform(F.transform(H.table_rows(p), H.cells), lambda c: row(d, c)))

    return F.flatten(F.transform(pieces, piece))


# --- headings, blocks, running text ----------------------------------------------

def _named(text: Column, day: Column, single_ok: bool) -> Column:
    """Slot of one text block: a range, or (``single_ok``) a single clock and a name."""
    def ranged():
        start, end = _range(text)
        return let(class_name_clean(text), lambda name: slot(day, start, end, name, F.trim(F.regexp_extract(
            name, r"(?i)\b(?:with|mit|avec|con)\s+([\p{L}\d_\s]+?)(?:\s*[,|]|$)", 1))))

    def single():
        one = F.replace(F.regexp_extract(text, H.CLOCK, 0), F.lit("."), F.lit(":"))
        return F.when((F.length(text) > 5) & text.rlike(H.CLOCK), let(
            class_name_clean(F.regexp_replace(text, H.CLOCK, "")),
            lambda rest: F.when(F.length(rest) > 2, slot(day, one, None, rest))))

    return F.when(text.rlike(H.RANGE), ranged()).otherwise(single()) if single_ok else F.when(text.rlike(H.RANGE), ranged())


#: Tags that end a heading when they open inside it.
BLOCKS = "h[1-6]|p|div|li|ul|ol|dl|dt|dd|table|tr|td|th|section"


def heading_slots(html, single_ok: bool = True, max_blocks: int | None = None) -> Column:
    """A day heading, then all blocks (or the first ``max_blocks``) until the next heading.

    The day may stand inside further tags, with a date or any other text and tags behind it, but not with a range of
    clock times.
    """
    inner = r"(?:\s|<(?!/)[^>]+>)*+"
    inline = rf"[^<]*+(?:<(?!/|(?:{BLOCKS})\b)[^>]*+>[^<]*+)*+"
    heading = rf"<(?:h[1-6]|strong|b|dt|th)\b[^>]*>{inner}{H.DAY}(?![^<]*{H.CLOCK}\s*[-–—]){inline}</"
    pieces = F.filter(H.cut_before(html, heading), lambda p: p.rlike(rf"(?is)^{heading}"))

    def piece(p):
        day = day_normalize(F.regexp_extract(p, rf"(?is)^<[^>]*>{inner}([^<]*)", 1))
        # what the heading holds ends at its own closing tag; without one, at the first closing tags
        # if it stands inside a larger heading, that one's text goes too
        outer = r"(?:(?:[^<]++|</(?!h[1-6]|dt|th)[^>]*+>)*+</(?:h[1-6]|dt|th)\s*>)?+"
        head = rf"(?is)^<([a-z0-9]+)[^>]*>(?:.*?</\1\s*>|{inner}{inline}(?:</[^>]*>)++){outer}"
        body = F.regexp_replace(F.regexp_replace(p, head, ""), r"(?is)<h[1-6]\b.*$", "")
        blocks = H.leaves(body, "p|li|div|span|dd|td")
        blocks = F.slice(blocks, 1, max_blocks) if max_blocks else blocks
        return let(day, lambda d: F.transform(blocks, lambda t: _named(t, d, single_ok)))

    return F.flatten(F.transform(pieces, piece))


_INLINE = (rf"(?i){H.DAY}\p{{L}}*[:\s]+{H.CLOCK}\s*[-–—]\s*{H.CLOCK}\s*(?:Uhr|h)?\s*[-–—:,]?\s*"
           rf".+?(?={H.DAY}\p{{L}}*\s+\d|\n|$)")


def inline_slots(html) -> Column:
    """``day time–time text`` in running text, ended by the next day or line."""
    hits = H.found(H.block_lines(html), _INLINE)

    def hit(t):
        start, end = _range(t)
        name = strip_edges(F.regexp_replace(t, rf"(?i)^.*?{H.CLOCK}\s*[-–—]\s*{H.CLOCK}\s*(?:Uhr|h\b)?\s*", ""))
        return let(name, lambda n: F.when(F.length(n) > 1, slot(day_normalize(t), start, end, n)))
    return F.transform(hits, hit)


def block_slots(html, default: str = "Class", longest: int | None = None) -> Column:
    """Blocks of 10 characters and more (up to ``longest``) with a day and a range."""
    def block(t):
        start, end = _range(t)
        rest = F.regexp_extract(t, rf"(?i){H.DAY}\s*:?\s*{H.CLOCK}\s*[-–—]\s*{H.CLOCK}\s*(?:Uhr|h\b)?\s*(.*)", 1)
        near = t.rlike(rf"(?i){H.DAY}\s*:?\s*{H.CLOCK}")
        name = F.coalesce(F.nullif(strip_edges(rest), F.lit("")), F.lit(default))
        return F.when((F.length(t) >= 10) & (F.length(t) <= F.lit(longest) if longest else F.lit(True)) & near, slot(day_normalize(t), start, end, name))
    return F.transform(H.leaves(html, "div|li|p|span|dd"), block)


def _day_line(around: int | None) -> str:
    """A line that names a day and no clock time, with up to ``around`` characters on each side of the day."""
    side = rf"[^\n]{{0,{around}}}" if around is not None else r"[^\n]*"
    return rf"^(?![^\n]*\d[:.h]\d{{2}}){side}{H.DAY}{side}$"


def line_slots(text, longest: int | None = None, name_longest: int | None = None, teacher_longest: int | None = None,
               around_day: int | None = None) -> Column:
    """Line by line: a day line sets the day, a line with a range emits a slot.

    The name is the text before or after the range, else the previous or next
    line; the teacher is what follows. A single clock counts only next to a
    topic word. Noise lines never become names. Lines, names from other lines,
    teachers and what stands around a day may be limited in length; they are not by default.
    """
    day_line = _day_line(around_day)
    pieces = F.filter(H.cut_before(text, day_line), lambda p: p.rlike(rf"(?im)\A{day_line}"))
    span = r"\d{1,2}[.:h]\d{2}\s*[-–—]\s*\d{1,2}[.:h]\d{2}"

    def usable(t, most):
        return (F.length(t) > 2) & (F.length(t) < F.lit(most) if most else F.lit(True)) & ~t.rlike(f"(?i){R.LINE_NOISE}") & ~t.rlike(span)

    def piece(p):
        kept = F.filter(F.transform(F.split(p, "\n"), lambda x: F.trim(x)),
                        lambda x: (x != "") & (F.length(x) <= F.lit(longest) if longest else F.lit(True)) & ~x.rlike(f"(?i){R.LINE_NOISE}"))
        return let(kept, lambda lines: let(day_normalize(F.get(lines, F.lit(0))), lambda d: emit(lines, d)))

    def emit(all_lines, day):
        def line(x, i):
            def ranged():
                start = pad_clock(F.regexp_extract(x, r"(\d{1,2}[.:h]\d{2})\s*[-–—]\s*\d{1,2}[.:h]\d{2}", 1))
                end = pad_clock(F.regexp_extract(x, r"\d{1,2}[.:h]\d{2}\s*[-–—]\s*(\d{1,2}[.:h]\d{2})", 1))
                around = F.struct(
                    strip_edges(F.regexp_extract(x, rf"^(.*?){span}", 1), r"\s\-–—|:").alias("before"),
                    strip_edges(F.regexp_extract(x, rf"{span}(.*)$", 1), r"\s\-–—|:").alias("after"),
                    F.when(i > 1, F.get(all_lines, i - 1)).alias("prev"), F.get(all_lines, i + 1).alias("next"))

                def named(a):
                    has_before, has_after = F.length(a["before"]) > 2, F.length(a["after"]) > 2
                    name = F.coalesce(F.when(has_before, a["before"]).when(has_after, a["after"]),
                                      F.when(usable(a["prev"], name_longest), a["prev"]), F.when(usable(a["next"], name_longest), a["next"]))
                    return let(name, lambda n: slot(day, start, end, n, F.coalesce(
                        F.when(has_before & has_after, a["after"]),
                        F.when(usable(a["next"], teacher_longest) & (a["next"] != n) & day_normalize(a["next"]).isNull(), a["next"]))))
                return let(around, named)

            def lone():
                single = F.regexp_extract(x, r"\d{1,2}[.:h]\d{2}", 0)
                rest = strip_edges(F.regexp_replace(x, r"\d{1,2}[.:h]\d{2}", ""), r"\s\-–—|:")
                return F.when(x.rlike(r"\d{1,2}[.:h]\d{2}") & x.rlike(f"(?i){R.LINE_TOPICS}"), let(
                    rest, lambda r: F.when(F.length(r) > 2, slot(day, pad_clock(single), None, r))))
            return F.when(x.rlike(span), ranged()).otherwise(lone())
        return F.transform(all_lines, line)

    return F.flatten(F.transform(pieces, piece))


def day_block_slots(html) -> Column:
    """Any element that names a day sets it; the divs with a range below emit."""
    plain = "[^<0123456789]*"  # digits one by one: Java looks single characters up in a table
    marker = rf"<[a-z][a-z0-9]*\b[^>]*>{plain}{H.DAY}{plain}</"
    pieces = F.filter(H.cut_before(html, marker), lambda p: p.rlike(rf"(?is)^{marker}"))

    def piece(p):
        day = day_normalize(F.regexp_extract(p, r"(?is)^<[^>]*>([^<]*)", 1))
        return let(day, lambda d: F.transform(H.leaves(p, "div"), lambda t: _named(t, d, False)))
    return F.flatten(F.transform(pieces, piece))


def calendar_slots(html, teacher_mode: str = "second") -> Column:
    """Calendar list items: day word, else date, else the day header above; start
    and ``N Min``; name; teacher = second ellipsis, or the first plausible one."""
    sections = H.cut_before(html, r"<h3\b[^>]*calendar__day-header")

    def section(s):
        above = day_name(F.try_to_timestamp(F.nullif(F.regexp_extract(s, r"(?is)^<h3\b[^>]*data-day=[\"']([0-9-]+)", 1), F.lit("")), F.lit("yyyy-MM-dd")))
        items = F.filter(H.cut_before(s, r"<li\b[^>]*calendar__slot"), lambda x: x.rlike(r"(?is)^<li\b[^>]*calendar__slot"))

        def label(x):
            return H.cell_text(F.regexp_extract(x, r"(?s)class=.sr-only[^>]*>(.*?)</", 1))

        def item(x, label, above):
            # an empty date is none: Spark would raise and catch an error for it
            date = F.nullif(F.regexp_extract(label, r"(\d{2}/\d{2}/\d{4})", 1), F.lit(""))
            day = F.coalesce(day_normalize(label), day_name(F.try_to_timestamp(date, F.lit("dd/MM/yyyy"))), above)
            time = H.cell_text(F.regexp_extract(x, r"(?s)session-time[^>]*>(.*?)</", 1))
            name = H.cell_text(F.regexp_extract(x, r"(?s)session-name[^>]*>(.*?)</", 1))
            marks = F.transform(H.found(x, r"(?s)class=.ellipsis[^>]*>(.*?)</", 1), H.cell_text)

            def made(v):
                start = F.regexp_extract(v["time"], r"(\d{1,2}:\d{2})", 1)
                length = F.regexp_extract(v["time"], r"(\d+)\s*[Mm]in", 1).try_cast("int")
                if teacher_mode == "second":
                    teacher = F.coalesce(F.get(v["marks"], F.lit(1)), F.get(v["marks"], F.lit(0)))
                else:
                    teacher = _first(v["marks"], lambda t: (t != "") & ~F.lower(t).rlike("spot|level") & (t != v["name"]) & (t != F.upper(t)))
                return slot(v["day"], start, end_time(start, length), v["name"], teacher)
            return let(F.struct(day.alias("day"), time.alias("time"), name.alias("name"), marks.alias("marks")), made)
        return let(above, lambda day: F.transform(items, lambda x: let(label(x), lambda text: item(x, text, day))))

    return F.flatten(F.transform(sections, section))


def text_before_slots(text, chars: int = 100) -> Column:
    """``Day @ HH:MM`` hits: the name is the last sentence chunk before the hit."""
    days = "|".join(R.DAYS).lower()
    rx = "(?i)" + led(rf"(?:{days})s?\s*[@at]*\s*\d{{1,2}}:\d{{2}}")

    def hit(h, before):
        # the last sentence chunk of the text between two hits; the window reaches back over earlier hits too
        name = F.trim(F.element_at(F.split(F.trim(F.right(before, F.lit(chars))), r"[.!?]", -1), -1))
        return slot(day_normalize(h), F.regexp_extract(h, r"(\d{1,2}:\d{2})", 1), None, name)

    def scan(hits, pieces):
        def window(i):
            # pieces and hits before hit i, from as few of them as can fill the window
            back = F.greatest(i - chars, F.lit(0))
            parts = F.transform(F.slice(pieces, back + 1, i - back + 1), lambda p, k: F.concat(
                F.when(k > 0, F.get(hits, back + k - 1)).otherwise(F.lit("")), F.right(p, F.lit(chars))))
            return F.array_join(parts, "")
        return F.transform(hits, lambda h, i: hit(h, window(i)))

    return let(H.found(text, rx), lambda hits: let(F.split(col(text), rx, -1), lambda pieces: scan(hits, pieces)))


# --- payloads ----------------------------------------------------------------------

_LOCAL = "struct<year:int,monthOfYear:int,dayOfMonth:int,hourOfDay:int,minutesOfHour:int>"
SESSIONS_SCHEMA = (
    f"sessions array<struct<title:string,start:struct<localDateTime:{_LOCAL},timestamp:string>,"
    f"end:struct<localDateTime:{_LOCAL},timestamp:string>,affectedSchedules:array<struct<scheduleOwnerName:string>>,"
    "staffMembers:array<struct<name:string,fullName:string>>>>")


def sessions_json(payload, default: str = "Class") -> Column:
    """Sessions with local date-times, else ISO stamps; teacher from schedule owner or staff."""
    def moment(m):
        local = m["localDateTime"]
        return F.coalesce(F.when(local.isNotNull(), F.try_make_timestamp_ntz(
            local["year"], local["monthOfYear"], local["dayOfMonth"], local["hourOfDay"], local["minutesOfHour"], F.lit(0)).cast("timestamp")),
            iso_timestamp(m["timestamp"]))

    def one(s):
        start, end = moment(s["start"]), moment(s["end"])
        owner = _first(F.transform(s["affectedSchedules"], lambda a: a["scheduleOwnerName"]), lambda n: F.coalesce(n, F.lit("")) != "")
        staff = F.get(s["staffMembers"], F.lit(0))
        return slot(day_name(start), F.date_format(start, "HH:mm"), F.date_format(end, "HH:mm"),
                    F.coalesce(F.nullif(s["title"], F.lit("")), F.lit(default)),
                    F.coalesce(owner, F.nullif(staff["name"], F.lit("")), staff["fullName"]))
    return F.transform(F.from_json(col(payload), SESSIONS_SCHEMA)["sessions"], one)


EVENT_LISTS = ["data", "results", "Classes", "classes"]
EVENT_FIELDS = {
    "start": ["StartDateTime", "startDateTime", "date_start", "start", "startTime", "StartTime"],
    "end": ["end", "endTime", "EndTime"],
    "name": ["name", "title", "className", "ClassName"],
    "teacher": ["teacher", "staffName", "StaffName"],
}


def events_json(payload, default_minutes: int = 60) -> Column:
    """Event lists (``data``, ``results``, ``classes`` or a root array) with aliases of
    every field; the end is given or start + duration (60 without one). Aliases
    differ in case only, so the items are read as maps."""
    text = col(payload)
    wrapped = let(F.from_json(text, "map<string,string>"),
                  lambda m: F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in EVENT_LISTS]))
    items = F.from_json(F.when(text.rlike(r"^\s*\["), text).otherwise(wrapped), "array<map<string,string>>")

    def field(e, name):
        return F.coalesce(*[F.try_element_at(e, F.lit(k)) for k in EVENT_FIELDS[name]])

    def one(e):
        start = iso_timestamp(field(e, "start"))
        begin, stop = F.date_format(start, "HH:mm"), field(e, "end")
        length = F.coalesce(F.try_element_at(e, F.lit("duration")).try_cast("int"), F.lit(default_minutes))
        end = F.coalesce(F.date_format(iso_timestamp(stop), "HH:mm"),
                         F.nullif(F.regexp_extract(stop, r"(\d{1,2}:\d{2})", 1), F.lit("")), end_time(begin, length))
        return slot(day_name(start), begin, end, field(e, "name"), field(e, "teacher"))
    return F.transform(items, one)


GRAPHQL_SCHEMA = ("data struct<widget:struct<activities:struct<nodes:array<struct<id:string,name:string,start:string,end:string,"
                  "isCancelled:boolean,limited:struct<freeSpots:int,totalSpots:int>,room:struct<name:string>,teacher:struct<name:string>>>>>>")


def graphql_nodes(payload) -> Column:
    """Activity nodes that are not cancelled."""
    nodes = F.from_json(col(payload), GRAPHQL_SCHEMA)["data"]["widget"]["activities"]["nodes"]

    def one(n):
        start, end = iso_timestamp(n["start"]), iso_timestamp(n["end"])
        return F.when(~F.coalesce(n["isCancelled"], F.lit(False)), slot(
            day_name(start), F.date_format(start, "HH:mm"), F.date_format(end, "HH:mm"), n["name"], n["teacher"]["name"]))
    return F.transform(nodes, one)


def appointments(html, lang: str | None = None) -> Column:
    """Names zipped with descriptions from embedded JSON; a topic word is required.
    Day and start come from the description; without a day it is TBC."""
    body = F.regexp_extract(col(html), r'(?s)"appointmentTypes"\s*:\s*(\{.+?\})\s*,\s*"[a-z]', 1)
    words = "|".join(R.APPOINTMENT_WORDS)

    def one(n, i, descs):
        desc = F.coalesce(F.get(descs, i), F.lit(""))
        day = day_normalize(desc, lang)
        start = F.regexp_replace(F.regexp_extract(desc, H.CLOCK, 0), r"\.", ":")
        ok = F.lower(n).rlike(words) & (day.isNotNull() | (start != ""))
        return F.when(ok, F.struct(F.coalesce(day, F.lit("TBC")).alias("day"), start.alias("time_start"), F.lit("").alias("time_end"),
                                   F.trim(n).alias("class_name"), F.lit("").alias("teacher")))

    return let(body, lambda b: let(H.found(b, r'"description":"([^"]*)"', 1), lambda descs: F.transform(
        H.found(b, r'"name":"([^"]+)"', 1), lambda n, i: one(n, i, descs))))


def cms_items(payload, default: str = "Class") -> Column:
    """Items of a CMS page: every ``day time`` in title, body or excerpt."""
    item = "array<struct<title:string,body:string,excerpt:string>>"
    parsed = F.from_json(col(payload), f"items {item},collection struct<items:{item}>")
    items = let(parsed, lambda p: F.when(F.size(p["items"]) > 0, p["items"]).otherwise(p["collection"]["items"]))

    def one(x):
        text = F.concat_ws(" ", x["title"], x["body"], x["excerpt"])
        hits = H.found(text, rf"(?i){H.DAY}\p{{L}}*\s+{H.CLOCK}")
        name = F.coalesce(F.nullif(x["title"], F.lit("")), F.lit(default))
        return F.transform(hits, lambda h: slot(day_normalize(h), F.regexp_replace(F.regexp_extract(h, H.CLOCK, 0), r"\.", ":"), None, name))
    return F.flatten(F.transform(items, one))


RECURRENCE_SCHEMA = ("events array<struct<type:string,status:string,title:string,scheduleId:string,start:struct<localDate:string>,"
                     "end:struct<localDate:string>,recurrenceRule:struct<days:array<string>>>>,"
                     "services array<struct<hidden:boolean,schedule:struct<id:string>,payment:struct<fixed:struct<price:struct<value:string,currency:string>>>>>")


def recurrence_slots(payload) -> Column:
    """Confirmed class events, one slot per weekday of the rule (else the weekday of the
    start), with the price of the service that has the same schedule."""
    def one(e, services):
        start, end = iso_timestamp(e["start"]["localDate"]), iso_timestamp(e["end"]["localDate"])
        rule = e["recurrenceRule"]["days"]
        days = F.when(F.size(rule) > 0, F.transform(rule, lambda d: F.initcap(F.lower(d)))).otherwise(F.array(day_name(start)))
        svc = _first(services, lambda s: ~F.coalesce(s["hidden"], F.lit(False)) & (s["schedule"]["id"] == e["scheduleId"]))
        ok = (e["type"] == "CLASS") & (e["status"] == "CONFIRMED") & start.isNotNull()
        return F.transform(F.when(ok, days).otherwise(F.array().cast("array<string>")), lambda d: F.struct(
            d.alias("day"), F.date_format(start, "HH:mm").alias("time_start"), F.coalesce(F.date_format(end, "HH:mm"), F.lit("")).alias("time_end"),
            e["title"].alias("class_name"), F.lit("").alias("teacher"), svc["payment"]["fixed"]["price"]["value"].try_cast("double").alias("price")))

    return let(F.from_json(col(payload), RECURRENCE_SCHEMA),
               lambda p: F.flatten(F.transform(p["events"], lambda e: one(e, p["services"]))))


def flat_items(payload) -> Column:
    """Items that already carry day, start and end."""
    items = F.from_json(col(payload), "array<struct<day:string,start_time:string,time:string,end_time:string,name:string,teacher:string>>")
    return F.transform(items, lambda x: slot(x["day"], F.coalesce(x["start_time"], x["time"]), x["end_time"], x["name"], x["teacher"]))


def cascade(strategies: list[Column]) -> Column:
    """(strategy, slots): slots of the first strategy that yields any, and its 1-based number.

    ``coalesce`` stops at the first hit, so later strategies are not run.
    """
    def attempt(number, slots):
        return let(clean(slots), lambda c: F.when(F.size(c) > 0, F.struct(
            F.lit(number).alias("strategy"), c.cast(SLOT_TYPE).alias("slots"))))

    return F.coalesce(*[attempt(i, s) for i, s in enumerate(strategies, 1)])


# --- prices --------------------------------------------------------------------------

def category_prices(html) -> Column:
    """Amounts of each text block under the first category whose keyword it holds; a
    later hit overwrites; ``abo`` only while there is no monthly or card price."""
    blocks = F.transform(H.found(html, 
        r"(?is)<(?:div|li|tr|section)\b[^>]*>[^<]*+(?:<(?!/?(?:div|li|tr|section)\b)[^<]*+)*+</(?:div|li|tr|section)>"), H.cell_text)

    def block(t):
        low = F.lower(t)
        cat = F.coalesce(*[F.when(low.rlike("|".join(k.replace("(", r"\(") for k in kws)), F.lit(c)) for c, kws in R.CATEGORY_KEYWORDS.items()])
        values = F.transform(H.found(t, f"(?i){R.CATEGORY_AMOUNT}", 1), lambda a: F.replace(a, F.lit(","), F.lit(".")).try_cast("double"))
        kept = F.filter(values, lambda v: v.between(*R.CATEGORY_BOUNDS))
        return F.transform(kept, lambda v: F.struct(cat.alias("cat"), v.alias("v")))

    hits = F.filter(F.flatten(F.transform(blocks, block)), lambda h: h["cat"].isNotNull())
    fields = list(R.CATEGORY_KEYWORDS)
    zero = F.struct(*[F.lit(None).cast("double").alias(f) for f in fields])

    def step(acc, h):
        free = acc["monthly"].isNull() & acc["card_10"].isNull()
        return F.struct(*[F.when((h["cat"] == f) & (free if f == "abo" else F.lit(True)), h["v"]).otherwise(acc[f]).alias(f) for f in fields])
    return F.aggregate(hits, zero, step)


def text_prices(text, url) -> Column:
    """Prices of one text: keyword windows, free trial, fallback by range. Null without any.

    Every stage runs once, and only on texts that hold an amount at all.
    """
    t = col(text)
    page = F.concat_ws(" ", F.lower(col(url)), F.lower(t)).rlike(led(R.PRICE_PAGE))

    def combine(near, fall):
        out = {f: F.coalesce(near[f], fall[f]) for f in ("single", "card_10", "monthly")}
        out["trial"] = F.coalesce(near["trial"], F.when(price.free_trial(t), F.lit(0.0)))
        return let(F.struct(*[c.alias(k) for k, c in out.items()]),
                   lambda r: F.when(F.coalesce(*[r[f] for f in R.PRICE_FIELDS]).isNotNull(), r))

    def stages(found):
        near = F.struct(*[price.near_keyword(t, p).alias(f) for f, p in R.PRICE_KEYWORDS.items()])

        def fallback(n):
            none = n["single"].isNull() & n["card_10"].isNull() & n["monthly"].isNull()
            return let(F.when(none, price.amount_fallback(found, page)), lambda f: combine(n, f))
        return F.when((F.length(t) >= 20) & (F.size(found) > 0), let(near, fallback))

    return let(price.amounts(t), stages)


def page_prices(pages: DataFrame, html: str, url: str) -> DataFrame:
    """Best of two text renderings: the first if it has ``single``, else the fuller one."""
    def filled(p):
        return sum((F.when(p[f].isNotNull(), 1).otherwise(0) for f in R.PRICE_FIELDS), F.lit(0))

    def choose(a, b):
        return F.when(b.isNotNull() & (a.isNull() | (filled(b) > filled(a))), b).otherwise(a)

    def best(ta, tb):
        # The second rendering is priced only where it differs and the first has no single price.
        return let(text_prices(ta, url), lambda a: F.when(a["single"].isNotNull() | (ta == tb), a).otherwise(
            let(text_prices(tb, url), lambda b: choose(a, b))))

    def both(tb):
        # without a closing noscript the two renderings are one
        return let(F.when(col(html).rlike("(?i)</noscript>"), rendered_text(html)).otherwise(tb), lambda ta: best(ta, tb))

    priced = let(strip_tags(html), both)
    # Unfolding a list of at most one result drops the empty ones without a second evaluation.
    return pages.withColumn("p", F.explode(F.filter(F.array(priced), lambda p: p.isNotNull())))


def service_prices(payload) -> Column:
    """Lowest price of 10..55 among the services in francs; null unless any is in 10..500.
    The price may be a number or ``{value, currency}``."""
    money = "struct<price:string,currency:string>"
    services = F.from_json(col(payload), f"services array<struct<payment:struct<fixed:{money},varied:{money}>>>")["services"]

    def value(s):
        m = F.coalesce(s["payment"]["fixed"], s["payment"]["varied"])
        raw = m["price"]
        number = F.coalesce(raw.try_cast("double"), F.get_json_object(raw, "$.value").try_cast("double"))
        currency = F.upper(F.coalesce(F.get_json_object(raw, "$.currency"), m["currency"], F.lit("CHF")))
        return F.when((currency == "CHF") & number.between(10, 500), number)
    values = F.filter(F.transform(services, value), lambda v: v.isNotNull())
    return F.array_min(F.filter(values, lambda v: v <= 55))


# --- links ------------------------------------------------------------------------------

def page_links(pages: DataFrame, key: str, url: str, html: str, words: list[str] | None) -> DataFrame:
    """Same-host http links of a page, absolute and distinct; with ``words``, only
    links that have one of them in the href or the text. No files, mail or phone."""
    links = F.filter(H.anchors(html), lambda a: (a["href"] != "") & ~a["href"].rlike(r"(?i)^(?:#|mailto:|tel:)"))
    if words:
        rx = "|".join(words)
        links = F.filter(links, lambda a: a["text"].rlike(rx) | F.lower(a["href"]).rlike(rx))
    targets = F.array_distinct(F.transform(links, lambda a: urls.url_join(url, a["href"])))
    rows = pages.select(key, url, F.explode(targets).alias("link"))
    authority = r"(?i)^https?://([^/?#]+)"
    same = F.lower(F.regexp_extract("link", authority, 1)) == F.lower(F.regexp_extract(url, authority, 1))
    path = F.lower(F.regexp_replace(F.regexp_replace("link", r"[?#].*$", ""), authority, ""))
    files = "(?:" + "|".join(s.replace(".", r"\.") for s in R.FILE_SUFFIXES) + ")$"
    return rows.filter(F.col("link").rlike("(?i)^https?://") & same & ~path.rlike(files)).select(key, "link")


def booking_links(pages: DataFrame, key: str, html: str, platforms: list[str]) -> DataFrame:
    """Anchors to known platforms as rows, with the schedule-table flag of the page."""
    words = "|".join(R.LINK_TABLE_WORDS)
    flag = F.exists(H.tables(html), lambda t: H.header_text(t).rlike(words))
    hrefs = F.transform(H.anchors(html), lambda a: a["href"])
    hits = F.array(*[F.struct(F.lit(p).alias("platform"), F.filter(hrefs, lambda h: h.rlike(f"(?i){p}")).alias("urls")) for p in platforms])
    return pages.select(key, flag.alias("has_schedule_table"), F.inline(hits)) \
        .select(key, "has_schedule_table", "platform", F.explode("urls").alias("url"))


def link_frontier(sites: DataFrame, links: DataFrame, visited: DataFrame, site: str, subpaths: list[str],
                  discovered_cap: int | None = None, cap: int | None = None) -> DataFrame:
    """Next pages per site with their rank: discovered links first, then the known subpaths, minus visited ones.

    Every candidate is given unless a cap is; callers filter on ``rank``. ``visited``: (site, url_key)."""
    from slotatlas.operators.ranking import top_n
    found = links.withColumn("url_key", urls.url_norm("link")).groupBy(site, "url_key").agg(F.min("link").alias("link"))
    found = top_n(found, [site], [F.col("link")], discovered_cap, "_r").select(
        site, "link", "url_key", F.lit(0).alias("src"), F.col("_r").alias("ord"))
    known = sites.select(site, F.posexplode(F.array(*[F.lit(p) for p in subpaths])).alias("ord", "path"), "origin") \
        .withColumn("link", F.concat("origin", "path")).select(
            site, "link", urls.url_norm("link").alias("url_key"), F.lit(1).alias("src"), F.col("ord"))
    both = found.unionByName(known).join(visited, [site, "url_key"], "left_anti")
    first = both.groupBy(site, "url_key").agg(F.min(F.struct("src", "ord", "link")).alias("b")).select(site, "url_key", "b.*")
    return top_n(first, [site], [F.col("src"), F.col("ord"), F.col("link")], cap).select(site, "link", "rank")
