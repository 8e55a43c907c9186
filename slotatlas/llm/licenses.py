"""License scans: ordered signature rules over the words of a text.

A text is reduced to its words (ASCII letters in lower case, digits, everything beyond ASCII). Rules are regular
expressions over the words, gated by a keyword: only rules whose keyword occurs in the words, alone or inside one, are tried. Each match is an
interval of words with the rule's priority. An interval inside another one of a higher priority, or of the same
priority and at least its length, is suppressed; what is left names the licenses.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from slotatlas.llm.bpe import map_text

#: Bytes of words in lower-cased UTF-8: digits, letters and whatever is beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]] = True

#: Phrases and labels of the base rule.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# License families as (label, keyword, names as patterns over words, versions). A version is spelled in
# words, so 2.0 reads "2 0"; "" stands for a mention without a version.
VERSIONED = [
    ("gpl", "gpl", ["gnu gpl", "gpl"], ["1", "2", "3", "1 0", "2 0", "3 0"]),
    ("gpl", "general", ["gnu general public license", "general public license"], ["1", "2", "3", "1 0", "2 0", "3 0"]),
    ("lgpl", "lgpl", ["gnu lgpl", "lgpl"], ["2", "2 0", "2 1", "3", "3 0"]),
    ("lgpl", "lesser", ["gnu lesser general public license", "lesser general public license"], ["2 1", "3", "3 0"]),
    ("lgpl", "library", ["gnu library general public license", "library general public license"], ["2", "2 0"]),
    ("agpl", "agpl", ["gnu agpl", "agpl"], ["1", "1 0", "3", "3 0"]),
    ("agpl", "affero", ["gnu affero general public license", "affero general public license"], ["1", "3", "3 0"]),
    ("gfdl", "documentation", ["gnu free documentation license", "free documentation license"], ["1 1", "1 2", "1 3"]),
    ("apache", "apache", ["apache license", "apache software license", "apache"], ["1 0", "1 1", "2", "2 0"]),
    ("mpl", "mozilla", ["mozilla public license"], ["1 0", "1 1", "2", "2 0"]),
    ("mpl", "mpl", ["mpl"], ["1 0", "1 1", "2", "2 0"]),
    ("epl", "eclipse", ["eclipse public license"], ["1 0", "2 0"]),
    ("epl", "epl", ["epl"], ["1 0", "2 0"]),
    ("cddl", "cddl", ["cddl"], ["1 0", "1 1"]),
    ("cddl", "distribution", ["common development and distribution license"], ["1 0", "1 1"]),
    ("eupl", "eupl", ["eupl"], ["1 0", "1 1", "1 2"]),
    ("eupl", "european", ["european union public licen[cs]e"], ["1 0", "1 1", "1 2"]),
    ("artistic", "artistic", ["artistic license", "the artistic license"], ["1 0", "2 0"]),
    ("ofl", "ofl", ["sil ofl", "ofl"], ["1 0", "1 1"]),
    ("ofl", "font", ["sil open font license", "open font license"], ["1 0", "1 1"]),
    ("bsl", "boost", ["boost software license"], ["1 0"]),
    ("osl", "osl", ["osl"], ["1 0", "2 0", "2 1", "3 0"]),
    ("cecill", "cecill", ["cecill", "cecill b", "cecill c"], ["1 0", "2 0", "2 1"]),
    ("zpl", "zope", ["zope public license"], ["2 0", "2 1"]),
    ("lppl", "latex", ["latex project public license"], ["1 2", "1 3"]),
    ("odbl", "database", ["open database license"], ["1 0"]),
]
#: Between a name and its version, which may be glued to it: "gpl version 3", "gpl v 3", "gpl v3", "gpl 3", "gplv3".
TO_VERSION = "(?: (?:version |v )?v?|v)"
#: Families whose identifiers end in "only" or "or later".
GNU = ("agpl", "gfdl", "gpl", "lgpl")
#: Identifiers of the license list as words ("GPL-2.0-or-later" reads "gpl 2 0 or later"); a label joins them by dashes.
IDENTIFIER = (r"(?:(?:agpl|gfdl|lgpl|gpl) \d+(?: \d+)?(?: only| or later)?"
              r"|(?:afl|apache|apsl|artistic|bsl|cddl|cecill|cpl|ecl|epl|eupl|lppl|mpl|ms pl|ncsa|odbl|ofl|osl|psf|python|zpl) \d+(?: \d+)*"
              r"|bsd [1-4] clause(?: clear| patent)?|cc by(?: nc)?(?: sa| nd)? \d+ \d+|cc0 1 0|mit 0|mit|isc|zlib|unlicense|wtfpl|0bsd"
              r"|postgresql|ncsa|ms pl|x11|curl|openssl|blueoak 1 0 0"
              r"|(?:autoconf|bison|classpath|font|gcc) exception \d+ \d+|llvm exception|linux syscall note)")
EXPRESSION = re.compile(rf"(?<![^ ])spdx license identifier ({IDENTIFIER}(?: (?:and|or|with) {IDENTIFIER})*)(?![^ ])".encode())
ONE_IDENTIFIER = re.compile(rf"(?<![^ ]){IDENTIFIER}(?![^ ])".encode())
PARTS = {"by": "attribution", "nc": "noncommercial", "nd": "no ?derivatives|noderivs", "sa": "share ?alike"}
CREATIVE = ["by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"]
CREATIVE_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
# Single phrases as (label, keyword, pattern over words).
PHRASES = [
    ("mit", "mit", r"(?:the )?mit license"), ("mit", "mit", r"licensed under (?:the )?mit"), ("mit", "mit", r"licen[cs]e mit"),
    ("isc", "isc", r"licen[cs]e isc"),
    ("mit", "granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", "bsd", r"(?:[0234] clause |simplified |modified |new )?bsd license"), ("bsd", "bsd", r"bsd [0234] clause"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification"),
    ("isc", "isc", r"(?:the )?isc license"), ("isc", "granted", r"permission to use copy modify and or distribute this software"),
    ("zlib", "zlib", r"zlib license"), ("unlicense", "unlicense", r"the unlicense"),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain"),
    ("wtfpl", "wtfpl", r"wtfpl"), ("psf", "python", r"python software foundation license"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"), ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "creative", r"creative commons zero"), ("public-domain", "domain", r"(?:in|into|to) the public domain"),
    ("public-domain", "domain", r"public domain"), ("proprietary", "proprietary", r"proprietary and confidential"),
    ("proprietary", "reproduction", r"no part of this \S+ may be reproduced"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution)"),
    ("copyright", "copyright", r"copyright (?:c |© ?)?(?:19|20)\d\d(?: (?:19|20)\d\d)*"),
    ("copyright", "©", r"© ?(?:19|20)\d\d(?: (?:19|20)\d\d)*"),
    ("gpl", "gpl", r"gpl"), ("gpl", "gnu", r"gnu gpl"), ("lgpl", "lgpl", r"lgpl"), ("agpl", "agpl", r"agpl"),
    ("apache", "apache", r"apache licen[cs]e"), ("mpl", "mozilla", r"mozilla public licen[cs]e"),
]


class Rule(NamedTuple):
    """A pattern over words joined by single blanks. Larger priorities suppress smaller ones inside them."""

    label: str
    priority: int
    keyword: bytes
    pattern: re.Pattern


def _whole_words(pattern: str) -> re.Pattern:
    return re.compile(f"(?<![^ ])(?:{pattern})(?![^ ])".encode())


@cache
def rules() -> list[Rule]:
    """All rules: families times versions and forms, creative-commons terms, tags, single phrases, base phrases."""
    made = []

    def add(label: str, priority: int, keyword: str, pattern: str) -> None:
        made.append(Rule(label, priority, keyword.encode(), _whole_words(pattern)))

    for label, keyword, names, versions in VERSIONED:
        for name in names:
            for version in versions:
                dashed = version.replace(" ", ".")
                add(f"{label}-{dashed}", 30, keyword, rf"{name}{TO_VERSION}{version}(?: only| or later| or any later version)?")
                if label in GNU and name == label:  # an identifier, with or without its header
                    for end in ("only", "or later"):
                        add(f"{label}-{dashed}-{end.replace(' ', '-')}", 35, keyword, rf"{name} {version} {end}")
            add(f"{label}-or-later", 20, keyword, rf"{name}{TO_VERSION}\S+ (?:or (?:at your option )?)?(?:any )?later")
            add(label, 10, keyword, rf"(?:licensed under|released under|under the terms of|distributed under)(?: the)? {name}")
    for terms in CREATIVE:
        label, spelled = "cc-" + terms.replace(" ", "-"), " ".join(f"(?:{PARTS[t]})" for t in terms.split())
        for version in CREATIVE_VERSIONS:
            add(f"{label}-{version.replace(' ', '.')}", 30, "cc", rf"cc {terms}{TO_VERSION}{version}")
            add(f"{label}-{version.replace(' ', '.')}", 30, "creative", rf"creative commons {spelled} {version}(?: international| unported| generic)?(?: licen[cs]e)?")
        add(label, 20, "cc", rf"cc {terms}")
        add(label, 20, "creative", rf"creative commons {spelled}")
    for label, keyword, pattern in PHRASES:
        add(label, 10, keyword, pattern)
    for clauses in "01234":
        add(f"bsd-{clauses}-clause", 20, "bsd", rf"bsd {clauses} clause(?: licen[cs]e)?|{clauses} clause bsd(?: licen[cs]e)?")
    add("spdx", 4, "spdx", r"spdx license identifier \S+(?: \d+ \d+)?(?: only| or later)?")
    for phrase, label in BASE.items():
        add(label, 5, max(phrase.split(), key=len), phrase)
    return made


class Detection(NamedTuple):
    start: int
    end: int
    priority: int
    label: str


def identifier_label(words: str) -> str:
    return re.sub(r"(?<=\b\d) (?=\d)", ".", words).replace(" ", "-")


def detect(normal: bytes, order: list[Rule]) -> Iterator[Detection]:
    """Matches of rules in words joined by single blanks, as intervals of words (ends exclusive).

    What follows "SPDX-License-Identifier" is read as identifiers joined by and, or, with; each is a detection above all
    rules, labelled as it is written. A plus sign is no word, so "GPL-2.0+" reads as the version alone.
    """
    blanks = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
    open_ = {k for k in {rule.keyword for rule in order} if k in normal}  # inside a word too: "gplv3"
    for rule in order:
        if rule.keyword in open_:
            for m in rule.pattern.finditer(normal):
                start = int(np.searchsorted(blanks, m.start()))
                yield Detection(start, start + m[0].count(b" ") + 1, rule.priority, rule.label)
    for expression in EXPRESSION.finditer(normal) if b"spdx" in normal else ():
        for m in ONE_IDENTIFIER.finditer(normal, *expression.span(1)):
            start = int(np.searchsorted(blanks, m.start()))
            yield Detection(start, start + m[0].count(b" ") + 1, 40, identifier_label(m[0].decode()))


def surviving(found: list[Detection]) -> list[Detection]:
    """Detections that are not inside one of a higher priority, or of the same priority and at least their length."""
    kept: list[Detection] = []
    starts: list[int] = []  # of what is kept from higher priorities, sorted, with the furthest end so far
    reach: list[int] = []
    for priority in sorted({d.priority for d in found}, reverse=True):
        inside, level = -1, []
        for d in sorted((d for d in found if d.priority == priority), key=lambda d: (d.start, -d.end, d.label)):
            k = bisect_right(starts, d.start) - 1
            same = bool(level) and level[-1][:2] == d[:2]  # equal intervals of other labels stay together
            if (k < 0 or reach[k] < d.end) and (inside < d.end or same):
                level.append(d)
                inside = max(inside, d.end)
        kept += level
        spans = sorted((d.start, d.end) for d in kept)
        starts = [s for s, _ in spans]
        reach = np.maximum.accumulate([e for _, e in spans]).tolist() if spans else []
    return kept


def places(normal: bytes) -> list[tuple[int, str]]:
    """Start and label of every place of a base phrase, overlapping ones too."""
    padded, found = b" " + normal + b" ", []
    for phrase, label in BASE.items():
        wanted = b" %s " % phrase.encode()
        at = padded.find(wanted)
        while at >= 0:
            found.append((at, label))
            at = padded.find(wanted, at + 1)
    if not found:
        return []
    blanks = np.flatnonzero(np.frombuffer(padded, np.uint8) == 32)
    return [(int(np.searchsorted(blanks, at)), label) for at, label in found]


def summary(text: str | None, order: list[Rule], keywords: tuple[bytes, ...]) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a text."""
    low = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z alone
    if not any(k in low for k in keywords):
        inside = _IN_WORD[np.frombuffer(low, np.uint8)]
        return int(np.count_nonzero(inside[1:] & ~inside[:-1]) + inside[:1].sum()), 0, None, None, "", "", 0.0
    words = WORD.findall(low)
    normal = b" ".join(words)
    base = places(normal)
    kept = surviving(list(detect(normal, order)))
    starts, base_labels = [s for s, _ in base], {label for _, label in base}
    longest = max((d.end - d.start for d in kept), default=0)
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)),
            ",".join(sorted(base_labels | {d.label for d in kept})), longest / (longest + 2) if longest else 0.0)


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace a text by `n_words, n_base, first_word, last_word, base_labels, labels, score`.

    `n_base` counts all places of base phrases, the two words are the smallest and largest start of one (null: none).
    `labels` are those of surviving detections, and the base labels. `score` grows with the words of the longest
    surviving detection, 0 without one. Null is the empty text. Narrow: one pass, no shuffle.
    """
    def make():
        order = rules()
        keywords = tuple(sorted({r.keyword for r in order}, key=len))
        return lambda values: ([summary(x, order, keywords)] for x in values)

    fields = [T.StructField(n, t) for n, t in (
        ("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()),
        ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()))]
    return map_text(df, text, fields, make)
