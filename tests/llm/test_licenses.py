import random
import re

from slotatlas.llm import licenses, queries
from tests.conftest import SF_DIR

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(text):
    words, places = WORD.findall((text or "").translate(LOWER)), []
    for phrase, label in licenses.BASE.items():
        want = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k:k + len(want)] == want]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def test_base_places_against_brute_force(spark):
    rng = random.Random(9)
    bits = ["CC", "by", "-", " ", "general", "public", "license", "ALL", "rights", "reserved", "é", "\n", "東", "GNU ", "K"]
    texts = [None, "", "cc by cc by cc-by", "General Public License, all rights reserved", "ccby", "x" * 100000 + " cc by", "Ünlü CC BY",
             *("".join(rng.choices(bits, k=30)) for _ in range(400)), " ".join(["all rights reserved"] * 5000)]
    df = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "doc_id long, text string, labels string")
    rows = licenses.scan(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id]), texts[r.doc_id][:80]
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert licenses.scan(df.limit(0)).count() == 0


def labels(text):
    order = licenses.rules()
    return licenses.summary(text, order, tuple({r.keyword for r in order}))[5]


def test_specific_rules_suppress_general_ones_inside():
    assert labels("Licensed under the Apache License, Version 2.0") == "apache,apache-2.0"
    assert labels("the Apache License, Version 2.0 applies") == "apache-2.0"
    assert labels("GNU Lesser General Public License v2.1 or later") == "gpl,lgpl-2.1"
    assert labels("CC BY-SA 4.0") == "cc-by,cc-by-sa-4.0"
    assert labels("Creative Commons Attribution-ShareAlike 4.0 International") == "cc-by-sa-4.0"
    assert labels("released under the MIT License") == "mit"
    assert labels("plain text") == ""


def test_hundreds_of_rules():
    assert len(licenses.rules()) > 200


def test_containment_by_priority():
    d = licenses.Detection
    kept = licenses.surviving([d(0, 5, 10, "a"), d(1, 3, 10, "b"), d(1, 3, 20, "c"), d(4, 8, 5, "e"), d(2, 3, 5, "f"), d(0, 5, 10, "g")])
    assert {x.label for x in kept} == {"a", "c", "e", "g"}


def test_glued_versions_and_years():
    order = licenses.rules()
    keywords = tuple(sorted({r.keyword for r in order}, key=len))
    labels = lambda text: licenses.summary(text, order, keywords)[5].split(",")
    for text, label in (("GPLv3", "gpl-3"), ("under LGPLv2.1 here", "lgpl-2.1"), ("AGPLv3", "agpl-3"), ("MPLv2.0", "mpl-2.0"), ("MPLv2", "mpl-2"),
                        ("\u00a92024 Someone", "copyright"), ("Copyright \u00a92023-2024", "copyright"), ("GPL v3", "gpl-3"), ("GPL 3", "gpl-3"),
                        ("GPL version 3", "gpl-3"), ("CC BYv4.0", "cc-by-4.0"), ("\u00a9 2024", "copyright")):
        assert label in labels(text), text
    assert "gpl-or-later" in labels("GPLv9 or later") and labels("agplvx mplv mpl2 x\u00a92024") == [""]


def test_an_identifier_does_not_hide_its_license():
    found = licenses.surviving(list(licenses.detect(b"spdx license identifier apache 2 0", licenses.rules())))
    assert {d.label for d in found} == {"spdx", "apache-2.0"}


def test_identifiers_are_read_into_labels():
    spdx = "SPDX-License-Identifier: "
    for text, wanted in (
            ("MIT", "mit,spdx"), ("Apache-2.0", "apache-2.0,spdx"), ("ISC", "isc,spdx"), ("BSD-3-Clause", "bsd-3-clause,spdx"),
            ("GPL-2.0-only", "gpl-2.0-only,spdx"), ("GPL-2.0-or-later", "gpl-2.0-or-later,spdx"), ("CC0-1.0", "cc0-1.0,spdx"),
            ("MIT OR Apache-2.0", "apache-2.0,mit,spdx"), ("(MIT AND BSD-2-Clause)", "bsd-2-clause,mit,spdx"),
            ("GPL-2.0-or-later WITH Classpath-exception-2.0", "classpath-exception-2.0,gpl-2.0-or-later,spdx"),
            ("Apache-2.0 WITH LLVM-exception", "apache-2.0,llvm-exception,spdx"), ("CC-BY-SA-4.0", "cc-by,cc-by-sa-4.0,spdx"),
            ("LGPL-2.1-only OR MIT", "lgpl-2.1-only,mit,spdx"), ("Unknown-1", "spdx")):
        assert labels(spdx + text) == wanted, text
    assert labels("GPL-2.0-only") == "gpl-2.0-only" and labels("GPL-2.0-or-later") == "gpl-2.0-or-later"
    assert labels("license: MIT") == "mit" and labels("the BSD-3-Clause terms") == "bsd-3-clause"
    assert labels("permit isc mitten") == "" and labels(spdx + "MITx").split(",") == ["spdx"]


def test_repeated_rows_and_ties(spark):
    text = "SPDX-License-Identifier: MIT\nGPL-2.0-only and GPL-2.0-only"
    rows = licenses.scan(spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id long, text string")).collect()
    assert sorted(r.labels for r in rows) == ["", "gpl-2.0-only,mit,spdx", "gpl-2.0-only,mit,spdx"]


def test_registered_query_on_the_given_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op10_license_scan"](spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert r.labels == labels(texts[r.doc_id])
