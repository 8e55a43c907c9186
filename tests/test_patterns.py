"""Patterns and cuts made for speed find what the plain ones find."""

import random

from pyspark.sql import functions as F

from slotatlas import rules as R
from slotatlas.functions.patterns import led, look, word_tree
from slotatlas.functions.text import inner_text, without_element
from slotatlas.operators import extract as X
from slotatlas.operators import html as H

WORDS = sorted({w for ws in R.DAY_WORDS.values() for w in ws})
FLAT = "|".join(sorted(WORDS, key=lambda w: (-len(w), w)))


def texts(spark, parts, n=300, longest=14):
    rnd = random.Random(3)
    return spark.createDataFrame([("".join(rnd.choices(parts, k=rnd.randint(0, longest))),) for _ in range(n)] + [(None,), ("",)], "t string")


def same(df, **pairs):
    bad = df.select("t", *[F.struct(a.alias("a"), b.alias("b")).alias(k) for k, (a, b) in pairs.items()])
    for k in pairs:
        assert bad.filter(~F.col(k)["a"].eqNullSafe(F.col(k)["b"])).limit(3).collect() == [], k


def all_of(pattern):
    return F.regexp_extract_all("t", F.lit(pattern), F.lit(0))


def test_a_look_at_the_first_characters_loses_no_match(spark):
    parts = ["10", "5", "er", "1x", " ", "  ", "\t", "-", "karte", "carte", "abo", "pass", "de", "class", "classes", "drop", "in", "kurse", "60", "min", "cours", "à l'unité",
             "séance", "une ", "par ", "pro ", "lektion", "monats", "monat", "abo un", "limité", "probe", "erste ", "stunde", "gratis", "free", "preis", "specs.", "config.a", ".", "x", "é",
             "einzel", "mese", "trial", "kennen", "lern", "saturday", "s", "@", "at", "9:30", "10:15"]
    patterns = [*R.PRICE_KEYWORDS.values(), *R.FREE_TRIAL_PATTERNS, R.FREE_TRIAL_NOISE, R.PRICE_PAGE, r"\s*/?\s*\d{2}", rf"(?:{'|'.join(R.DAYS).lower()})s?\s*[@at]*\s*\d{{1,2}}:\d{{2}}"]
    assert all(look(p) for p in patterns)
    same(texts(spark, parts), **{f"p{i}": (all_of(led(p)), all_of(p)) for i, p in enumerate(patterns)})


def test_patterns_of_unknown_beginning_stay_as_they_are():
    assert [led(p) for p in ("a*", ".x", r"\p{L}x", "[^a]b")] == ["a*", ".x", r"\p{L}x", "[^a]b"]


def test_day_words_as_a_tree(spark):
    df = texts(spark, [*WORDS, *[w.title() for w in WORDS[:20]], *[w[:3] for w in WORDS], "s", " ", ", ", "ì", "12", "x"], 600, 6)
    flat = rf"(?i)(?<!\p{{L}})(?:{FLAT})s?(?!\p{{L}})"
    same(df, words=(all_of(f"(?i){H.DAY}"), all_of(flat)), tree=(all_of(word_tree(WORDS)), all_of(FLAT)))


TAGS = ["<h3>", "</h3>", "<H3 class='a'>", "<b>", "</B>", "<p", "<div a<b>", "<div>", "</div>", "</DIV >", "<tr>", "<TR x>", "<td>", "</td>", "</tr>", "</Tr>", "<span>", "</span>", "<",
        ">", "Montag", "fri", " ", "  ", "\n", " ", "\t \n", "text", "&amp;", "9:30", "<script>", "</script>", "</SCRIPT>", "<table>", "</Table>"]


def test_pages_are_cut_as_by_a_split(spark):
    heading = rf"<(?:h[1-6]|b)\b[^>]*>\s*{H.DAY}"
    border = r"(?is)</?(?:p|div|tr)\b[^>]*>"
    df = texts(spark, TAGS, 1500).filter("t is null or t <> ''")
    plain = F.transform(F.split("t", border, -1), inner_text)
    same(df, cut=(H.cut_before("t", heading), F.split("t", rf"(?ism)(?={heading})", -1)),
         rows=(H.cut_before("t", r"<tr\b[^>]*>"), F.split("t", r"(?ism)(?=<tr\b[^>]*>)", -1)),
         leaves=(H.leaves("t", "p|div|tr"), F.filter(plain, lambda x: x != "")))
    cut = df.select(H.cut_before("t", heading).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in cut  # a split compiles its pattern for every text


def test_closing_tags_are_found_in_any_case(spark):
    low = F.lower("t")
    last = F.length("t") - F.length(F.substring_index(low, "</tr>", -1))
    rest = F.substring_index(low, "</script>", -1)
    head = F.left("t", F.length("t") - F.length(rest))
    plain = F.when(rest == low, F.col("t")).otherwise(F.concat(F.regexp_replace(head, r"(?is)<script[^>]*>.*?</script>", " "), F.right("t", F.length(rest))))
    same(texts(spark, TAGS, 1500), closed=(H.closed("t", "</tr>"), F.left("t", last)), script=(without_element("t", "script"), plain))


def test_white_space_of_texts(spark):
    df = texts(spark, [" ", "  ", "\n", "\t", " ", "\r", "\x0b", "\f", "a", "b c"], 800)
    same(df, space=(inner_text("t"), F.trim(F.regexp_replace("t", r"[\s ]+", " "))))


def test_long_pages_need_no_deep_stack(spark):
    page = "<table><tr><th>Tag</th></tr>" + "<tr><td>Montag</td><td>9:00</td><td>Yin</td></tr>" * 20000 + "</table>" + "<i>x</i>" * 50000
    df = spark.createDataFrame([(1, page)], "id int, t string")
    got = df.select(F.size(H.cut_before("t", r"<tr\b")).alias("a"), F.size(H.leaves("t", "td")).alias("b"), F.size(X.table_slots("t")).alias("c")).first()
    assert (got.a, got.b, got.c) == (20002, 60002, 20001)


def test_calendar_without_dates(spark):
    li = "<li class='calendar__slot'><div class='sr-only'>{}</div><div class='session-time'>09:00 60 Min</div><div class='session-name'>Yin</div><div class='ellipsis'>Ann</div></li>"
    df = spark.createDataFrame([(li.format("Montag"),), (li.format("09/09/2025"),), (li.format("99/99/2025"),), (li.format(""),)], "t string")
    got = df.select(X.calendar_slots("t").alias("s"))
    assert [[x and (x.day, x.time_end, x.teacher) for x in r.s] for r in got.collect()] == [[("Monday", "10:00", "Ann")], [("Tuesday", "10:00", "Ann")], [None], [None]]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("nullif") + plan.count("= )") >= 2  # an empty date reaches no parser, which would raise for it
