"""Negative rows and page shapes the round trips do not have."""

import time

from pyspark.sql import functions as F

from slotatlas.functions import price
from slotatlas.functions.text import rendered_text, unescape
from slotatlas.operators import extract as X
from slotatlas.operators import sequences
from slotatlas.operators.html import anchors, block_lines, tables


def run(spark, html, slots):
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    return [(r["day"], r["time_start"], r["time_end"], r["class_name"], r["teacher"]) for r in X.extract(df, "page_id", slots).orderBy("pos").collect()]


def test_table_without_schedule_header(spark):
    assert run(spark, "<table><tr><th>Name</th></tr><tr><td>Montag</td><td>09:00</td><td>Yin</td></tr></table>", X.table_slots("html")) == []


def test_table_first_cells_win_and_duplicates_fold(spark):
    row = "<tr><td>Mo ntag</td><td>Dienstag</td><td>18:00 - 19:15</td><td>Yin &amp; Yang</td><td>Room</td></tr>"
    html = f"<table><tr><th>Kurs</th></tr>{row}{row}</table>"
    assert run(spark, html, X.table_slots("html")) == [("Tuesday", "18:00", "19:15", "Mo ntag", "")]


def test_heading_state_and_limits(spark):
    many = "".join(f"<p>{8 + i // 6:02d}:{i % 6}0 - 20:00 Kurs {i}</p>" for i in range(35))
    html = f"<p>07:00 - 08:00 early</p><h2>Freitag</h2>{many}<h2>Info</h2><p>09:00 - 10:00 no day</p>"
    got = run(spark, html, X.heading_slots("html"))
    assert len(got) == 35 and {g[0] for g in got} == {"Friday"}
    assert len(run(spark, html, X.heading_slots("html", max_blocks=30))) == 30


def test_heading_single_clock_and_teacher(spark):
    html = "<h3>Samedi</h3><p>18.30 Hatha doux</p><p>10:00 - 11:00 Yin avec Lea M, Saal 2</p>"
    assert run(spark, html, X.heading_slots("html")) == [
        ("Saturday", "18:30", "", "Hatha doux", ""), ("Saturday", "10:00", "11:00", "Yin avec Lea M, Saal 2", "Lea M")]


def test_lines_take_names_from_neighbours(spark):
    text = "Montag\nVinyasa Flow\n9:00 - 10:00\nLea\nBuchen\n18:00 Yoga sanft\n12:00 nichts\nDienstag 7.4.\n10h00-11h15 Yin"
    assert run(spark, text, X.line_slots("html")) == [
        ("Monday", "09:00", "10:00", "Vinyasa Flow", "Lea"), ("Monday", "18:00", "", "Yoga sanft", ""), ("Tuesday", "10:00", "11:15", "Yin", "")]


def test_broken_payloads_yield_nothing(spark):
    for fn in (X.sessions_json, X.events_json, X.graphql_nodes, X.cms_items, X.flat_items):
        for bad in ("{broken", "", "[]", "{}", '{"sessions": 3}'):
            assert run(spark, bad, fn("html")) == []


def test_session_without_start_is_skipped(spark):
    assert run(spark, '{"sessions":[{"title":"x","start":{}},{"title":"","start":{"timestamp":"2024-01-02T10:00:00Z"}}]}', X.sessions_json("html")) == [
        ("Tuesday", "10:00", "", "Class", "")]


def test_cascade_uses_one_strategy(spark):
    html = "<h3>Montag</h3><p>09:00 - 10:00 Yin</p><table><tr><th>Kurs</th></tr><tr><td>Montag</td><td>11:00</td><td>Flow</td></tr></table>"
    df = spark.createDataFrame([(1, html), (2, "<p>nothing</p>"), (3, "Freitag\n10:00 - 11:00 Flow")], "page_id int, html string")
    order = [X.heading_slots("html"), X.table_slots("html"), X.line_slots(block_lines("html"))]
    got = {r["page_id"]: (r["best"]["strategy"], len(r["best"]["slots"])) if r["best"] else None for r in df.select("page_id", X.cascade(order).alias("best")).collect()}
    assert got == {1: (1, 1), 2: None, 3: (3, 1)}


def test_prices_prefer_the_rendering_with_single(spark):
    html = ("<noscript>Einzelstunde CHF 11</noscript><p>Unsere Preise</p><p>Monatsabo CHF 120</p>")
    df = spark.createDataFrame([(1, html, "https://x.ch/preise"), (2, "<p>kein Betrag hier drin</p>", "u")], "id int, html string, url string")
    got = {r["id"]: r["p"] for r in X.page_prices(df, "html", "url").collect()}
    assert set(got) == {1}
    # The first rendering has no single price and fewer fields, so the second one wins.
    assert got[1]["single"] == 11.0 and got[1]["monthly"] == 11.0


def test_service_price_shapes(spark):
    docs = ['{"services":[{"payment":{"fixed":{"price":30,"currency":"CHF"}}},{"payment":{"varied":{"price":25.5}}}]}',
            '{"services":[{"payment":{"fixed":{"price":{"value":"28","currency":"CHF"}}}}]}',
            '{"services":[{"payment":{"fixed":{"price":30,"currency":"EUR"}}}]}', '{"services":[{"payment":{"fixed":{"price":120}}}]}', "{broken"]
    df = spark.createDataFrame([(d,) for d in docs], "d string")
    assert [r[0] for r in df.select(X.service_prices("d")).collect()] == [25.5, 28.0, None, None, None]


def test_links(spark):
    html = ("<a href='/preise'>x</a><a href=\"#top\">Preise</a><a href='mailto:a@b.ch'>Preise</a><a href='https://other.ch/preise'>p</a>"
            "<a href='/list.PDF'>Preise</a><a href='team'>Unsere Preise</a><a href='/about'>Team</a>")
    df = spark.createDataFrame([(1, "https://www.x.ch/a/b", html)], "id int, url string, html string")
    got = X.page_links(df, "id", "url", "html", ["preis"])
    assert sorted(r["link"] for r in got.collect()) == ["https://www.x.ch/a/team", "https://www.x.ch/preise"]


def test_text_before(spark):
    text = "First. Second part! Deep Yin Fridays @ 15:15 and more. Late Flow Sunday 9:00"
    assert [(g[0], g[1], g[3]) for g in run(spark, text, X.text_before_slots("html"))] == [("Friday", "15:15", "Deep Yin"), ("Sunday", "9:00", "Late Flow")]


def test_table_day_is_inherited_and_header_cells_may_lack(spark):
    html = ("<table><tr><td><b>Montag</b></td><td>09:00 - 10:15</td><td>Yin</td></tr><tr><td></td><td>10.15 - 11.30</td><td>Hatha</td></tr>"
            "<tr><td>Dienstag</td><td>18:00</td><td>Flow</td></tr></table>")
    assert run(spark, html, X.table_slots("html")) == [
        ("Monday", "09:00", "10:15", "Yin", ""), ("Monday", "10:15", "11:30", "Hatha", ""), ("Tuesday", "18:00", "", "Flow", "")]


def test_headings_with_dates_and_tags_and_blocks_with_inline_tags(spark):
    blocks = "".join(f"<p>{h:02d}:00 - {h:02d}:45 <b>Vinyasa</b> {h}</p>" for h in range(6, 23)) * 3
    html = f"<h3><span>Montag</span></h3><p>09:00 - 10:15 <b>Yin</b></p><h3>Dienstag, 12. Januar</h3>{blocks}"
    got = run(spark, html, X.heading_slots("html"))
    assert got[0][:4] == ("Monday", "09:00", "10:15", "Yin") and len(got) == 18
    assert {g[0] for g in got[1:]} == {"Tuesday"}


def test_names_alike_in_forty_characters_stay_two(spark):
    name = "A very long class name that goes on and on and on "
    html = f"<h3>Montag</h3><p>09:00 - 10:00 {name}one</p><p>09:00 - 10:00 {name}two</p><p>09:00 - 10:00 {name}two</p>"
    assert [g[3] for g in run(spark, html, X.heading_slots("html"))] == [name + "one", name + "two"]


def test_many_tags_and_all_character_references(spark):
    from slotatlas.functions.text import strip_tags
    df = spark.createDataFrame([("<b>" * 100_000 + "x&#8211;y &szlig; &rsquo; &Uuml; &#x1F600; &amp;lt; &unknown; &#0;</b>",)], "h string")
    assert df.select(strip_tags("h")).first()[0] == "x–y ß ’ Ü 😀 &lt; &unknown; �"


def test_links_without_dot_segments(spark):
    from slotatlas.functions.urls import url_join
    df = spark.createDataFrame([("https://a.ch/x/y/z", h) for h in ("../k", "./k", "../../../k?q=../s", "k", "../")], "b string, h string")
    assert [r[0] for r in df.select(url_join("b", "h")).collect()] == [
        "https://a.ch/x/k", "https://a.ch/x/y/k", "https://a.ch/k?q=../s", "https://a.ch/x/y/k", "https://a.ch/x/"]


def test_no_length_limits_around_a_day(spark):
    long = "in unserem schoenen Studio an der Bahnhofstrasse 12 " * 3
    slot = [("Monday", "09:00", "10:00", "Yin", "")]
    assert run(spark, f"<h3>Montag {long}</h3><p>09:00 - 10:00 Yin</p>", X.heading_slots("html")) == slot
    assert run(spark, f"<h3>Montag <em>{long}</em> x</h3><p>09:00 - 10:00 Yin</p>", X.heading_slots("html")) == slot
    assert run(spark, f"<h3><b>Montag</b>, 12.03. {long}</h3><p>09:00 - 10:00 Yin</p>", X.heading_slots("html")) == slot
    assert run(spark, "<p><b>Montag</b> 09:00 - 10:00 Yin</p>", X.heading_slots("html")) == slot
    assert run(spark, "<h3>Montag 9:00 - 10:00</h3><p>11:00 - 12:00 Yin</p>", X.heading_slots("html")) == []
    words = long.replace("12", "")
    assert run(spark, f"<b>{words}Montag {words}</b><div>09:00 - 10:00 Yin</div>", X.day_block_slots("html")) == slot
    assert run(spark, f"{words}Montag {words}\n09:00 - 10:00 Yin", X.line_slots("html")) == slot
    assert run(spark, f"{words}Montag {words}\n09:00 - 10:00 Yin", X.line_slots("html", around_day=14)) == []


def test_second_values_have_no_limit_by_default(spark):
    df = spark.createDataFrame([("x", f"name\n{'y' * 70}")], "k string, t string")

    def second(limit):
        def columns(lines, i):
            return [sequences.neighbor_fallback(lines, i, F.get(lines, i), lambda c: F.length(c) > 2, limit)[1].alias("s")]
        return [r["s"] for r in sequences.line_rows(df, "t", lambda x: x == "name", columns, ["k"]).collect()]
    assert second(None) == ["y" * 70] and second(60) == [None]


def test_windows_around_keywords(spark):
    far = "x" * 200
    cases = {"einzel CHF 30": 30.0, f"CHF 12 {far} einzel {far} CHF 14": None, f"einzel {far} einzel 25 CHF": 25.0, "einzel einzel CHF 40 einzel fr. 35": 35.0,
             "\x01 einzel \x02 CHF 20": 20.0, "keine": None, "einzel" + " " * 149 + "CHF 77": None, "einzel" + " " * 143 + "CHF 77": 77.0,
             "CHF 9 " + "ä" * 140 + " einzel": 9.0, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", price.near_keyword("t", "einzel").alias("v")).collect()}
    assert got == cases


def test_time_is_linear_in_open_tags_and_hits(spark):
    texts = ["<script>" * 60_000, "<a href='x'>" * 40_000, "<" * 400_000, "<style>" * 60_000 + "</style>", "<table>" * 60_000, "<noscript>" * 50_000,
             "<div>" + "a" * 400_000 + "</div>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).cache()
    df.count()
    start = time.perf_counter()
    df.select(F.length(rendered_text("t")), F.size(anchors("t")), X.category_prices("t"), F.size(tables("t"))).write.format("noop").mode("overwrite").save()
    hits = spark.createDataFrame([("drop-in 25 chf " * 8000,)], "t string")
    assert hits.select(price.near_keyword("t", "drop-in")).first()[0] == 25.0
    assert time.perf_counter() - start < 60


def test_character_references_of_the_whole_table(spark):
    df = spark.createDataFrame([("a&comma;b&lpar;c&rpar;&nbsp;&NotEqualTilde;&#x41;&#66;&unknown;&amp;lt;",)], "t string")
    assert df.select(unescape("t")).first()[0] == "a,b(c) ≂̸AB&unknown;&lt;"
