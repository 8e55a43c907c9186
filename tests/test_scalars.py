"""Edge cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from slotatlas import rules as R
from slotatlas.functions import geo, price, text, timefn, urls


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}"
        for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("raw,default,strict", [
    ("9:00", 540, 540), ("09:05", 545, 545), (" 10:30 ", 630, 630), ("25:70", 1570, None), ("9h30", None, None), ("", None, None)])
def test_minutes(spark, raw, default, strict):
    assert one(spark, timefn.minutes("t"), t=raw) == default
    assert one(spark, timefn.minutes("t", strict=True), t=raw) == strict


def test_end_time_runs_past_midnight(spark):
    assert one(spark, timefn.end_time("t", F.lit(90)), t="23:00") == "24:30"


@pytest.mark.parametrize("raw,lang,day", [
    ("Montags", None, "Monday"), ("Soft Domino", None, None), ("di", "de", "Tuesday"), ("di", "fr", "Sunday"), ("di", None, None),
    ("Kurse am Mittwoch:", None, "Wednesday"), ("mercoledì", None, "Wednesday"), ("so what", None, None), ("Sundays", None, "Sunday")])
def test_day_normalize(spark, raw, lang, day):
    assert one(spark, timefn.day_normalize("t", lang), t=raw) == day


@pytest.mark.parametrize("raw,value", [("25-35", 25.0), ("25", 25.0), ("0", 0.0), ("29.5 CHF", 29.5), ("auf Anfrage", None), ("CHF 30", None)])
def test_parse_price(spark, raw, value):
    assert one(spark, price.parse_price("t"), t=raw) == value


def test_amount_notations(spark):
    raw = "CHF 30.50, 25 CHF, Fr. 20, 15 Fr, SFr. 18,50 und 12 Franken oder 30.- fein, CHF 3"
    assert set(one(spark, price.amounts("t"), t=raw)) == {30.5, 25.0, 20.0, 15.0, 18.5, 12.0, 30.0}


def test_near_keyword_windows_overlap(spark):
    pattern = R.PRICE_KEYWORDS["single"]
    raw = "x" * 200 + " Einzelstunde und nochmals Einzeleintritt CHF 28 " + "y" * 200 + " CHF 9"
    assert one(spark, price.near_keyword("t", pattern), t=raw) == 28.0
    far = "Einzelstunde " + "z" * 160 + " CHF 28"
    assert one(spark, price.near_keyword("t", pattern), t=far) is None
    assert one(spark, price.near_keyword("t", pattern), t="nothing here CHF 20") is None


def near_by_hand(raw, pattern, dist=150):
    import re
    found = []
    for m in re.finditer(pattern, raw, re.I):
        window = raw[max(0, m.start() - dist):m.end() + dist]
        for p in R.AMOUNT_PATTERNS:
            found += [float(x.replace(",", ".")) for x in re.findall(p, window, re.I)]
    found = [v for v in found if 5 <= v <= 5000]
    return min(found) if found else None


def test_near_keyword_equals_brute_force(spark):
    import random
    rng = random.Random(3)
    words = ["Einzelstunde", "CHF 30", "10er", "Fr. 250", "Monatsabo", "12 Franken", "Probe", "lorem", "ipsum " * 20, "99.-"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(120)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for field, pattern in R.PRICE_KEYWORDS.items():
        got = [r[0] for r in df.select(price.near_keyword("t", pattern)).collect()]
        assert got == [near_by_hand(t, pattern) for t in texts], field


def test_fallback_needs_a_price_page(spark):
    df = spark.createDataFrame([([30.0, 300.0, 120.0], True), ([30.0, 300.0, 120.0], False), ([30.0], True)], "f array<double>, p boolean")
    got = [tuple(r[0]) for r in df.select(price.amount_fallback("f", "p")).collect()]
    assert got == [(30.0, 300.0, 120.0), (None, None, None), (None, None, None)]


def test_free_trial_stays_in_the_sentence(spark):
    assert one(spark, price.free_trial("t"), t="Die Probestunde ist gratis.")
    assert not one(spark, price.free_trial("t"), t="Probestunde buchen. Der Parkplatz ist gratis.")
    assert not one(spark, price.free_trial("t"), t='wix: "true" trial free')


def test_slugs(spark):
    assert one(spark, text.slugify("t"), t=" Zénith  Yoga & Müller ") == "zenith-yoga-muller"
    assert one(spark, text.slugify_plain("t"), t="Züri Yoga!") == "z-ri-yoga"
    got = one(spark, text.slug_candidates("i", "n", "u"), i="a1", n="Oase Yoga", u="https://www.oase.ch/x")
    assert got == ["a1", "oase-yoga", "oase", "yoga-oase-yoga", "oaseyoga"]


def test_url_join(spark):
    base = "https://a.ch/x/y?q=1"
    for href, full in [("/z", "https://a.ch/z"), ("z", "https://a.ch/x/z"), ("?p=2", "https://a.ch/x/y?p=2"),
                       ("//b.ch/c", "https://b.ch/c"), ("https://c.ch", "https://c.ch"), ("mailto:a@b", "mailto:a@b")]:
        assert one(spark, urls.url_join("b", "h"), b=base, h=href) == full


def test_embed_stop_words(spark):
    assert one(spark, urls.embed_id("t", "momoyoga"), t="https://momoyoga.com/embed/x") is None
    assert one(spark, urls.embed_id("t", "momoyoga"), t="https://momoyoga.com/oase") == "oase"


def test_truncate_and_sentence(spark):
    long = "wort " * 40
    got = one(spark, text.truncate_words("t"), t=long)
    assert got.endswith("wort...") and len(got) <= 150
    assert one(spark, text.name_sentence("a"), a=["A", "B", "C"]) == "A, B und C"
    assert one(spark, text.name_sentence("a"), a=list("ABCDEF")) == "A, B, C, D und 2 weitere"


def test_distances(spark):
    assert abs(one(spark, geo.haversine_km("a", "b", "c", "d"), a=47.0, b=8.0, c=48.0, d=8.0) - 111.195) < 0.01
    assert one(spark, geo.planar_km("a", "b", "c", "d"), a=47.0, b=8.0, c=48.0, d=8.0) == 111.0


def test_estimate_uses_bankers_rounding(spark):
    df = spark.createDataFrame([("x", "Hot Place", ["Hot Yin", "b", "c"])], "tier string, name string, tags array<string>")
    v = df.select(price.tier_estimate("single", "tier", "name", "name", "tags")).first()[0]
    import hashlib
    frac = int(hashlib.md5(b"Hot Place").hexdigest()[:8], 16) / 0xFFFFFFFF
    assert v == round(round(22 + 8 * frac) * 1.15)
