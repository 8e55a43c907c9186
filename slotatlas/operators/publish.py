"""Publish-ready facts: JSON-LD documents, landing rows, sitemap rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotatlas.functions.text import int_if_whole, name_sentence
from slotatlas.functions.timefn import col, day_index, minutes
from slotatlas.operators.ranking import distributed_rank, top_n


def _text(c) -> Column:
    """The text, or null when it is empty (``to_json`` leaves nulls out)."""
    return F.nullif(col(c), F.lit(""))


def _postal(address: Column) -> Column:
    return F.struct(F.lit("PostalAddress").alias("@type"), F.coalesce(address["street"], F.lit("")).alias("streetAddress"),
                    F.coalesce(address["zip"], F.lit("")).alias("postalCode"), F.coalesce(address["city"], F.lit("")).alias("addressLocality"),
                    F.lit("CH").alias("addressCountry"))


def business_docs(places: DataFrame) -> DataFrame:
    """One LocalBusiness document per place with an address; empty fields are left out."""
    geo = F.when((F.col("lat") != 0) & (F.col("lng") != 0), F.struct(
        F.lit("GeoCoordinates").alias("@type"), F.col("lat").cast("decimal(9,5)").alias("latitude"),
        F.col("lng").cast("decimal(9,5)").alias("longitude")))
    price = F.when(F.coalesce("single", F.lit(0.0)) != 0, F.concat(F.lit("CHF "), int_if_whole("single"), F.lit(" (Einzellektion)")))
    doc = F.to_json(F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("LocalBusiness").alias("@type"), F.col("name"),
        _postal(F.get(F.col("addresses"), F.lit(0))).alias("address"), _text("website").alias("url"), _text("phone").alias("telephone"),
        geo.alias("geo"), price.alias("priceRange")))
    return places.filter(F.size("addresses") > 0).select("id", doc.alias("doc"))


def event_docs(slots: DataFrame, places: DataFrame, part: str = "part", cap: int = 25) -> DataFrame:
    """Recurring-event documents of the first ``cap`` slots of each partition.

    The cap applies before the wide columns are built, and Spark limits each
    partition before the shuffle.
    """
    p = places.select(F.col("id").alias("place_id"), part, F.col("name").alias("place_name"), "website", "addresses", "single")
    joined = slots.join(p, "place_id", "left")
    first = top_n(joined, [part], [day_index("day"), minutes("time_start").asc_nulls_last(), F.col("place_id"), F.col("class_id")], cap)
    url = _text("website")
    doc = F.to_json(F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), F.col("class_name").alias("name"),
        F.struct(F.lit("Schedule").alias("@type"), F.concat(F.lit("https://schema.org/"), F.col("day")).alias("byDay"),
                 F.col("time_start").alias("startTime"), F.col("time_end").alias("endTime"), F.lit("P1W").alias("repeatFrequency")).alias("eventSchedule"),
        F.struct(F.lit("Place").alias("@type"), F.col("place_name").alias("name"), _postal(F.get(F.col("addresses"), F.lit(0))).alias("address")).alias("location"),
        F.struct(F.lit("Organization").alias("@type"), F.col("place_name").alias("name"), url.alias("url")).alias("organizer"), url.alias("url"),
        F.when(_text("teacher").isNotNull(), F.struct(F.lit("Person").alias("@type"), F.col("teacher").alias("name"))).alias("performer"),
        F.when(F.coalesce("single", F.lit(0.0)) != 0, F.struct(
            F.lit("Offer").alias("@type"), int_if_whole("single").alias("price"), F.lit("CHF").alias("priceCurrency"))).alias("offers")))
    return first.select(part, "rank", "class_id", doc.alias("doc"))


def faq_docs(facts: DataFrame, part: str = "part") -> DataFrame:
    """Question-and-answer document per partition from its facts
    (n_places, n_slots, n_tags, lo, hi, top_tags, top_cities). A fact that is absent leaves a plain sentence."""
    def qa(q, a):
        return F.struct(F.lit("Question").alias("@type"), q.alias("name"),
                        F.struct(F.lit("Answer").alias("@type"), a.alias("text")).alias("acceptedAnswer"))
    name = F.col(part)
    span = F.when(F.col("lo").isNotNull(), F.concat(F.lit(" A single entry costs CHF "), int_if_whole("lo"), F.lit(" to CHF "), int_if_whole("hi"), F.lit(".")))
    doc = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("FAQPage").alias("@type"), F.array(
        qa(F.concat(F.lit("How many places are there in "), name, F.lit("?")),
           F.concat(F.col("n_places").cast("string"), F.lit(" places with "), F.col("n_slots").cast("string"), F.lit(" weekly slots."))),
        qa(F.concat(F.lit("Which kinds are offered in "), name, F.lit("?")),
           F.coalesce(F.concat(F.col("top_tags"), F.lit(" and others, "), F.col("n_tags").cast("string"), F.lit(" in all.")), F.lit("No kinds are listed yet."))),
        qa(F.concat(F.lit("What does it cost in "), name, F.lit("?")), F.concat(F.lit("Prices vary."), F.coalesce(span, F.lit("")))),
        qa(F.concat(F.lit("In which towns of "), name, F.lit("?")), F.coalesce(F.concat(F.lit("For example in "), F.col("top_cities"), F.lit(".")), F.lit("No towns are listed yet."))),
    ).alias("mainEntity")))
    return facts.select(part, doc.alias("doc"))


def item_list(places: DataFrame, part: str = "part") -> DataFrame:
    """List items with their 1-based position; one row per item, because the list of
    a partition may be longer than a document can be."""
    ranked = distributed_rank(places.select(part, "id", "name", "website"), [part], [F.col("name"), F.col("id")], "position")
    item = F.to_json(F.struct(F.lit("ListItem").alias("@type"), F.col("position"), F.col("name"), _text("website").alias("url")))
    return ranked.select(part, "position", item.alias("item"))


def item_list_doc(places: DataFrame, part: str = "part", cap: int = 15) -> DataFrame:
    """Item-list document of the first ``cap`` places, with the full count."""
    counts = places.groupBy(part).agg(F.count("*").alias("n"))
    first = top_n(places.select(part, "id", "name", "website"), [part], [F.col("name"), F.col("id")], cap, "position")
    items = first.groupBy(part).agg(F.array_sort(F.collect_list(F.struct(
        "position", F.lit("ListItem").alias("@type"), "name", _text("website").alias("url")))).alias("items"))
    return items.join(counts, part).select(part, F.to_json(F.struct(
        F.lit("ItemList").alias("@type"), F.col("n").alias("numberOfItems"), F.col("items").alias("itemListElement"))).alias("doc"))


def landing_rows(rows: DataFrame, shown: int = 4) -> DataFrame:
    """Per (style, city): how many places, and a sentence with the first names.

    Only the first names travel; the count comes from a map-side aggregate.
    """
    counts = rows.groupBy("style", "city").agg(F.count("*").alias("n_places"))
    # One name more than shown is enough for the sentence, the rest is the count.
    first = top_n(rows.select("style", "city", "name", "id"), ["style", "city"], [F.col("name"), F.col("id")], shown)
    names = first.groupBy("style", "city").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("_names"))
    sentence = F.when(F.col("n_places") <= shown, name_sentence("_names")).otherwise(F.concat(
        F.array_join("_names", ", "), F.lit(" und "), (F.col("n_places") - shown).cast("string"), F.lit(" weitere")))
    return counts.join(names, ["style", "city"]).select("style", "city", "n_places", sentence.alias("names"))


def sitemap(urls: DataFrame, url: str, rules: list[tuple[str, str, str, str]], lastmod: Column) -> DataFrame:
    """Sitemap rows: the first rule (pattern, group, priority, changefreq) that matches wins."""
    rows = urls.groupBy(F.col(url).alias("loc")).agg(F.max(lastmod).alias("lastmod"))
    hit = F.coalesce(*[F.when(F.col("loc").rlike(p), F.struct(
        F.lit(i).alias("ord"), F.lit(g).alias("grp"), F.lit(prio).alias("priority"), F.lit(freq).alias("changefreq")))
        for i, (p, g, prio, freq) in enumerate(rules)])
    return rows.select("loc", "lastmod", hit.alias("h")).filter(
        F.col("loc").rlike("|".join(f"(?:{r[0]})" for r in rules))).select("loc", "lastmod", "h.*")


def alternates(locs: DataFrame, loc: str, sections: list[str], langs: list[str], present: Column) -> DataFrame:
    """Language alternates of the urls in the sections that have none yet."""
    inside = F.col(loc).rlike("|".join(s.replace(".", r"\.") for s in sections))
    listed = [F.struct(F.lit(x).alias("hreflang"), (F.col(loc) if x in (langs[0], "x-default") else
                       F.concat(F.col(loc), F.lit(f"?lang={x}"))).alias("href")) for x in [*langs, "x-default"]]
    return locs.filter(inside & ~present).select(loc, F.inline(F.array(*listed)))


def export_rows(places: DataFrame) -> DataFrame:
    """Flat export: name, one-line address, tags, teachers or ``-``, website or ``-``."""
    a = F.get(F.col("addresses"), F.lit(0))
    line = F.when(F.coalesce(a["street"], F.lit("")) != "", F.concat(
        a["street"], F.lit(", "), F.coalesce(a["zip"], F.lit("")), F.lit(" "), F.coalesce(a["city"], F.lit("")))).otherwise(F.lit(""))
    return places.select("id", "name", line.alias("address"), F.array_join("styles", ", ").alias("tags"),
                         F.coalesce(F.nullif(F.array_join("teachers", ", "), F.lit("")), F.lit("-")).alias("teachers"),
                         F.coalesce(_text("website"), F.lit("-")).alias("website"))


def report_lines(findings: DataFrame, order: list[str]) -> DataFrame:
    """Numbered text lines of the findings in report order."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    ranked = distributed_rank(findings.withColumn("_sev", rank), [], [F.col("_sev"), *[F.col(c) for c in order]], "line_no")
    return ranked.select("line_no", F.format_string("%d. [%s] %s %s: %s", "line_no", F.upper("severity"), "type", "entity_id", "value").alias("line"))
