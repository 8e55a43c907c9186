"""Lookup joins, anti joins, diffs and spatial joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotatlas import rules as R
from slotatlas.functions import geo, price
from slotatlas.functions.text import tag_matches
from slotatlas.functions.timefn import col


def orphans(children: DataFrame, parents: DataFrame, key: str, label: list[str]) -> DataFrame:
    """Child keys absent from the parents: one row per (key, label…) with a count."""
    grouped = children.groupBy(key, *label).agg(F.count("*").alias("n_children"))
    return grouped.join(parents.select(key), key, "left_anti")


def semi_count(children: DataFrame, parents: DataFrame, key: str, part: str) -> DataFrame:
    """Children of the given parents, counted per partition of the parent.

    Children are counted per key before they meet the parents.
    """
    counts = children.groupBy(key).agg(F.count("*").alias("n"))
    return parents.select(key, part).join(counts, key).groupBy(part).agg(F.sum("n").alias("n_children"))


def without_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children.select(key).distinct(), key, "left_anti")


def apply_verified(entities: DataFrame, research: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Replace prices by verified research, remove the others; ``action`` says which.

    A research row counts when it is verified and has at least one real price.
    """
    has_new = F.coalesce(F.col("r.verified"), F.lit(False)) & price.any_real_price([F.col(f"r.{f}") for f in fields])
    had_old = F.greatest(*[F.col(f"e.{f}").isNotNull() for f in fields])
    joined = entities.alias("e").join(research.alias("r"), key, "left")
    return joined.select(
        key, *[F.when(has_new, price.parse_price(F.col(f"r.{f}"))).alias(f) for f in fields],
        F.when(has_new, F.lit("verified")).when(had_old, F.lit("removed")).otherwise(F.lit("unchanged")).alias("action"))


def recover_existing(missing: DataFrame, known: DataFrame, key: str, prices: list[str]) -> DataFrame:
    """Fill from an existing table first; ``recovered`` false = still needed.

    Only rows that are verified and hold a real price count.
    """
    usable = known.filter(F.coalesce("verified", F.lit(False)) & price.any_real_price([F.col(p) for p in prices])).drop("verified")
    return missing.join(usable.withColumn("recovered", F.lit(True)), key, "left").fillna({"recovered": False})


def unpivot(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Long form (keys, field, value) without null values."""
    return df.unpivot(keys, fields, "field", "value").filter("value IS NOT NULL")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str],
                  threshold: float = R.CHANGE_PCT) -> DataFrame:
    """Fields that moved by more than the threshold; null or zero old values are skipped."""
    pct = price.pct_change("old_value", "new_value")
    return field_pairs(old, new, keys, fields).filter(pct > threshold).select(
        *keys, "field", "old_value", "new_value", pct.alias("pct"),
        price.signed_pct("old_value", "new_value").alias("signed_pct"),
        price.change_severity(pct).alias("severity"))


def field_pairs(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Both values of every field. The wide rows join first: one shuffle per side
    on the key, and only then the fields unfold."""
    a = old.select(*keys, F.struct(*fields).alias("_old"))
    b = new.select(*keys, F.struct(*fields).alias("_new"))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_old.{f}").alias("old_value"),
                               F.col(f"_new.{f}").alias("new_value")) for f in fields])
    kept = F.filter(pairs, lambda p: p["old_value"].isNotNull() & p["new_value"].isNotNull())
    return a.join(b, keys).select(*keys, F.inline(kept))


def field_diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Any inequality where both values are present: rows of the change log."""
    return field_pairs(old, new, keys, fields).filter("old_value <> new_value")


def close_pairs(points: DataFrame, part: str, x: str, y: str, key: str, eps: float = R.CLOSE_DEGREES,
                target: int = 2000) -> DataFrame:
    """Rows of a partition closer than eps in both coordinates.

    The first row of a position stands for it: two close positions give one pair with the numbers of rows at each, and
    each further row at a position is paired with its first one (numbers 1 and 1), so equal rows never multiply. The
    positions meet in a grid join: cell = floor(x / eps), one side visits the 9 neighbour cells. The rows of a cell are
    dealt into ceil(rows / target) salts on one side and visit all salts on the other, whatever their number.
    """
    here = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    at = here.groupBy(part, x, y).agg(F.min(key).alias("_id"), F.count("*").alias("_n"))
    at = at.withColumns({"_cx": F.floor(F.col(x) / eps), "_cy": F.floor(F.col(y) / eps)})
    cell = [part, "_cx", "_cy"]
    salts = at.groupBy(*cell).agg(F.ceil(F.count("*") / target).alias("_salts"))
    left = at.join(salts, cell).withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_salts")))
    left = left.select(*cell, "_salt", F.col(x).alias("x_1"), F.col(y).alias("y_1"), F.col("_id").alias("id_1"), F.col("_n").alias("n_1"))
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                                for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    right = at.withColumn("_s", steps).select(
        part, (F.col("_cx") + F.col("_s.dx")).alias("_cx"), (F.col("_cy") + F.col("_s.dy")).alias("_cy"),
        F.col(x).alias("x_2"), F.col(y).alias("y_2"), F.col("_id").alias("id_2"), F.col("_n").alias("n_2"))
    right = right.join(salts, cell).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1)))
    near = (F.abs(F.col("x_1") - F.col("x_2")) < eps) & (F.abs(F.col("y_1") - F.col("y_2")) < eps)
    apart = left.join(right, [*cell, "_salt"]).filter((F.col("id_1") < F.col("id_2")) & near).select(part, "id_1", "id_2", "n_1", "n_2")
    shared = at.filter("_n > 1").select(part, x, y, F.col("_id").alias("id_1"))
    one = F.lit(1).cast("bigint")
    equal = here.join(shared, [part, x, y]).filter(F.col(key) > F.col("id_1")).select(
        part, "id_1", F.col(key).alias("id_2"), one.alias("n_1"), one.alias("n_2"))
    return apart.unionByName(equal)


def same_position(points: DataFrame, part: str, x: str, y: str, key: str) -> DataFrame:
    """Positions held by more than one row: first key and how many."""
    return points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(part, x, y) \
        .agg(F.min(key).alias("id_1"), F.count("*").alias("n_same")).filter("n_same > 1")


def within_radius(points: DataFrame, centers: list[tuple[str, float, float, float]], lat="lat", lng="lng",
                  mode: str = "haversine") -> DataFrame:
    """Rows within the radius (km) of each center; the centers are a short rule list."""
    fn = geo.planar_km if mode == "planar" else geo.haversine_km
    listed = F.array(*[F.struct(F.lit(n).alias("center"), F.lit(float(a)).alias("lat0"), F.lit(float(b)).alias("lng0"),
                                F.lit(float(r)).alias("radius_km")) for n, a, b, r in centers])
    near = F.filter(listed, lambda c: fn(lat, lng, c["lat0"], c["lng0"]) <= c["radius_km"])
    return points.withColumn("_c", F.explode(near)).withColumn("center", F.col("_c.center")) \
        .withColumn("km", fn(lat, lng, F.col("_c.lat0"), F.col("_c.lng0"))).drop("_c")


def override_lookup(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Lookup from two sources; the second one overrides."""
    a, b = first.select(key, F.col(value).alias("_a")), second.select(key, F.col(value).alias("_b"))
    return a.join(b, key, "full").select(key, F.coalesce("_b", "_a").alias(value),
                                         F.when(F.col("_b").isNotNull(), F.lit("second")).otherwise(F.lit("first")).alias("origin"))


def style_city(places: DataFrame, roots: dict[str, list[str]], tags: str, city: str) -> DataFrame:
    """One row per place and style it offers; styles come from a short rule list."""
    hits = F.array(*[F.when(tag_matches(tags, r), F.lit(name)) for name, r in roots.items()])
    return places.withColumn("style", F.explode(F.filter(hits, lambda s: s.isNotNull())))


def cross_links(combos: DataFrame, first: int = 6) -> DataFrame:
    """Per (style, city): the first other styles of the city and other cities of the style, and how many there are.

    Each list is cut to ``first`` names before it is gathered, so a style in very many cities costs no more.
    """
    pairs = combos.select("style", "city").distinct()

    def others(group: str, name: str, out: str) -> DataFrame:
        numbered = pairs.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(name))).filter(F.col("_r") <= first + 1)
        names = numbered.groupBy(group).agg(F.array_sort(F.collect_list(name)).alias(out))
        return pairs.groupBy(group).agg((F.count("*") - 1).alias(f"n_{out}")).join(names, group)

    def listed(names: str, own: str) -> Column:
        return F.array_join(F.slice(F.array_except(names, F.array(own)), 1, first), ",").alias(names)

    return pairs.join(others("city", "style", "other_styles"), "city").join(others("style", "city", "other_cities"), "style").select(
        "style", "city", listed("other_styles", "style"), "n_other_styles", listed("other_cities", "city"), "n_other_cities")


def label_lookup(key, labels: dict[str, dict[str, str]], lang: str, fallback: str = "de") -> Column:
    """Label in the language, else in the fallback language, else the key itself."""
    pairs = {k: v.get(lang, v.get(fallback)) for k, v in labels.items() if v.get(lang, v.get(fallback))}
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(table, col(key)), col(key))


def alias_key(key, aliases: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, col(key)), col(key))
