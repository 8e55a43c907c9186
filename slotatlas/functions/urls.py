"""URL columns: hosts, normal forms, joins, platforms and embed ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotatlas.functions.timefn import col
from slotatlas.rules import EMBED_PATTERNS, EMBED_STOP, PLATFORM_PATTERNS, SPONSORED_HOSTS


def host(url) -> Column:
    """Lower-case host without ``www.``; '' when there is none."""
    h = F.lower(F.coalesce(F.try_parse_url(col(url), F.lit("HOST")), F.lit("")))
    return F.regexp_replace(h, r"^www\.", "")


def host_label(url) -> Column:
    """First label of the host, as a slug."""
    return F.split_part(host(url), F.lit("."), F.lit(1))


def url_norm(url) -> Column:
    return F.lower(F.regexp_replace(col(url), "/+$", ""))


def url_origin(url) -> Column:
    return F.regexp_extract(col(url), r"^(https?://[^/?#]+)", 1)


def url_join(base, href) -> Column:
    """Absolute form of a link: absolute, //host, /root and relative references."""
    base, href = col(base), col(href)
    origin = url_origin(base)
    path = F.regexp_extract(base, r"^https?://[^/?#]+(/[^?#]*)?", 1)
    folder = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), r"[^/]*$", "")
    return (F.when(href.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), href)
            .when(F.startswith(href, F.lit("//")),
                  F.concat(F.regexp_extract(base, r"^(https?:)", 1), href))
            .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
            .when(F.startswith(href, F.lit("?")),
                  F.concat(origin, F.when(path == "", F.lit("/")).otherwise(path), href))
            .otherwise(F.concat(origin, _without_dots(F.concat(folder, href)))))


def _without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; what follows ``?`` or ``#`` stays."""
    tail = F.regexp_extract(path, r"[?#].*$", 0)
    steps = F.split(F.regexp_replace(path, r"[?#].*$", ""), "/")
    up = lambda x: (x == "..") | (x == ".")
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, x: F.when(
        x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    slash = F.when(up(F.element_at(steps, -1)), F.lit("/")).otherwise(F.lit(""))
    dotted = F.concat(F.array_join(kept, "/"), slash, tail)
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:[/?#]|$)"), dotted).otherwise(path)


def link_policy(url) -> Column:
    """rel value of an outgoing link."""
    pattern = "|".join(h.replace(".", r"\.") for h in SPONSORED_HOSTS)
    return (F.when(col(url).isNull() | (col(url) == ""), F.lit("noopener noreferrer"))
            .when(col(url).rlike(pattern), F.lit("sponsored noopener noreferrer"))
            .otherwise(F.lit("nofollow noopener noreferrer")))


def platform(html, url, default: str = "website") -> Column:
    """First platform in the fixed order whose pattern hits the page or its url."""
    hits = [F.when(col(html).rlike(f"(?i){p}") | col(url).rlike(f"(?i){p}"), F.lit(name))
            for name, p in PLATFORM_PATTERNS]
    return F.coalesce(*hits, F.lit(default))


def embed_id(html, name: str) -> Column:
    """Embed id of one platform: ordered patterns, stop words skipped."""
    stop = EMBED_STOP.get(name, [])
    found = [F.nullif(F.regexp_extract(col(html), p, 1), F.lit("")) for p in EMBED_PATTERNS[name]]
    if stop:
        found = [F.when(~f.isin(stop), f) for f in found]
    return F.coalesce(*found)


def first_link_match(url, links: list, pattern: str) -> Column:
    """Capture of the pattern in the url, else in the first matching link."""
    own = F.nullif(F.regexp_extract(col(url), pattern, 1), F.lit(""))
    merged = F.concat(*[F.coalesce(col(a), F.array().cast("array<string>")) for a in links])
    hits = F.filter(F.transform(merged, lambda u: F.regexp_extract(u, pattern, 1)), lambda s: s != "")
    return F.coalesce(own, F.get(hits, F.lit(0)))


def url_rewrite(url, widget_id) -> Column:
    """Listing url of a platform page: ``/classes`` appended, or the widget url of an id."""
    base = F.regexp_replace(col(url), "/+$", "")
    classes = F.when(base.rlike("/classes$"), col(url)).otherwise(F.concat(base, F.lit("/classes")))
    return (F.when(F.contains(col(url), F.lit("eversports.ch/s/")), classes)
            .when(F.coalesce(col(widget_id), F.lit("")) != "",
                  F.concat(F.lit("https://go.mindbodyonline.com/book/widgets/schedules/view/"),
                           col(widget_id), F.lit("/schedule")))
            .otherwise(col(url)))


def route_method(platform_col, url) -> Column:
    p = F.lower(F.coalesce(col(platform_col), F.lit("")))
    return (F.when((p == "eversports") | F.contains(col(url), F.lit("eversports.ch/s/")), F.lit("eversports"))
            .when(p == "sportsnow", F.lit("sportsnow")).otherwise(F.lit("auto")))


def url_health(status, url, final_url, error) -> Column:
    """Issue tag of one crawl-log row."""
    moved = (host(url) != "") & (host(final_url) != "") & (host(url) != host(final_url))
    return (F.when(col(error).isNotNull(), F.lit("CONNECTION_ERROR"))
            .when(col(status) == 404, F.lit("404_NOT_FOUND"))
            .when(col(status) >= 400, F.concat(F.lit("HTTP_"), col(status).cast("string")))
            .when(moved, F.lit("DOMAIN_REDIRECT")).otherwise(F.lit("OK")))


def first_keyword(text, table: list[tuple[str, str]]) -> Column:
    """Target of the first keyword, in table order, that the text contains."""
    return F.coalesce(*[F.when(F.contains(F.lower(col(text)), F.lit(k)), F.lit(v)) for k, v in table])


def category_by_rules(text, rules, default: str = "unknown") -> Column:
    """First rule whose words hit: any of the first list, or all of the second."""
    low = F.lower(col(text))

    def hit(words):
        return [F.contains(low, F.lit(w)) for w in words]

    whens = []
    for any_of, all_of, name in rules:
        cond = reduce(lambda a, b: a | b, hit(any_of)) if any_of else \
            reduce(lambda a, b: a & b, hit(all_of))
        whens.append(F.when(cond, F.lit(name)))
    return F.coalesce(*whens, F.lit(default))
