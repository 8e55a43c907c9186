"""Small SQL fragments shared by the oracle texts."""


def sql_minutes(t: str) -> str:
    return (f"CASE WHEN regexp_matches(trim({t}), '^[0-9]{{1,2}}:[0-9]{{2}}$') "
            f"THEN CAST(split_part(trim({t}), ':', 1) AS INTEGER) * 60 "
            f"+ CAST(split_part(trim({t}), ':', 2) AS INTEGER) END")


def sql_clock(m: str) -> str:
    return (f"concat(lpad(CAST(CAST(floor(({m}) / 60) AS INTEGER) AS VARCHAR), 2, '0'), ':', "
            f"lpad(CAST(({m}) % 60 AS VARCHAR), 2, '0'))")


def sql_host(u: str) -> str:
    return (f"regexp_replace(lower(regexp_extract({u}, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '')")


def sql_slugify(s: str) -> str:
    folded = f"translate(lower(trim({s})), 'àáâãäåèéêëìíîïòóôõöùúûü', 'aaaaaaeeeeiiiiooooouuuu')"
    return (f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({folded}, "
            f"'[^a-z0-9\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')")


def sql_int_if_whole(v: str) -> str:
    return f"CASE WHEN {v} = floor({v}) THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE CAST({v} AS VARCHAR) END"


def sql_parse_price(v: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({v}, '^([0-9]+([.][0-9]+)?)', 1), '') AS DOUBLE)"


def sql_day_index(d: str) -> str:
    return (f"CASE {d} WHEN 'Monday' THEN 0 WHEN 'Tuesday' THEN 1 WHEN 'Wednesday' THEN 2 "
            f"WHEN 'Thursday' THEN 3 WHEN 'Friday' THEN 4 WHEN 'Saturday' THEN 5 "
            f"WHEN 'Sunday' THEN 6 ELSE 99 END")


SQL_TEXT = (
    "trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace("
    "regexp_replace(regexp_replace(regexp_replace({h}, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), "
    "'(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), "
    "'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), "
    "'&amp;', '&'), '\\x{{A0}}', ' ', 'g'), '\\s+', ' ', 'g'))")


def sql_visible_text(h: str) -> str:
    return SQL_TEXT.format(h=h)
