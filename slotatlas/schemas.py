"""Schemas of the directory data model, as DDL texts (usable before a session exists)."""

ADDRESS = "STRUCT<street:STRING,zip:STRING,city:STRING,label:STRING>"
PRICING = ("STRUCT<single:DOUBLE,card_10:DOUBLE,monthly:DOUBLE,trial:DOUBLE,abo:DOUBLE,"
           "currency:STRING,verified:BOOLEAN,source:STRING,last_checked:STRING,notes:STRING>")
LINK = "STRUCT<platform:STRING,url:STRING>"
META = (f"STRUCT<last_scraped:STRING,last_price_check:STRING,scrape_status:STRING,"
        f"booking_links:ARRAY<{LINK}>,source_urls:MAP<STRING,STRING>>")

PLACE_FIELDS = (
    "id STRING, name STRING, website STRING, schedule_url STRING, "
    f"addresses ARRAY<{ADDRESS}>, phone STRING, email STRING, styles ARRAY<STRING>, "
    "teachers ARRAY<STRING>, description STRING, booking_platform STRING, drop_in BOOLEAN, "
    "languages ARRAY<STRING>, special_features ARRAY<STRING>, lat DOUBLE, lng DOUBLE, "
    f"active BOOLEAN, closed_note STRING, pricing {PRICING}, scrape_status STRING, "
    f"last_scraped STRING, detected_booking_links ARRAY<{LINK}>, _meta {META}")
SLOT_FIELDS = (
    "studio_id STRING, studio_name STRING, day STRING, time_start STRING, time_end STRING, "
    "class_name STRING, teacher STRING, level STRING, source STRING, verified BOOLEAN, "
    "last_checked STRING")


def _struct(fields: str) -> str:
    return "STRUCT<" + ", ".join(
        f"{f.strip().split(' ', 1)[0]}:{f.strip().split(' ', 1)[1]}"
        for f in _split_top(fields)) + ">"


def _split_top(fields: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in fields:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return out + [cur]


PLACE_ENVELOPE = f"last_updated STRING, studios ARRAY<{_struct(PLACE_FIELDS)}>"
SLOT_ENVELOPE = (
    "last_updated STRING, _notes STRING, _meta STRUCT<last_updated:STRING,note:STRING>, "
    f"classes ARRAY<{_struct(SLOT_FIELDS)}>")
DIMENSION_ENVELOPE = (
    "cantons ARRAY<STRUCT<id:STRING,name:STRUCT<de:STRING,en:STRING,it:STRING,fr:STRING>,"
    "abbreviation:STRING,capital:STRING,studio_count:INT,status:STRING>>")
CHANGE = (
    "timestamp STRING, studio_id STRING, canton STRING, field STRING, old_value DOUBLE, "
    "new_value DOUBLE, source STRING")
FINDING_COLUMNS = ["type", "severity", "entity_id", "entity_name", "part", "field",
                   "value", "expected_range", "message"]
