"""Table schemas."""

from __future__ import annotations

MESSAGES = "channel STRING, source_type STRING, message_id BIGINT, date TIMESTAMP, message STRING"
LINES = "channel STRING, message_id BIGINT, line_no INT, text STRING, status STRING, reason STRING"
VARIANTS = (
    "cat STRING, brand STRING, series STRING, model STRING, cat_pos INT, brand_pos INT, series_pos INT, model_pos INT, "
    "variant_pos INT, title STRING"
)
PARAMS = (
    "storage STRING, ram INT, color STRING, color_1 STRING, color_2 STRING, colors ARRAY<STRING>, region STRING, sim STRING, "
    "code STRING, band_type STRING, band_color STRING, band_size STRING, screen_size STRING, watch_size_mm STRING, "
    "connectivity STRING, drive STRING, chip STRING, year STRING, anc STRING, `case` STRING, nano_glass BOOLEAN, "
    "no_watches BOOLEAN, game BOOLEAN"
)
OFFERS = (
    "path ARRAY<STRING>, brand STRING, series STRING, model STRING, code STRING, params STRUCT<"
    + PARAMS.replace(" STRING", ": STRING").replace(" INT", ": INT").replace(" ARRAY<STRING>", ": ARRAY<STRING>").replace(" BOOLEAN", ": BOOLEAN")
    + ">, price BIGINT, date TIMESTAMP, message_id BIGINT, channel STRING, raw STRING"
)
POSTS = "channel_id STRING, message_id BIGINT, text STRING, ts TIMESTAMP, has_media BOOLEAN, media_path STRING, model STRING, hidden BOOLEAN"
CHANNELS = (
    "channel_id STRING, name STRING, type STRING, text_mode STRING, round_prices BOOLEAN, pricing_custom BOOLEAN, markup_type STRING, "
    "markup_default DOUBLE, publish_time STRING, hide_time STRING"
)
PRICING_RULES = "rule_key STRING, mode STRING, base_mode STRING, pct DOUBLE, flat DOUBLE, round_step INT"
PAGES = "page_id BIGINT, url STRING, html STRING"
CACHE = "url_key STRING, price BIGINT, ts TIMESTAMP, ok BOOLEAN"
QUERIES = "chat_id BIGINT, user_id BIGINT, message_id BIGINT, ts TIMESTAMP, text STRING"
SOURCES = "source_type STRING, channel_id BIGINT, name STRING, username STRING, account STRING, user_id BIGINT"
SHEET = "row_no INT, name STRING"
