"""Source payloads: nested settings merged into defaults, and what is wrong with them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("telegram", "rss", "web", "api", "email")
#: Settings of every source.
DEFAULTS = {
    "preset": "custom",
    "quality_tier": "standard",
    "expected_signal_types": [],
    "source_authority": 0.5,
    "source_region": "global",
    "market_scope": "global",
    "fetch": {"lookback_hours": 24, "max_items_per_run": 50, "timeout_sec": 20, "use_conditional_get": True},
    "filters": {"include_keywords": [], "exclude_keywords": [], "lang_allow": []},
    "parse": {
        "full_content": False, "extract_author": True, "extract_tags": True, "listing_selector": "", "link_selector": "", "title_selector": "", "date_selector": "", "article_selector": "",
        "field_map": {},
    },
    "vision": {"mode": "full", "max_media_bytes": 9_000_000},
    "dedupe": {"strategy": "guid_or_url", "canonicalize_url": True},
}
#: Settings of kinds of sources that differ from those.
KIND_DEFAULTS = {
    "telegram": {"fetch": {"lookback_hours": 24, "max_items_per_run": 200, "timeout_sec": 20}},
    "web": {"fetch": {"max_items_per_run": 20}, "parse": {"full_content": True}},
    "api": {
        "fetch": {"timeout_sec": 30},
        "parse": {
            "format": "json",
            "field_map": {
                "items_path": "", "id": "id", "url": "url", "title": "title", "content": "content", "summary": "summary", "author": "author", "published_at": "published_at", "tags": "tags",
                "linked_urls": "linked_urls", "next_cursor": "",
            },
        },
    },
    "email": {
        "fetch": {"protocol": "imap", "mailbox": "INBOX", "search": "ALL", "username": "", "password": "", "host": "", "port": 993, "use_ssl": True},
        "parse": {"summary_from_email": True},
    },
}
#: Settings that have to be objects.
_OBJECTS = ("fetch", "filters", "parse", "vision", "dedupe")


def merged(base: object, over: object) -> object:
    """Objects are merged key by key at any depth; anything else of ``over`` replaces what is there."""
    if isinstance(base, dict) and isinstance(over, dict):
        return base | {k: merged(base[k], v) if k in base else v for k, v in over.items()}
    return over


def _number(value: object, otherwise: float, kind: type) -> float:
    try:
        return kind(value or otherwise)
    except (TypeError, ValueError):
        return otherwise


def kind_of(value: str | None) -> str:
    """A kind's name; an old one stands for feeds."""
    low = (value or "").strip().lower()
    return "rss" if low == "habr" else low


def settings(kind: str | None, given: str | None) -> str:
    """All settings of a source as JSON, keys in order: defaults, those of its kind, then what is given, put into bounds."""
    try:
        over = json.loads(given) if given else {}
    except ValueError:
        over = {}
    out = merged(merged(DEFAULTS, KIND_DEFAULTS.get(kind_of(kind), {})), over if isinstance(over, dict) else {})
    out["preset"] = str(out.get("preset") or "custom")
    for key in _OBJECTS:
        if not isinstance(out[key], dict):
            out[key] = DEFAULTS[key]
    if not isinstance(out["expected_signal_types"], list):
        out["expected_signal_types"] = []
    out["source_authority"] = max(0.0, min(1.0, _number(out["source_authority"], 0.5, float)))
    out["quality_tier"] = str(out["quality_tier"] or "standard")
    for key in ("source_region", "market_scope"):
        out[key] = str(out[key] or "global").strip().lower()
    mode = str(out["vision"].get("mode") or "full").strip().lower()
    most = _number(out["vision"].get("max_media_bytes"), 9_000_000, int)
    out["vision"] = out["vision"] | {"mode": mode if mode in ("full", "ocr_only", "skip") else "full", "max_media_bytes": max(0, most)}
    return json.dumps(out, ensure_ascii=False, sort_keys=True)


def settings_column(kind: Column, given: Column) -> Column:
    @F.pandas_udf("string")
    def run(k: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([settings(x, y) for x, y in zip(k, g, strict=True)], dtype=object)

    return run(kind, given)


def merged_column(base: Column, over: Column) -> Column:
    """Two JSON objects merged at any depth, keys in order; null counts as an empty one."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(merged(json.loads(x or "{}"), json.loads(y or "{}")), ensure_ascii=False, sort_keys=True) for x, y in zip(a, b, strict=True)], dtype=object)

    return run(base, over)


def checked(payloads: DataFrame, presets: dict[str, str] | None = None) -> DataFrame:
    """``payloads(kind, url, channel, extra, ...)`` with ``kind`` and ``url`` filled in, ``settings`` as a variant, and ``reasons``: what is wrong, an
    empty array if nothing is. ``presets`` are URLs of feeds by name, for those that have none."""
    kind = F.lower(F.trim(F.coalesce("kind", F.lit(""))))
    rows = payloads.withColumn("kind", F.when(kind == "habr", "rss").otherwise(kind)).withColumn("settings", settings_column(F.col("kind"), F.col("extra")))
    text = {k: F.get_json_object("settings", f"$.{k}") for k in ("preset", "fetch.host", "fetch.username")}
    known = F.create_map(*[F.lit(x) for pair in (presets or {}).items() for x in pair]) if presets else F.create_map().cast("map<string,string>")
    given = F.nullif(F.col("url"), F.lit(""))
    rows = rows.withColumn("url", F.when((F.col("kind") == "rss") & given.isNull(), F.try_element_at(known, text["preset"])).otherwise(given))
    empty = {k: F.coalesce(text[k], F.lit("")) == "" for k in ("fetch.host", "fetch.username")}
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("kind").isin(*KINDS), F.concat(F.lit("unknown kind "), "kind")),
            F.when((F.col("kind") == "telegram") & (F.coalesce("channel", F.lit("")) == ""), F.lit("a channel is missing")),
            F.when(F.col("kind").isin("rss", "web", "api") & F.col("url").isNull(), F.lit("a url is missing")),
            F.when((F.col("kind") == "email") & (empty["fetch.host"] | empty["fetch.username"]), F.lit("host or user name is missing")),
        )
    )
    return rows.withColumn("reasons", reasons).withColumn("settings", F.parse_json("settings"))
