"""Coercion of flat string messages to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def present(value: Column) -> Column:
    """Null for empty strings and for the words null and none."""
    text = F.trim(value)
    return F.when((text != "") & ~F.lower(text).isin("null", "none"), text)


def flag(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("true", "1", "yes", "on"), F.lit(False))


def strings(value: Column) -> Column:
    """A JSON array of strings; a lone string is a list of one; else empty."""
    text = present(value)
    parsed = F.from_json(text, "array<string>")
    return F.when(text.isNull(), F.array().cast("array<string>")).when(text.startswith("["), F.coalesce(parsed, F.array().cast("array<string>"))).otherwise(F.array(text))


def json_object(value: Column) -> Column:
    """JSON text of an object; anything else is an empty one."""
    text = present(value)
    return F.when(text.startswith("{") & F.try_parse_json(text).isNotNull(), text).otherwise(F.lit("{}"))


def timestamp(value: Column) -> Column:
    return F.try_to_timestamp(present(value))


def post_event(message: Column) -> dict[str, Column]:
    """Typed fields of a message map; required ones may come out null and are then rejected by ``problem``."""
    get = message.getItem
    return {
        "event_id": present(get("event_id")),
        "post_id": present(get("post_id")),
        "workspace_id": present(get("workspace_id")),
        "source_id": present(get("source_id")),
        "external_id": present(get("external_id")),
        "content": F.coalesce(get("content"), F.lit("")),
        "grouped_id": present(get("grouped_id")),
        "has_media": flag(get("has_media")),
        "media_urls": strings(get("media_urls")),
        "linked_urls": strings(get("linked_urls")),
        "published_at": timestamp(get("published_at")),
        "extra": json_object(get("extra")),
    }


def problem(fields: dict[str, Column]) -> Column:
    """Why a message can't be used; null if it can. The first reason counts."""
    out = F
    for name in ("event_id", "workspace_id", "source_id", "external_id"):
        out = out.when(fields[name].isNull(), F.lit(f"missing {name}"))
    return out.when((F.trim(fields["content"]) == "") & ~fields["has_media"], F.lit("empty post"))
