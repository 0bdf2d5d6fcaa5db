"""Media of posts: what they are, whether a model looks at them, and the messages about them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.events import present

#: Endings of videos' keys, with their types, and the modes of sources.
VIDEO_ENDINGS = (".mp4", ".mov", ".webm", ".mkv", ".avi")
VIDEOS = {".mp4": "video/mp4", ".mov": "video/quicktime", ".webm": "video/webm"}
MODES = ("full", "ocr_only", "skip")
MOST_BYTES = 9_000_000


def mime(key: Column, data: Column) -> Column:
    """By the first bytes, else by the key's ending, else a JPEG."""
    head = F.hex(F.substring(data, 1, 16))
    low = F.lower(F.coalesce(key, F.lit("")))
    out = (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("474946"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(head.startswith("000000") & head.contains("66747970"), "video/mp4")
    )
    for ending, kind in VIDEOS.items():
        out = out.when(low.endswith(ending), kind)
    return out.otherwise("image/jpeg")


def skip_reason(mode: Column, key: Column, kind: Column, size: Column, most: Column) -> Column:
    """Why a model doesn't look at a picture; null if it does. The first reason counts."""
    video = kind.startswith("video/")
    for ending in VIDEO_ENDINGS:
        video = video | F.lower(F.coalesce(key, F.lit(""))).endswith(ending)
    return (
        F.when(mode == "ocr_only", "source_vision_mode_ocr_only").when(video, "video_media_not_sent_to_gigachat").when((most > 0) & (size > most), F.concat(F.lit("media_too_large>"), most.cast("string")))
    )


def runs_ocr(mode: Column, kind: Column) -> Column:
    return (mode != "skip") & kind.startswith("image/")


def policy(mode: Column, most: Column) -> tuple[Column, Column]:
    """A source's mode and greatest size, from what its settings say."""
    low = F.lower(F.trim(mode))
    return F.when(low.isin(*MODES), low).otherwise("full"), F.greatest(F.lit(0), F.coalesce(F.nullif(most.try_cast("int"), F.lit(0)), F.lit(MOST_BYTES)))


def whole(value: Column, default: int) -> Column:
    return F.coalesce(F.when(F.trim(value).rlike(r"^[+-]?\d+$"), F.trim(value).try_cast("int")), F.lit(default))


def vision_event(message: Column) -> dict[str, Column]:
    """Typed fields of a message map about a post's media."""
    get = message.getItem
    keys = F.coalesce(F.from_json(F.trim(get("media_s3_keys")), "array<string>"), F.array().cast("array<string>"))
    return {
        "post_id": present(get("post_id")),
        "workspace_id": present(get("workspace_id")),
        "media_s3_keys": keys,
        "grouped_id": F.coalesce(present(get("grouped_id")), F.lit("")),
        "album_item_index": whole(get("album_item_index"), 0),
        "album_total_items": whole(get("album_total_items"), 1),
        "vision_mode": F.coalesce(F.nullif(F.lower(F.trim(get("vision_mode"))), F.lit("")), F.lit("full")),
        "max_media_bytes": whole(get("max_media_bytes"), MOST_BYTES),
    }


def summary(labels: Column, ocr: Column, scene: Column, most: int = 8) -> Column:
    """What was seen, in one line; empty if nothing was."""
    named = F.array_join(F.slice(F.filter(F.transform(labels, lambda x: F.trim(x)), lambda x: x != ""), 1, most), ", ")
    text = F.trim(F.regexp_replace(F.coalesce(ocr, F.lit("")), r"\s+", " "))
    parts = F.array(F.nullif(F.trim(F.coalesce(scene, F.lit(""))), F.lit("")), F.nullif(named, F.lit("")), F.nullif(text, F.lit("")))
    return F.array_join(F.array_compact(parts), "; ")
