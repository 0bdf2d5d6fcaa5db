"""Connectors over landed files: feeds, API responses, mail, listings and chats become normalised items."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidemark.functions import html as H, text as tx

ITEM = ("external_id", "url", "title", "content", "lang", "published_at")


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def normalise(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Items from any table: ``fields`` names guid, url, title, content, published and lang as columns of it."""
    rows = df.select(*[c.alias(f"_{n}") for n, c in fields.items()])
    return rows.select(
        tx.external_id(F.col("_guid"), F.col("_url"), F.col("_title"), F.col("_published")).alias("external_id"),
        tx.canonical_url(F.col("_url")).alias("url"),
        F.coalesce(first_of(F.col("_title")), F.left(F.col("_content"), F.lit(120))).alias("title"),
        F.coalesce(F.col("_content"), F.lit("")).alias("content"),
        F.coalesce(first_of(F.col("_lang")), tx.detected_language(F.coalesce("_content", F.lit("")))).alias("lang"),
        tx.parsed_time(F.col("_published")).cast("timestamp_ntz").alias("published_at"),
    )


def select_items(items: DataFrame, include: list[str] = (), exclude: list[str] = (), languages: list[str] = (), seen: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Filter, take each external id once (the oldest), leave out ids seen before, oldest first; no date sorts first."""
    text = F.concat_ws(" ", "title", "content")
    kept = items.filter(tx.passes_keywords(text, list(include), list(exclude)) & tx.passes_language(F.col("lang"), list(languages)))
    if seen is not None:
        kept = kept.join(seen.select("external_id"), "external_id", "left_anti")
    rest = [c for c in items.columns if c not in ("external_id", "published_at")]
    order = ["title", *[c for c in rest if c != "title"]]
    once = kept.groupBy("external_id").agg(F.min(F.struct("published_at", *order)).alias("_m")).select("external_id", "_m.*").select(items.columns)
    out = once.orderBy(F.asc_nulls_first("published_at"), "external_id")
    return out.limit(limit) if limit else out


def rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed RSS files."""
    schema = "guid string, link string, title string, description string, pubDate string"
    raw = spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", True).schema(schema).load(path)
    content = H.fragment_column(F.coalesce("description", F.lit("")))
    return normalise(raw, {"guid": F.col("guid"), "url": F.col("link"), "title": F.col("title"), "content": content, "published": F.col("pubDate"), "lang": F.lit(None).cast("string")})


def atom(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed Atom files."""
    schema = "id string, link struct<_href: string>, title string, summary string, content string, updated string, published string"
    raw = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", True).schema(schema).load(path)
    content = H.fragment_column(first_of(F.col("content"), F.col("summary"), F.lit("")))
    return normalise(
        raw, {"guid": F.col("id"), "url": F.col("link._href"), "title": F.col("title"), "content": content, "published": first_of(F.col("published"), F.col("updated")), "lang": F.lit(None).cast("string")}
    )


def api_json(spark: SparkSession, path: str, items: str, field_map: dict[str, str]) -> DataFrame:
    """Items of landed JSON responses: ``items`` is the path of the array, ``field_map`` the path of each field."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", f"$.{items}" if items else "$"), "array<string>")).alias("item"))
    found = {n: F.get_json_object("item", f"$.{field_map[n]}") if n in field_map else F.lit(None).cast("string") for n in ("guid", "url", "title", "content", "published", "lang")}
    return normalise(raw, found)


def api_csv(spark: SparkSession, path: str, field_map: dict[str, str]) -> DataFrame:
    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    return normalise(raw, {n: F.col(field_map[n]) if n in field_map else F.lit(None).cast("string") for n in ("guid", "url", "title", "content", "published", "lang")})


def expand_ids(ids: DataFrame, template: str, details: DataFrame) -> DataFrame:
    """Detail rows of a list of ids: their URL from a template, joined to what was fetched."""
    return ids.withColumn("url", F.replace(F.lit(template), F.lit("{id}"), F.col("id").cast("string"))).join(details, "url")


def _messages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for raw in frame["content"]:
            m = email.message_from_bytes(raw, policy=email.policy.default)
            part = m.get_body(("plain",))
            html = None if part else m.get_body(("html",))
            body = part.get_content() if part else H.fragment_text(html.get_content()) if html else ""
            date = m["date"].datetime.isoformat() if m["date"] and m["date"].datetime else None
            rows.append((str(m["message-id"] or "") or None, str(m["subject"] or ""), body.strip(), date))
        yield pd.DataFrame(rows, columns=["guid", "title", "content", "published"])


def mailbox(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed mail files (one message each), their plain text first."""
    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_messages, "guid string, title string, content string, published string")
    none = F.lit(None).cast("string")
    return normalise(raw, {"guid": F.col("guid"), "url": none, "title": F.col("title"), "content": F.col("content"), "published": F.col("published"), "lang": none})


def web_listing(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(page, link, title)``: links of listing pages, relative ones completed, each once for a page."""
    base = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    links = pages.select(F.col(url).alias("page"), base.alias("base"), F.explode(H.links_column(F.col(html))).alias("href"))
    full = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat("base", "href"))
    return links.select("page", tx.canonical_url(full).alias("link")).filter("link is not null").distinct()


def albums(messages: DataFrame, span: int = 48, most: int = 10) -> DataFrame:
    """``(group, frame, first_id, last_id, items)`` of ``messages(id, group, text)``: a group's messages in order of their ids, cut into frames.

    A frame has at most ``most`` messages and spans at most ``span`` ids; a message that fits no more begins the next
    frame, so none is lost. A frame begins where the one before it ends, so a group is folded in order: sorted rows pass a
    task as a stream of Arrow batches, many groups in one, of which only the open frame is held."""
    rows = messages.filter("`group` is not null and id is not null").select("group", "id")
    fields = {"group": rows.schema["group"].dataType, "frame": IntegerType(), "first_id": rows.schema["id"].dataType, "last_id": rows.schema["id"].dataType, "items": LongType()}
    kind = StructType([StructField(name, of) for name, of in fields.items()])
    schema = to_arrow_schema(kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = first = last = None
        frame = n = 0
        for batch in batches:
            out = []
            for g, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n and g == group and n < most and x - first <= span:
                    last, n = x, n + 1
                    continue
                if n:
                    out.append((group, frame, first, last, n))
                frame = frame + 1 if n and g == group else 0
                group, first, last, n = g, x, x, 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((group, frame, first, last, n), schema, strict=True)], schema=schema)

    near = rows.repartition("group").sortWithinPartitions("group", "id")
    return near.mapInArrow(cut, kind)
