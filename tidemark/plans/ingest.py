"""Landed responses read page by page, listings by selectors, and source payloads."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import views as V
from tidemark.functions import payloads as P, selectors
from tidemark.sources import landed
from tidemark.storage import shared_dir
from tidemark.streaming import jobs as J

#: Pages of the table in a landed response.
PAGE = 20


def _landed(spark, d) -> str:
    """The table of pages as landed responses, in the shared folder; each third response has the mark of the one before it."""
    path = f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/landed-{uuid.uuid4().hex}"
    page = F.floor(F.col("page_id") / PAGE).cast("bigint")
    mark = F.concat(F.lit("v"), F.when(page % 3 == 1, page - 1).otherwise(page).cast("string"))
    rows = V.table(spark, d, "pages").select(page.alias("page"), F.to_json(F.struct("page_id", "url")).alias("item"), mark.alias("etag"))
    landed.land(rows, path, "page", "item", "etag")
    landed.register(spark)
    return path


def landed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Items of landed responses; a response that its mark calls unchanged has none."""
    rows = spark.read.format("landed").option("path", _landed(spark, d)).load()
    return rows.select("page", "etag", F.get_json_object("item", "$.page_id").cast("bigint").alias("page_id"), F.get_json_object("item", "$.url").alias("url"))


def landed_stream(spark, d):
    """The same as a stream with the number of the last page as its offset, by page."""
    rows = spark.readStream.format("landed").option("path", _landed(spark, d)).load()
    out = J.drain(rows.select("page", F.get_json_object("item", "$.url").alias("url")), "landed")
    return out.groupBy("page").agg(F.count("*").alias("items"), F.min("url").alias("first"))


def capped_log(spark, d):
    """A log of events that keeps the newest fifty, after the second half was added to the first."""
    e = V.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    half = F.col("event_id") % 2 == 0
    return landed.keep_newest(e.filter(half), e.filter(~half), ["ts", "event_id"], 50)


def listing_items(spark, d):
    """Links of the pages' menus as items of a listing."""
    items = selectors.listed_column(F.col("html"), listing="nav > ul li", link="a[href^='/']", title="a", most=50)
    rows = V.table(spark, d, "pages").select("page_id", F.posexplode(items).alias("place", "item"))
    return rows.select("page_id", "place", "item.href", "item.title")


_EXTRA = {
    "0": "{}", "1": '{"fetch": {"timeout_sec": 7, "proxy": {"host": "p", "port": 1}}, "source_authority": 1.7}', "2": '{"parse": {"field_map": {"id": "guid", "own": "x"}}, "source_region": " EU "}',
    "3": '{"fetch": {"host": "h", "username": "u"}, "source_authority": "0.25"}', "4": '{"vision": {"mode": "ALL"}, "preset": "daily", "filters": {"include_keywords": ["a", "b"]}}',
}
_URL = "http://feed.example.org/daily"


def source_payloads(spark, d):
    """Payloads of sources, one for each customer: kinds and settings by its key; what they become and what is wrong with them."""
    k = F.col("c_custkey")
    kinds = F.array(*[F.lit(x) for x in ("Telegram", "rss", "web", "api", "email", " habr", "fax")])
    rows = V.table(spark, d, "customer").select(
        k.alias("id"), F.get(kinds, (k % 7).cast("int")).alias("kind"), F.when(k % 2 == 0, F.concat(F.lit("http://x.org/"), k.cast("string"))).alias("url"), F.when(k % 4 < 2, F.lit("chan")).alias("channel"),
        F.get(F.array(*[F.lit(x) for x in _EXTRA.values()]), (k % 5).cast("int")).alias("extra"),
    )
    out = P.checked(rows, {"daily": _URL})

    def setting(path: str, kind: str):
        return F.variant_get("settings", f"$.{path}", kind)

    return out.select(
        "id", "kind", "url", F.array_join("reasons", "; ").alias("reasons"), setting("fetch.timeout_sec", "int").alias("timeout"), setting("fetch.max_items_per_run", "int").alias("most"),
        setting("fetch.proxy.host", "string").alias("proxy"), setting("parse.field_map.id", "string").alias("id_field"), setting("parse.field_map.own", "string").alias("own_field"),
        setting("parse.full_content", "boolean").alias("full_content"), setting("source_authority", "double").alias("authority"), setting("source_region", "string").alias("region"), setting("vision.mode", "string").alias("mode"),
    )


QUERIES = {f.__name__: f for f in (landed_pages, landed_stream, capped_log, listing_items, source_payloads)}


def _sql_json(value: dict) -> str:
    return "'" + json.dumps(value) + "'::json"


_LANDED = f"l as (select page_id // {PAGE} as page, page_id, url from pages)"
ORACLES = {
    "landed_pages": f"with {_LANDED} select page, 'v' || page as etag, page_id, url from l where page % 3 <> 1",
    "landed_stream": f"with {_LANDED} select page, count(*) as items, min(url) as first from l where page % 3 <> 1 group by page",
    "capped_log": "select event_id, ts from events order by ts desc, event_id desc limit 50",
    "listing_items": """with n as (select page_id, regexp_extract_all(regexp_extract(html, '<nav><ul>(.*?)</ul></nav>', 1), '<li><a href="(/[^"]*)">[^<]*</a></li>', 1) as h,
            regexp_extract_all(regexp_extract(html, '<nav><ul>(.*?)</ul></nav>', 1), '<li><a href="/[^"]*">([^<]*)</a></li>', 1) as t from pages),
        r as (select page_id, unnest(range(0, len(h))) as i, h, t from n)
        select page_id, cast(i as int) as place, trim(h[i + 1]) as href, case when trim(t[i + 1]) = '' then trim(h[i + 1]) else trim(t[i + 1]) end as title from r where i < 50""",
    "source_payloads": f"""with p as (select c_custkey as id, (['telegram', 'rss', 'web', 'api', 'email', 'rss', 'fax'])[c_custkey % 7 + 1] as kind, case when c_custkey % 2 = 0 then 'http://x.org/' || c_custkey end as u, c_custkey % 4 < 2 as channel,
            ([{", ".join("'" + x + "'" for x in _EXTRA.values())}])[c_custkey % 5 + 1]::json as extra from customer),
        m as (select *, json_merge_patch({_sql_json(P.DEFAULTS)}, case kind {" ".join(f"when '{k}' then {_sql_json(v)}" for k, v in P.KIND_DEFAULTS.items())} else '{{}}'::json end, extra) as s from p),
        f as (select *, case when kind = 'rss' and s->>'$.preset' = 'daily' then coalesce(u, '{_URL}') else u end as url from m)
        select id, kind, url, concat_ws('; ', case when kind = 'fax' then 'unknown kind fax' end, case when kind = 'telegram' and not channel then 'a channel is missing' end,
                case when kind in ('rss', 'web', 'api') and url is null then 'a url is missing' end, case when kind = 'email' and coalesce(s->>'$.fetch.host', '') = '' then 'host or user name is missing' end) as reasons,
            cast(s->>'$.fetch.timeout_sec' as int) as timeout, cast(s->>'$.fetch.max_items_per_run' as int) as most, s->>'$.fetch.proxy.host' as proxy, s->>'$.parse.field_map.id' as id_field, s->>'$.parse.field_map.own' as own_field,
            cast(s->>'$.parse.full_content' as boolean) as full_content, greatest(0, least(1, cast(s->>'$.source_authority' as double))) as authority, lower(trim(s->>'$.source_region')) as region,
            case when lower(s->>'$.vision.mode') in ('full', 'ocr_only', 'skip') then lower(s->>'$.vision.mode') else 'full' end as mode from f""",
}
