"""Requests with arguments: lists, lookups, states and what a run leaves behind."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark import views as V
from tidemark.functions import events, model_output, requests as R, scores as S, vectors, vision
from tidemark.operators import ranking, upsert as U
from tidemark.plans.signals import ORACLES as SIGNALS, external_strength, gap_scores
from tidemark.views import as_of, hours_before


def workspaces(spark: SparkSession, d: str) -> DataFrame:
    """Market segments as workspaces: id, description, is_active, updated_at."""
    c = V.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("id")).agg(F.max("c_custkey").alias("newest"), F.count("*").alias("members"))
    return c.select("id", "members", (F.length("id") % 2 == 0).alias("is_active"), (F.lit(V.START).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("newest") % 600).cast("int"), F.lit(0))).alias("updated_at"))


_WORKSPACES = """workspaces as (select id, members, length(id) % 2 = 0 as is_active, timestamp '2024-01-01' + to_minutes(cast(newest % 600 as bigint)) as updated_at
    from (select c_mktsegment as id, max(c_custkey) as newest, count(*) as members from customer group by 1))"""


def list_workspaces(spark, d, active_only: bool = False) -> DataFrame:
    rows = R.matching(workspaces(spark, d), is_active=True if active_only else None)
    return rows.orderBy(F.desc("is_active"), F.desc("updated_at"), "id")


def list_posts(spark, d, workspace: str | None = "de", source: str | None = None, status: str | None = "pending", limit: int = 50) -> DataFrame:
    """The newest posts of a workspace, source and status, each of which may be left out."""
    rows = R.matching(V.posts(spark, d), workspace=workspace, source_id=source, status=status)
    return rows.orderBy(F.desc_nulls_last("published_at"), "post_id").limit(R.within(limit, 1, 200, "limit")).select("post_id", "source_id", "published_at", "relevance")


def list_emerging_signals(spark, d, workspace: str | None = None, asked: list[str] | None = None, limit: int = 20) -> DataFrame:
    """The newest signals of the stages asked for, or emerging ones."""
    rows = R.matching(V.trends(spark, d), workspace=workspace).filter(F.col("stage").isin(R.stages(asked or [" Weak ", "odd", "EMERGING"], ("emerging",))))
    return rows.orderBy(F.desc("detected_at"), F.desc("signal_score"), "cluster_key").limit(R.within(limit, 1, 100, "limit")).select("cluster_key", "workspace", "stage", "signal_score", "detected_at")


def _lookups(spark, d) -> dict[str, DataFrame]:
    trends = V.trends(spark, d)
    return {
        "semantic": V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("value")),
        "trend": trends.filter("stage = 'stable'").select(F.col("cluster_key").alias("id"), F.col("signal_score").alias("value")),
        "emerging": trends.filter("stage in ('emerging', 'weak')").select(F.col("cluster_key").alias("id"), F.col("signal_score").alias("value")),
        "missing": V.table(spark, d, "pages").select((F.col("page_id") * 7).alias("id"), F.col("page_id").cast("double").alias("value")),
    }


def cluster_details(spark, d, kind: str = "auto") -> DataFrame:
    """What each id asked for (here those of all suppliers' parts) is: a semantic cluster, else a trend, an emerging signal
    or a missing one; ids that are none of them are left out. One lookup for all ids, not one for each."""
    asked = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    found = None
    for place, (name, rows) in enumerate(_lookups(spark, d).items()):
        if kind in ("auto", name):
            mine = rows.select("id", F.struct(F.lit(place).alias("place"), F.lit(name).alias("kind"), "value").alias("x"))
            found = mine if found is None else found.unionByName(mine)
    best = found.join(asked, "id", "left_semi").groupBy("id").agg(F.min("x").alias("x"))
    return best.select("id", "x.kind", "x.value")


def missing_signal(spark, d, signal: int = 70) -> DataFrame:
    return R.matching(_lookups(spark, d)["missing"], id=signal)


def alert_rows(spark, d) -> DataFrame:
    """Stable trends of active workspaces of a time window that are worth an alert, without those that were sent one: an alert is
    known by workspace, trend and kind, and counts if it was sent."""
    now, kind = F.lit("1998-08-01").cast("timestamp_ntz"), "trend"
    active = workspaces(spark, d).filter("is_active").select(F.col("id").alias("workspace"))
    sent = V.trends(spark, d).select("workspace", "cluster_key", F.when(F.col("cluster_key") % 3 == 0, "gap").otherwise("trend").alias("kind"), F.when(F.col("cluster_key") % 2 == 0, "sent").otherwise("failed").alias("status"))
    sent = sent.filter((F.col("status") == "sent") & (F.col("kind") == kind))
    t = V.trends(spark, d).filter((F.col("stage") == "stable") & (F.col("detected_at") >= now - F.expr("interval 20000 hours"))).join(F.broadcast(active), "workspace")
    t = t.withColumn("reason", S.alert_reason(F.col("doc_count"), F.col("source_count"), F.col("signal_score"), F.col("recent_change"), F.col("strength"))).filter("reason is not null")
    return t.join(sent, ["workspace", "cluster_key"], "left_anti").select("workspace", "cluster_key", "signal_score", "reason")


def album_posts(spark, d) -> DataFrame:
    """Albums with the posts of the same workspace, source and group; albums without posts have none."""
    p = V.posts(spark, d).withColumn("grouped_id", F.col("post_id") % 50)
    albums = p.filter("workspace is not null and source_id is not null").select("workspace", "source_id", "grouped_id").distinct()
    members = p.filter("status <> 'dropped'").select("workspace", "source_id", "grouped_id", "post_id", "published_at")
    out = albums.join(members, ["workspace", "source_id", "grouped_id"], "left")
    return out.groupBy("workspace", "source_id", "grouped_id").agg(F.count("post_id").alias("posts"), F.max("published_at").alias("last_post_at"))


def post_details(spark, d) -> DataFrame:
    """Each post with its album's size and the kinds of what was found about it."""
    albums = album_posts(spark, d).select("workspace", "source_id", "grouped_id", F.col("posts").alias("album"))
    kinds = V.crawls(spark, d).select("post_id", F.lit("crawl").alias("kind")).unionByName(V.table(spark, d, "labels").select(F.col("doc_id").alias("post_id"), F.lit("valence").alias("kind")))
    found = kinds.groupBy("post_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    p = V.posts(spark, d).withColumn("grouped_id", F.col("post_id") % 50)
    return p.join(albums, ["workspace", "source_id", "grouped_id"], "left").join(found, "post_id", "left").select("post_id", "album", F.coalesce("kinds", F.lit("")).alias("kinds"))


def job_totals(spark, d) -> DataFrame:
    """What a job over all active workspaces made, by workspace and in all."""
    active = workspaces(spark, d).filter("is_active").select(F.col("id").alias("workspace"))
    t = V.trends(spark, d).join(F.broadcast(active), "workspace")
    return t.rollup("workspace").agg(F.count_if(F.col("stage") == "stable").alias("trend_clusters"), F.count_if(F.col("stage").isin("weak", "emerging")).alias("emerging_signals"), F.count("*").alias("clusters"))


def source_distribution(spark, d) -> DataFrame:
    """How many posts of each source a group has, as a map written out."""
    p = V.points(spark, d).select("post_id", F.col("workspace").alias("cluster")).join(V.posts(spark, d).select("post_id", "source_id"), "post_id").filter("source_id is not null")
    counts = p.groupBy("cluster", "source_id").agg(F.count("*").alias("n"))
    g = counts.groupBy("cluster").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_id", "n")))).alias("m"))
    return g.select("cluster", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("distribution"))


def stream_snapshot(spark, d) -> DataFrame:
    """Lag, pending entries and the oldest of them for each stream (here a kind of event): entries up to the middle of the month
    were delivered, and of those every fourth isn't acknowledged."""
    e = V.table(spark, d, "events").select("event_type", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("user_id").alias("consumer"))
    delivered = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    pending = delivered & (F.col("event_id") % 4 == 0)
    age = hours_before(F.min(F.when(pending, F.col("ts")))) * 3600
    return e.groupBy(F.col("event_type").alias("stream")).agg(
        F.count_if(~delivered).alias("lag"), F.count_if(pending).alias("pending"), F.round(F.coalesce(age, F.lit(0.0)), 3).alias("oldest_pending_seconds"),
        F.max(F.when(delivered, F.col("event_id"))).alias("last_delivered"), F.count_distinct(F.when(pending, F.col("consumer"))).alias("consumers"),
    )


def source_checkpoints(spark, d) -> DataFrame:
    """State of sources after their last run of the month, on what the half before left."""
    r = V.source_runs(spark, d)
    half = F.lit("2024-01-16").cast("timestamp_ntz")

    def state(rows: DataFrame) -> DataFrame:
        last = ranking.latest(rows.select("source_id", "started_at", "run_id", "status", "fetched", "error_text"), ["source_id"], ["started_at", "run_id"])
        ok = F.col("status") == "success"
        return last.select(
            "source_id", F.when(ok, F.col("run_id").cast("string")).alias("cursor"), F.when(F.col("fetched") % 2 == 0, F.concat(F.lit("e"), F.col("fetched"))).alias("etag"), F.lit(None).cast("string").alias("last_modified"),
            F.when(ok, F.col("started_at")).alias("last_seen"), F.when(ok, F.col("started_at")).alias("last_success"), F.col("error_text").alias("last_error"),
        )

    return U.checkpoints(state(r.filter(F.col("started_at") < half)), state(r.filter((F.col("started_at") >= half) & (F.col("run_id") % 3 == 0)))).drop("last_modified")


def index_run(spark, d) -> DataFrame:
    """Index states after a run over clicks, errors and views, on states that the other events left."""
    e = V.table(spark, d, "events").groupBy((F.col("event_id") % 5000).alias("post_id")).agg(F.max_by("event_type", "event_id").alias("kind"), F.max("event_id").alias("last"))
    old = e.filter("last % 3 > 0").select("post_id", F.when(F.col("last") % 2 == 0, "error").otherwise("done").alias("embedding_status"), F.lit("pending").alias("graph_status"), (F.col("last") % 4).cast("int").alias("retry_count"), F.lit("").alias("error_message"))
    done = e.filter("kind in ('click', 'view')").select("post_id", (F.col("kind") == "click").alias("graph_done"))
    failed = e.filter("kind = 'error'").select("post_id", F.concat(F.lit("failed "), "last").alias("error"))
    return U.index_outcomes(old, done, failed)


def workspace_patch(spark, d) -> DataFrame:
    """Workspaces after partial updates: some rows say only whether they are active, others only how many members they have."""
    old = workspaces(spark, d).select("id", "members", "is_active")
    n = F.length("id")
    changes = old.select("id", F.when(n % 3 == 0, F.lit(0).cast("bigint")).alias("members"), F.when(n % 3 == 1, ~F.col("is_active")).alias("is_active")).unionByName(spark.sql("select 'nowhere' as id, 1L as members, true as is_active"))
    return U.patch(old, changes, ["id"])


def source_switches(spark, d) -> DataFrame:
    """Sources of which some are switched and some deleted."""
    s = V.sources(spark, d).select("source_id", "kind", F.col("full_content").alias("enabled"))
    return U.toggled(s, ["source_id"], s.filter("kind in ('rss', 'web')"), s.filter("kind = 'email'"), "enabled")


def enabled_sources(spark, d) -> DataFrame:
    """Sources that are on and belong to an active workspace: that of the most posts."""
    of = ranking.most_common(V.posts(spark, d).filter("source_id is not null and workspace is not null"), ["source_id"], "workspace", 1)
    active = of.filter(F.col("workspace").isin("en", "de")).select("source_id", "workspace")
    return V.sources(spark, d).filter("full_content").join(active, "source_id").select("source_id", "kind", "workspace")


def url_queue(spark, d) -> DataFrame:
    """Pages queued for a crawl: those with a post and an http(s) address, as the messages of a stream."""
    p = V.table(spark, d, "pages").select(F.when(F.col("page_id") % 10 > 0, F.concat(F.lit("post-"), "page_id")).alias("post_id"), F.when(F.col("page_id") % 7 == 0, F.regexp_replace("url", "^https?", "ftp")).otherwise(F.col("url")).alias("url"))
    ok = p.filter(F.col("post_id").isNotNull() & F.col("url").rlike("^https?://"))
    return ok.select("post_id", F.to_json(F.array("url")).alias("urls"))


def stale_objects(spark, d, suffix: str = "7", limit: int = 100) -> DataFrame:
    """The first keys of stored objects that end as asked."""
    keys = V.table(spark, d, "pages").select(F.concat_ws("/", F.lit("vision"), F.col("page_id") % 50, "page_id").alias("key"))
    return keys.filter(F.col("key").endswith(suffix)).orderBy("key").limit(limit)


def budget_texts(spark, d) -> DataFrame:
    """Texts cut to a budget of tokens."""
    fitted = R.fit_budget(F.col("text"), 60)
    c = V.table(spark, d, "conversations").select("conv_id", "turn", fitted.alias("t"), "text")
    return c.select("conv_id", "turn", F.md5("t").alias("digest"), (F.length("t") < F.length(R.fit_budget(F.col("text"), 1 << 20))).alias("truncated"))


def alert_digests(spark, d) -> DataFrame:
    """Groups of alerts (events of a user and kind in a day), each sent once: those with a group key by it, others by labels."""
    e = V.table(spark, d, "events").filter("event_type in ('error', 'signup')")
    g = e.groupBy(F.to_date("ts").alias("day"), (F.col("user_id") % 40).alias("service"), "event_type").agg(F.collect_list(F.col("event_id").cast("string")).alias("marks"))
    key = F.when(F.col("service") % 2 == 0, F.concat_ws(":", "event_type", "service"))
    digest = R.delivery_key(F.when(F.col("event_type") == "signup", " Resolved "), key, [F.col("event_type"), F.lit(None).cast("string"), F.col("service").cast("string")], F.col("marks"))
    return g.select(digest.alias("digest")).groupBy("digest").agg(F.count("*").alias("n"))


def merged_weights(spark, d) -> DataFrame:
    """Weights of workspaces with a new threshold where one is given."""
    w = workspaces(spark, d).select("id", F.when(F.length("id") > 8, F.create_map(F.lit("threshold"), F.lit(0.6), F.lit("recency"), F.col("members") / 100)).alias("w"), F.when(F.col("is_active"), F.lit(0.55)).alias("t"))
    out = w.select("id", R.with_threshold(F.col("w"), F.col("t")).alias("w"))
    return out.select("id", F.element_at("w", "threshold").alias("threshold"), F.round(F.element_at("w", "recency"), 6).alias("recency"))


def joint_routing(spark, d) -> DataFrame:
    """Posts that take the joint step, by workspace: two workspaces and two sources are let."""
    joint = R.joint_mode(F.col("workspace"), F.col("source_id"), True, "en, fr", " src1,src2 ")
    return V.posts(spark, d).groupBy("workspace", joint.alias("joint")).agg(F.count("*").alias("n"))


def index_compensation(spark, d) -> DataFrame:
    """Vectors that stay when the second write failed for posts in error."""
    failed = V.posts(spark, d).filter("status = 'error'").select("post_id")
    kept = U.compensated(U.storable(V.points(spark, d), "post_id", "vector"), failed, ["post_id"])
    return kept.groupBy("workspace").agg(F.count("*").alias("vectors"), F.min("post_id").alias("first"))


def urgent_alerts(spark, d, most_a_run: int = 2, most_a_week: int = 4) -> DataFrame:
    """The alerts that a run may still send: the best candidates, as many as the run and the week leave. Trends of even key
    that were found in the last week stand for those that were sent."""
    now = F.lit("1998-08-01").cast("timestamp_ntz")
    sent = V.trends(spark, d).filter((F.col("cluster_key") % 1000 == 0) & (F.col("detected_at") >= now - F.expr("interval 7 days")) & (F.col("detected_at") < now))
    left = sent.agg(F.greatest(F.lit(0), F.least(F.lit(most_a_run), most_a_week - F.count("*"))).alias("left"))
    best = alert_rows(spark, d).orderBy(F.desc("signal_score"), "cluster_key").limit(most_a_run)
    ranked = best.withColumn("n", F.row_number().over(Window.orderBy(F.desc("signal_score"), "cluster_key")))  # a run's limit of rows
    return ranked.crossJoin(F.broadcast(left)).filter(F.col("n") <= F.col("left")).drop("left")  # one row


def missing_signal_run(spark, d, most: int = 10) -> DataFrame:
    """Stored gaps after an analysis: the greatest gaps of the run replace all that was stored of their categories."""
    new = gap_scores(spark, d).filter("gap > 0").orderBy(F.desc("gap"), "topic").limit(most)
    new = new.select((F.col("topic") % 5).alias("category"), "topic", "gap")
    old = external_strength(spark, d).select((F.col("topic") % 5).alias("category"), (F.col("topic") + 100).alias("topic"), F.col("strength").alias("gap"))
    return U.replace_slice(old, new, ["category"])


def event_intake(spark, d) -> DataFrame:
    """Raw messages, typed, and why some can't be used: by kind and problem."""
    e = V.table(spark, d, "events")
    n = F.col("event_id")
    fields = {
        "event_id": F.when(n % 10 > 0, n.cast("string")).otherwise(" None "), "post_id": n.cast("string"), "workspace_id": F.when(n % 7 > 0, F.col("event_type")).otherwise(""), "source_id": F.lit("s"),
        "external_id": F.when(n % 11 > 0, "x"), "content": F.when(n % 3 > 0, F.col("props")).otherwise("  "), "has_media": F.when(n % 2 == 0, "True").otherwise("False"),
        "media_urls": F.when(n % 4 == 0, F.lit('["a", "b"]')).when(n % 4 == 1, F.lit("[broken")).when(n % 4 == 2, F.lit("one")), "published_at": F.col("ts").cast("string"), "extra": F.col("props"),
    }
    message = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields.items()]))
    typed = events.post_event(F.col("m"))
    rows = e.select("event_type", message.alias("m")).select("event_type", events.problem(typed).alias("problem"), F.size(typed["media_urls"]).alias("media"))
    return rows.groupBy("event_type", "problem").agg(F.count("*").alias("n"), F.sum("media").alias("media"))


def vision_decisions(spark, d) -> DataFrame:
    """Pages as stored media, whose type is read from their first bytes or key: whether a model or text recognition takes them."""
    n = F.col("page_id")
    key = F.concat(n.cast("string"), F.element_at(F.array(*map(F.lit, (".jpg", ".MP4", ".webm", ".png"))), (n % 4 + 1).cast("int")))
    head = F.when(n % 5 == 0, F.unhex(F.lit("89504E470D0A1A0A"))).when(n % 5 == 1, F.unhex(F.lit("524946460000000057454250"))).when(n % 5 == 2, F.unhex(F.lit("0000001866747970"))).otherwise(F.encode(F.lit(""), "utf-8"))
    mode, most = vision.policy(F.element_at(F.array(*map(F.lit, ("Full", "ocr_only", "skip", "odd"))), (n % 7 % 4 + 1).cast("int")), F.when(n % 2 == 0, "2500"))
    p = V.table(spark, d, "pages").select(key.alias("key"), F.concat(head, F.encode("html", "utf-8")).alias("data"), mode.alias("mode"), most.alias("most"))
    p = p.withColumn("mime", vision.mime(F.col("key"), F.col("data")))
    reason = vision.skip_reason(F.col("mode"), F.col("key"), F.col("mime"), F.octet_length("data"), F.col("most"))
    return p.select("key", "mime", "mode", reason.alias("reason"), vision.runs_ocr(F.col("mode"), F.col("mime")).alias("ocr"))


#: Signals that speak against a trend.
COUNTER_TYPES = ("failure", "closure", "rejection", "delay", "recall", "lawsuit", "ban")


def _payload(spark, d) -> DataFrame:
    """Embedded posts with what a search filters by."""
    n = F.col("post_id")

    def one(values: tuple[str, ...], step: int):
        return F.element_at(F.array(*map(F.lit, values)), (F.floor(n / step) % len(values) + 1).cast("int"))

    return V.points(spark, d).select("post_id", "vector", "published_at", one(("positive", "neutral", "negative"), 1).alias("valence"), one(model_output.SIGNAL_TYPES, 3).alias("signal_type"), one(("global", "ru", "eu"), 2).alias("source_region"))


def search(spark, d, asked: R.Search, query: DataFrame, now=None, valence: tuple[str, ...] = (), types: tuple[str, ...] = ()) -> DataFrame:
    """The posts nearest to ``query(q)``, one row, that pass the filters of the request: ``(post_id, similarity, rank)``."""
    rows = R.matching(_payload(spark, d), source_region=asked.source_region)
    types = (asked.signal_type,) if asked.signal_type else types
    for column, values in (("valence", valence), ("signal_type", types)):
        rows = rows.filter(F.col(column).isin(*values)) if values else rows
    if asked.days_back:
        rows = rows.filter(F.col("published_at") >= (as_of() if now is None else now) - F.make_dt_interval(F.lit(asked.days_back)))
    scored = rows.crossJoin(F.broadcast(query)).withColumn("similarity", F.round(vectors.cosine(F.col("vector"), F.col("q")), 6))  # one row
    best = scored.orderBy(F.desc("similarity"), "post_id").limit(asked.limit).select("post_id", "similarity")
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "post_id")))  # a request's limit of rows


def _balanced(spark, d, asked: R.Search, kinds: tuple[str, ...]) -> DataFrame:
    """Three lanes: what speaks for a trend, what speaks against it, and what one region says; the last two look at thirty
    days at least."""
    query = V.points(spark, d).filter("post_id = 7").select(F.col("vector").alias("q"))
    wide = max(asked.days_back or 7, 30)
    lanes = {
        "main": search(spark, d, asked, query, valence=("positive", "neutral"), types=kinds),
        "counter": search(spark, d, replace(asked, days_back=wide), query, valence=("negative",), types=COUNTER_TYPES),
        "region": search(spark, d, replace(asked, days_back=wide, source_region="ru"), query),
    }
    named = [rows.select(F.lit(name).alias("lane"), "rank", "post_id", "similarity") for name, rows in lanes.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


_ASKED = R.Search("growth of funding", limit=5, days_back=20)


def search_request(spark, d, valence: tuple[str, ...] = ("negative", "neutral")) -> DataFrame:
    """One search of a region, kind and time."""
    query = V.points(spark, d).filter("post_id = 7").select(F.col("vector").alias("q"))
    return search(spark, d, R.Search("any", limit=15, days_back=25, source_region=" EU "), query, valence=valence)


def search_balanced(spark, d) -> DataFrame:
    return _balanced(spark, d, _ASKED, ("growth", "investment"))


def search_blind_spots(spark, d, confidence: float = 0.4, players: tuple[str, ...] = ("acme", "the")) -> DataFrame:
    """What a balanced search lacks: which lanes are empty, and whether any player asked for is named in what was found."""
    lanes = _balanced(spark, d, R.Search("x", limit=5, days_back=1), ("growth", "investment"))
    found = lanes.join(V.posts(spark, d).select("post_id", F.lower("content").alias("low")), "post_id", "left")
    named = F.max(F.when(F.col("low").rlike("|".join(players)), 1).otherwise(0))
    g = found.agg(F.count_if(F.col("lane") == "region").alias("region"), F.count_if(F.col("lane") == "counter").alias("counter"), F.coalesce(named, F.lit(0)).alias("named"))
    gaps = F.array_compact(
        F.array(
            F.when(F.lit(confidence) < 0.45, "low_intent_confidence"), F.when(F.col("region") == 0, "no_ru_verification_evidence"), F.when(F.col("counter") == 0, "no_counter_signals_found"),
            F.when(F.lit(len(players) > 0) & (F.col("named") == 0), "no_competitor_evidence"),
        )
    )
    return g.select("region", "counter", F.array_join(gaps, ",").alias("gaps"))


QUERIES = {
    f.__name__: f
    for f in (
        list_workspaces, list_posts, list_emerging_signals, cluster_details, missing_signal, alert_rows, album_posts, post_details, job_totals, source_distribution, stream_snapshot, source_checkpoints,
        index_run, workspace_patch, source_switches, enabled_sources, url_queue, stale_objects, budget_texts, alert_digests, merged_weights, joint_routing, index_compensation,
        urgent_alerts, missing_signal_run, event_intake, vision_decisions, search_request, search_balanced, search_blind_spots,
    )
}
_REASON = """doc_count >= 5 and source_count >= 3 and (signal_score >= 0.8 or (recent_change and signal_score >= 0.74 and strength >= 0.7))"""
_ALBUMS = f"""{V.POSTS}, p as (select *, post_id % 50 as grouped_id from posts), al as (select distinct workspace, source_id, grouped_id from p where workspace is not null and source_id is not null),
    albums as (select al.workspace, al.source_id, al.grouped_id, count(m.post_id) as posts, max(m.published_at) as last_post_at from al
        left join (select * from p where status <> 'dropped') m on m.workspace = al.workspace and m.source_id = al.source_id and m.grouped_id = al.grouped_id group by all)"""
_CLEAN = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"
_RUN_STATE = """select source_id, case when status = 'success' then cast(run_id as varchar) end as cursor, case when fetched % 2 = 0 then 'e' || fetched end as etag,
    case when status = 'success' then started_at end as last_seen, error_text as last_error from (select *, row_number() over (partition by source_id order by started_at desc, run_id desc) as r from source_runs where {}) where r = 1"""
_PAYLOAD = f"""{V.POINTS}, q as (select vector as q from points where post_id = 7), pay as (select post_id, published_at, (['positive', 'neutral', 'negative'])[post_id % 3 + 1] as valence,
    ([{", ".join(f"'{x}'" for x in model_output.SIGNAL_TYPES)}])[post_id // 3 % 14 + 1] as signal_type, (['global', 'ru', 'eu'])[post_id // 2 % 3 + 1] as source_region,
    round(list_cosine_similarity(vector, q), 6) as similarity from points, q)"""
_LANES = f"""lanes as (select *, cast(row_number() over (partition by lane order by similarity desc, post_id) as int) as rank from (
    select 'main' as lane, post_id, similarity from pay where valence in ('positive', 'neutral') and signal_type in ('growth', 'investment') and published_at >= timestamp '2024-01-31 12:30:00' - interval {{main}} day
    union all select 'counter', post_id, similarity from pay where valence = 'negative' and signal_type in ({", ".join(f"'{x}'" for x in COUNTER_TYPES)}) and published_at >= timestamp '2024-01-31 12:30:00' - interval 30 day
    union all select 'region', post_id, similarity from pay where source_region = 'ru' and published_at >= timestamp '2024-01-31 12:30:00' - interval 30 day))"""
ORACLES = {
    "list_workspaces": f"with {_WORKSPACES} select * from workspaces",
    "list_posts": f"with {V.POSTS} select post_id, source_id, published_at, relevance from posts where workspace = 'de' and status = 'pending' order by published_at desc nulls last, post_id limit 50",
    "list_emerging_signals": f"""with {V.TRENDS} select cluster_key, workspace, stage, signal_score, detected_at from trends where stage in ('weak', 'emerging') order by detected_at desc, signal_score desc, cluster_key limit 20""",
    "cluster_details": f"""with {V.TRENDS}, a as (select p_partkey as id from part)
        select a.id, case when e.vec_id is not null then 'semantic' when s.cluster_key is not null then 'trend' when w.cluster_key is not null then 'emerging' else 'missing' end as kind,
            case when e.vec_id is not null then cast(e.label as double) when s.cluster_key is not null then s.signal_score when w.cluster_key is not null then w.signal_score else cast(g.page_id as double) end as value
        from a left join embeddings e on e.vec_id = a.id left join (select * from trends where stage = 'stable') s on s.cluster_key = a.id
            left join (select * from trends where stage in ('emerging', 'weak')) w on w.cluster_key = a.id left join pages g on g.page_id * 7 = a.id
        where coalesce(e.vec_id, s.cluster_key, w.cluster_key, g.page_id) is not null""",
    "missing_signal": "select page_id * 7 as id, cast(page_id as double) as value from pages where page_id = 10",
    "alert_rows": f"""with {_WORKSPACES}, {V.TRENDS} select workspace, cluster_key, signal_score, case when signal_score >= 0.8 then 'high_score' else 'change_point' end as reason from trends
        where workspace in (select id from workspaces where is_active) and stage = 'stable' and detected_at >= timestamp '1998-08-01' - interval 20000 hour and {_REASON}
            and not (cluster_key % 3 <> 0 and cluster_key % 2 = 0)""",
    "urgent_alerts": f"""with {_WORKSPACES}, {V.TRENDS}, c as (select workspace, cluster_key, signal_score, case when signal_score >= 0.8 then 'high_score' else 'change_point' end as reason,
            cast(row_number() over (order by signal_score desc, cluster_key) as int) as n from trends
            where workspace in (select id from workspaces where is_active) and stage = 'stable' and detected_at >= timestamp '1998-08-01' - interval 20000 hour and {_REASON} and not (cluster_key % 3 <> 0 and cluster_key % 2 = 0)),
        s as (select count(*) as sent from trends where cluster_key % 1000 = 0 and detected_at >= timestamp '1998-07-25' and detected_at < timestamp '1998-08-01')
        select workspace, cluster_key, signal_score, reason, n from c, s where n <= greatest(0, least(2, 4 - sent))""",
    "missing_signal_run": f"""with g as ({SIGNALS["gap_scores"]}), e as ({SIGNALS["external_strength"]}), new as (select topic % 5 as category, topic, gap from g where gap > 0 order by gap desc, topic limit 10)
        select topic % 5 as category, topic + 100 as topic, strength as gap from e where topic % 5 not in (select category from new) union all select * from new""",
    "event_intake": """with m as (select event_type, case when event_id % 10 = 0 then 'missing event_id' when event_id % 7 = 0 then 'missing workspace_id' when event_id % 11 = 0 then 'missing external_id'
            when event_id % 3 = 0 and event_id % 2 = 1 then 'empty post' end as problem, case event_id % 4 when 0 then 2 when 2 then 1 else 0 end as media from events)
        select event_type, problem, count(*) as n, cast(sum(media) as bigint) as media from m group by all""",
    "album_posts": f"with {_ALBUMS} select * from albums",
    "post_details": f"""with {_ALBUMS}, k as (select page_id as post_id, 'crawl' as kind from pages union select doc_id, 'valence' from labels), f as (select post_id, string_agg(kind, ',' order by kind) as kinds from k group by 1)
        select p.post_id, a.posts as album, coalesce(kinds, '') as kinds from p left join albums a on a.workspace = p.workspace and a.source_id = p.source_id and a.grouped_id = p.grouped_id left join f on f.post_id = p.post_id""",
    "job_totals": f"""with {_WORKSPACES}, {V.TRENDS} select workspace, count(*) filter (where stage = 'stable') as trend_clusters, count(*) filter (where stage in ('weak', 'emerging')) as emerging_signals, count(*) as clusters
        from trends where workspace in (select id from workspaces where is_active) group by rollup (workspace)""",
    "source_distribution": f"""with {V.POSTS}, c as (select label as cluster, source_id, count(*) as n from embeddings join posts on vec_id = post_id where source_id is not null group by all)
        select cluster, string_agg(source_id || ':' || n, ',' order by source_id) as distribution from c group by cluster""",
    "stream_snapshot": """with e as (select event_type as stream, event_id, ts, user_id, ts < timestamp '2024-01-16' as delivered, ts < timestamp '2024-01-16' and event_id % 4 = 0 as pending from events)
        select stream, count(*) filter (where not delivered) as lag, count(*) filter (where pending) as pending,
            round(coalesce((epoch_us(timestamp '2024-01-31 12:30:00') - epoch_us(min(ts) filter (where pending))) / 1000000.0, 0), 3) as oldest_pending_seconds,
            max(event_id) filter (where delivered) as last_delivered, count(distinct user_id) filter (where pending) as consumers from e group by 1""",
    "source_checkpoints": f"""with {V.SOURCE_RUNS}, o as ({_RUN_STATE.format("started_at < timestamp '2024-01-16'")}), n as ({_RUN_STATE.format("started_at >= timestamp '2024-01-16' and run_id % 3 = 0")})
        select coalesce(n.source_id, o.source_id) as source_id, coalesce(n.cursor, o.cursor) as cursor, coalesce(n.etag, o.etag) as etag, coalesce(n.last_seen, o.last_seen) as last_seen,
            coalesce(n.last_seen, o.last_seen) as last_success, case when n.source_id is not null then n.last_error else o.last_error end as last_error from o full join n on o.source_id = n.source_id""",
    "index_run": """with e as (select event_id % 5000 as post_id, arg_max(event_type, event_id) as kind, max(event_id) as last from events group by 1), x as (select *, last % 3 > 0 as known, kind in ('click', 'view', 'error') as run from e)
        select post_id, case when run then case kind when 'error' then 'error' else 'done' end else case when last % 2 = 0 then 'error' else 'done' end end as embedding_status,
            case when run and kind = 'click' then 'done' when run and kind = 'view' and not known then 'skipped' when known then 'pending' end as graph_status,
            cast(case when run then case when kind = 'error' then case when known then last % 4 else 0 end + 1 else 0 end else last % 4 end as int) as retry_count,
            case when run and kind = 'error' then 'failed ' || last else '' end as error_message from x where run or known""",
    "workspace_patch": f"""with {_WORKSPACES} select id, case when length(id) % 3 = 0 then 0 else members end as members, case when length(id) % 3 = 1 then not is_active else is_active end as is_active from workspaces""",
    "source_switches": f"with {V.SOURCES} select source_id, kind, case when kind in ('rss', 'web') then not full_content else full_content end as enabled from sources where kind <> 'email'",
    "enabled_sources": f"""with {V.POSTS}, {V.SOURCES}, r as (select source_id, workspace, row_number() over (partition by source_id order by n desc, workspace) as r
            from (select source_id, workspace, count(*) as n from posts where source_id is not null and workspace is not null group by all))
        select source_id, kind, workspace from sources join r using (source_id) where r = 1 and full_content and workspace in ('en', 'de')""",
    "url_queue": r"""select 'post-' || page_id as post_id, '["' || url || '"]' as urls from pages where page_id % 10 > 0 and page_id % 7 <> 0""",
    "stale_objects": "select 'vision/' || (page_id % 50) || '/' || page_id as key from pages where page_id % 10 = 7 order by 1 limit 100",
    "budget_texts": rf"""with c as (select conv_id, turn, {_CLEAN} as t from conversations) select conv_id, turn, md5(regexp_replace(left(t, 240), '\s+$', '')) as digest,
        length(regexp_replace(left(t, 240), '\s+$', '')) < length(t) as truncated from c""",
    "alert_digests": """with g as (select cast(ts as date) as day, user_id % 40 as service, event_type, string_agg(cast(event_id as varchar), ',' order by cast(event_id as varchar)) as marks from events where event_type in ('error', 'signup') group by all),
        s as (select *, case event_type when 'signup' then 'resolved' else 'firing' end as state from g)
        select 'admin:alertmanager:delivery:' || sha256(case when service % 2 = 0 then state || '|' || event_type || ':' || service else state || '|' || event_type || '||' || service || '|' || marks end) as digest, count(*) as n from s group by 1""",
    "merged_weights": f"""with {_WORKSPACES} select id, case when is_active then 0.55::double when length(id) > 8 then 0.6::double end as threshold, case when length(id) > 8 then round(members / 100, 6) end as recency from workspaces""",
    "joint_routing": f"with {V.POSTS} select workspace, coalesce(workspace in ('en', 'fr'), false) or coalesce(source_id in ('src1', 'src2'), false) as joint, count(*) as n from posts group by all",
    "index_compensation": f"""with {V.POSTS} select label as workspace, count(*) as vectors, min(vec_id) as first from embeddings where vec_id not in (select post_id from posts where status = 'error') group by 1""",
    "vision_decisions": """with p as (select page_id as n, page_id || (['.jpg', '.MP4', '.webm', '.png'])[page_id % 4 + 1] as key, html, (['full', 'ocr_only', 'skip', 'full'])[page_id % 7 % 4 + 1] as mode from pages),
        m as (select *, case n % 5 when 0 then 'image/png' when 1 then 'image/webp' when 2 then 'video/mp4' else case n % 4 when 1 then 'video/mp4' when 2 then 'video/webm' else 'image/jpeg' end end as mime,
            strlen(html) + case n % 5 when 0 then 8 when 1 then 12 when 2 then 8 else 0 end as size, case when n % 2 = 0 then 2500 else 9000000 end as most from p)
        select key, mime, mode, case when mode = 'ocr_only' then 'source_vision_mode_ocr_only' when starts_with(mime, 'video/') or n % 4 in (1, 2) then 'video_media_not_sent_to_gigachat'
            when size > most then 'media_too_large>' || most end as reason, mode <> 'skip' and starts_with(mime, 'image/') as ocr from m""",
    "search_request": f"""with {_PAYLOAD} select post_id, similarity, cast(row_number() over (order by similarity desc, post_id) as int) as rank from pay
        where source_region = 'eu' and valence in ('negative', 'neutral') and published_at >= timestamp '2024-01-31 12:30:00' - interval 25 day order by similarity desc, post_id limit 15""",
    "search_balanced": f"""with {_PAYLOAD}, {_LANES.format(main=20)} select lane, rank, post_id, similarity from lanes where rank <= 5""",
    "search_blind_spots": f"""with {_PAYLOAD}, {V.POSTS}, {_LANES.format(main=1)}, f as (select lane, regexp_matches(lower(content), 'acme|the') as named from lanes left join posts using (post_id) where rank <= 5),
        g as (select count(*) filter (where lane = 'region') as region, count(*) filter (where lane = 'counter') as counter, coalesce(bool_or(named), false) as named from f)
        select region, counter, concat_ws(',', 'low_intent_confidence', case when region = 0 then 'no_ru_verification_evidence' end, case when counter = 0 then 'no_counter_signals_found' end,
            case when not named then 'no_competitor_evidence' end) as gaps from g""",
}
