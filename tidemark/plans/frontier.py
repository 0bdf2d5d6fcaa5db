"""Approximate search, keyed stream state, leases, change points by windows, schedules and text budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import views as V
from tidemark.functions import cron, requests as R
from tidemark.operators import ivf, ranking, series as T
from tidemark.plans.tables import _event_stream
from tidemark.streaming import jobs as J, state
from tidemark.streaming.leases import Leases

#: Cells of the index over the given vectors, and those that a search looks into: many, as these vectors point in all directions alike.
CELLS, PROBES = 32, 24


def _queries(spark, d) -> DataFrame:
    """The vectors of every twentieth point."""
    return V.points(spark, d).filter(F.col("post_id") % 20 == 0).select(F.col("post_id").alias("query_id"), F.col("vector").alias("q"))


def ivf_all_cells(spark: SparkSession, d: str) -> DataFrame:
    """The twenty nearest of each query through the index, every cell looked into: an exact search."""
    found = ivf.build(V.points(spark, d), CELLS).search(_queries(spark, d), 20, CELLS + 1)
    return found.select("query_id", "post_id", "rank", F.round("similarity", 6).alias("similarity"))


def ivf_recall(spark, d):
    """Whether a search of some cells finds nine of ten of the twenty nearest, and how many queries there were."""
    index, queries = ivf.build(V.points(spark, d), CELLS), _queries(spark, d)
    pairs = [index.search(queries, 20, n).select("query_id", "post_id") for n in (PROBES, CELLS + 1)]
    both = pairs[1].withColumn("wanted", F.lit(1)).join(pairs[0].withColumn("found", F.lit(1)), ["query_id", "post_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), (F.sum(F.coalesce("found", F.lit(0))) / F.sum("wanted") >= 0.9).alias("recall_reached"))


def stream_first_for_good(spark, d):
    """The first event of each source of runs, as a table whose rows are of one key each for good."""
    s = _event_stream(spark, d).select((F.col("user_id") % 20).alias("source"), "event_id", "event_type")
    with state.rocksdb(spark):
        return J.drain(state.first_for_good(s, ["source"], "event_id"), "first")


def stream_send_once(spark, d):
    """Events as alerts, one of a user and type in six hours; each fifth event's sending fails and leaves no mark."""
    s = _event_stream(spark, d).select("user_id", "event_type", "event_id", "ts")
    with state.rocksdb(spark):
        out = J.drain(state.send_once(s, ["user_id", "event_type"], "ts", "event_id", 6 * 3600, lambda r: r.event_id % 5 != 0, "90 days"), "once")
    return out.select("event_id", "outcome")


def pending_claims(spark, d):
    """Events that a consumer got and didn't finish, claimed each eleven minutes by the next one: who finished which at what
    delivery, and what became a dead letter. Events of odd id were delivered eight minutes after the others."""
    e = V.table(spark, d, "events").select(F.col("event_id").alias("entry"), (F.get_json_object("props", "$.k").cast("int") % 7).alias("failures"))
    leases = Leases(spark, "pending")
    start = F.lit("2024-01-31 12:00:00").cast("timestamp")

    def after(minutes: int):
        return start + F.make_dt_interval(mins=F.lit(minutes))

    leases.deliver(e.filter("entry % 2 = 0"), "w0", after(0))
    leases.deliver(e.filter("entry % 2 = 1"), "w0", after(8))
    done = []
    for turn in range(8):
        if turn:
            leases.claim(f"w{turn}", after(11 * turn))
        finished = leases.pending.join(e, "entry").filter((F.col("failures") < F.col("deliveries")) & (F.col("owner") == f"w{turn}"))
        done.append(J.keep(finished.select("entry", "owner", "deliveries"), f"done{turn}"))
        leases.acknowledge(done[-1])
    out = leases.dead.select("entry", "owner", "deliveries").withColumn("status", F.lit("dead"))
    for x in done:
        out = out.unionByName(x.withColumn("status", F.lit("done")))
    return out


def change_points_window(spark, d):
    """Change points of each type's counts of three hours, by two windows of four buckets each."""
    e = V.table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))
    s = T.buckets(e, ["event_type"], "ts", 3, {})
    out = T.window_changes(s, ["event_type"], half=4, apart=2)
    return out.select("event_type", "window_start", F.round("discrepancy", 6).alias("discrepancy"))


def _schedules(spark, d) -> DataFrame:
    """An expression for each part: of its size, brand and price."""
    k = F.col("p_partkey")
    number = k.cast("string")
    forms = [
        F.concat(F.lit("*/"), (k % 29 + 1).cast("string"), F.lit(" * * * *")), F.concat((k % 60).cast("string"), F.lit(" */"), (k % 11 + 1).cast("string"), F.lit(" * * *")),
        F.concat((k % 60).cast("string"), F.lit(","), (k * 7 % 60).cast("string"), F.lit(" 8-18/2 * * *")), F.concat(F.lit("30 6 * * "), (k % 7).cast("string")),
        F.concat(F.lit("0 0 "), (k % 28 + 1).cast("string"), F.lit(" * *")), F.concat(F.lit("wrong "), number),
    ]
    return V.table(spark, d, "part").select(k.alias("id"), F.get(F.array(*forms), (k % len(forms)).cast("int")).alias("cron"))


def cron_intervals(spark, d):
    return cron.interval_minutes(_schedules(spark, d), "id", "cron", F.lit("2024-01-31 12:30:00"))


def words_of(texts: list[str]) -> list[int]:
    """A counter of tokens: here runs of anything but blanks."""
    return [len(t.split()) for t in texts]


def budgeted_texts(spark, d):
    """Posts cut to fifty words by a counter: a digest and whether something was cut."""
    p = V.posts(spark, d).select("post_id", "content", R.fit_budget(F.col("content"), 50, counter=words_of).alias("fitted"))
    return p.select("post_id", F.md5("fitted").alias("digest"), F.length("fitted").cast("bigint").alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (ivf_all_cells, ivf_recall, stream_first_for_good, stream_send_once, pending_claims, change_points_window, cron_intervals, budgeted_texts)
}
ORACLES = {
    "ivf_all_cells": f"""with {V.POINTS}, q as (select post_id as query_id, vector as q from points where post_id % 20 = 0),
        s as (select query_id, post_id, round(list_cosine_similarity(vector, q), 9) as s from points, q),
        r as (select *, cast(row_number() over (partition by query_id order by s desc, post_id) as int) as rank from s) select query_id, post_id, rank, round(s, 6) as similarity from r where rank <= 20""",
    "ivf_recall": "select count(*) as queries, true as recall_reached from embeddings where vec_id % 20 = 0",
    "stream_first_for_good": "select user_id % 20 as source, min(event_id) as event_id, arg_min(event_type, event_id) as event_type from events group by 1",
    "stream_send_once": """with recursive e as (select user_id, event_type, event_id, ts, event_id % 5 <> 0 as ok, row_number() over (partition by user_id, event_type order by ts, event_id) as r from events),
        f as (select user_id, event_type, event_id, r, case when ok then ts + interval 6 hour end as until, case when ok then 'sent' else 'failed' end as outcome from e where r = 1
            union all select e.user_id, e.event_type, e.event_id, e.r, case when e.ts < until then until when ok then e.ts + interval 6 hour else until end,
                case when e.ts < until then 'held' when ok then 'sent' else 'failed' end from f join e on e.user_id = f.user_id and e.event_type = f.event_type and e.r = f.r + 1)
        select event_id, outcome from f""",
    "pending_claims": """with e as (select event_id as entry, cast(json_extract_string(props, '$.k') as int) % 7 as failures, event_id % 2 as late from events)
        select entry, 'w' || (least(failures, 4) + case when late = 1 and failures > 0 then 1 else 0 end) as owner, cast(least(failures + 1, 5) as int) as deliveries,
            case when failures < 5 then 'done' else 'dead' end as status from e""",
    "change_points_window": """with b as (select event_type, time_bucket(interval 3 hour, ts) as window_start, count(*) as x from events group by all),
        i as (select *, row_number() over w - 1 as i, count(*) over (partition by event_type) as n from b window w as (partition by event_type order by window_start)),
        g as (select a.event_type, a.window_start, a.i, a.n, 2 * (avg(case when l.i < a.i then l.x end) - avg(case when l.i >= a.i then l.x end)) ** 2 as gain
            from i a join i l on a.event_type = l.event_type and l.i between a.i - 4 and a.i + 3 where a.i >= 4 and a.i <= a.n - 4 group by all)
        select g.event_type, g.window_start, round(g.gain, 6) as discrepancy from g left join g h on g.event_type = h.event_type and abs(g.i - h.i) <= 2 and h.i <> g.i
        group by all having g.gain > coalesce(max(h.gain), -1) and g.gain > greatest(sqrt(any_value(g.n)), 2)""",
    "cron_intervals": """with p as (select p_partkey as id, p_partkey as k, cast(p_partkey % 6 as int) as form from part),
        days as (select cast(unnest(generate_series(date '2024-01-31', date '2024-04-30', interval 1 day)) as date) as d),
        m as (select d, d + to_minutes(cast(t as bigint)) as fires, t // 60 as h, t % 60 as m from days, (select unnest(range(0, 1440)) as t) where d < date '2024-02-03'),
        f as (select id, fires from p, m where form < 3 and case form when 0 then m % (k % 29 + 1) = 0 when 1 then m = k % 60 and h % (k % 11 + 1) = 0
                else (m = k % 60 or m = k * 7 % 60) and h in (8, 10, 12, 14, 16, 18) end
            union all select id, d + to_minutes(cast(case form when 3 then 390 else 0 end as bigint)) from p, days where case form when 3 then dayofweek(d) = k % 7 when 4 then day(d) = k % 28 + 1 else false end),
        r as (select id, fires, row_number() over (partition by id order by fires) as r from f where fires > timestamp '2024-01-31 12:30:00'),
        g as (select id, cast(date_diff('minute', min(fires), max(fires)) as int) as gap from r where r <= 2 group by id having count(*) = 2)
        select p.id, coalesce(gap, 60) as "interval" from p left join g on p.id = g.id""",
    "budgeted_texts": r"""with t as (select doc_id as post_id, trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13)) as t from documents),
        c as (select post_id, regexp_extract(t, '^(\S+\s+){0,49}\S+') as c from t) select post_id, md5(c) as digest, length(c) as chars from c""",
}
