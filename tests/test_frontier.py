"""Index, stream state, leases, schedules, budgets, selectors, payloads and landed pages on literal rows and by brute force."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import cron, model_output, payloads, requests as R, selectors as C
from tidemark.operators import ivf
from tidemark.sources import landed
from tidemark.streaming import jobs, state
from tidemark.streaming.leases import Leases


def test_index_reads_the_probed_cells_only(spark):
    rnd = random.Random(3)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(10)]
    rows = [(i, [x + rnd.gauss(0, 0.1) for x in centres[i % 10]]) for i in range(600)] + [(600, [0.0] * 8)]
    index = ivf.build(spark.createDataFrame(rows, "post_id long, vector array<double>"), 10)
    assert index.table.count() == 601 and {r.post_id for r in index.table.filter("cell = -1").collect()} == {600}
    queries = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 600, 20)], "query_id long, q array<double>")
    exact = {(r.query_id, r.post_id) for r in index.search(queries, 20, 11).collect()}
    found = index.search(queries, 20, 2)
    got = {(r.query_id, r.post_id) for r in found.collect()}
    assert len(exact) == len(got) == 600 and len(exact & got) >= 0.9 * 600

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    for q in (0, 320):
        best = sorted(range(600), key=lambda i: (-round(cosine(rows[q][1], rows[i][1]), 9), i))[:20]
        assert {p for k, p in exact if k == q} == set(best)
    assert "PartitionFilters: [isnotnull(cell" in found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def _stream(spark, path, batches, kind):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)


def test_first_row_for_good_over_batches(spark, tmp_path):
    batches = [[("a", 5, 1), ("b", 3, 2), ("a", 4, 3)], [("a", 1, 4), ("c", 9, 5), ("c", 8, 6)], [("b", 0, 7), ("d", 1, 8), ("c", 1, 9)]]
    s = _stream(spark, str(tmp_path / "in"), batches, "k string, at long, v long")
    with state.rocksdb(spark):
        out = jobs.drain(state.first_for_good(s, ["k"], "at"), "first-test")
    assert sorted(map(tuple, out.collect())) == [("a", 4, 3), ("b", 3, 2), ("c", 8, 6), ("d", 1, 8)]


def test_marks_are_set_after_a_send_and_expire(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)

    def at(minutes):
        return t0 + dt.timedelta(minutes=minutes)

    batches = [
        [("a", 1, at(0), False), ("a", 2, at(1), True), ("a", 3, at(5), True), ("b", 4, at(0), False)],
        [("a", 5, at(31), True), ("b", 6, at(2), True), ("a", 7, at(30), False)],  # the mark of 2 holds until minute 31
        [("a", 8, at(60), True), ("b", 9, at(40), False), ("b", 10, at(41), True)],
    ]
    s = _stream(spark, str(tmp_path / "in"), batches, "k string, id long, ts timestamp, ok boolean")
    with state.rocksdb(spark):
        out = jobs.drain(state.send_once(s, ["k"], "ts", "id", 1800, lambda r: r.ok, "1 day"), "once-test")
    got = {r.id: r.outcome for r in out.collect()}
    assert got == {1: "failed", 2: "sent", 3: "held", 4: "failed", 5: "sent", 6: "sent", 7: "held", 8: "held", 9: "failed", 10: "sent"}


def test_leases(spark):
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp")

    def at(minutes):
        return t0 + F.make_dt_interval(mins=F.lit(minutes))

    def ids(*values):
        return spark.createDataFrame([(v,) for v in values], "entry long")

    leases = Leases(spark, "test", most=3, idle_seconds=600)
    leases.deliver(ids(1, 2, 3), "a", at(0))
    leases.deliver(ids(3, 4, 4), "b", at(5))  # 3 is pending and stays with its owner
    leases.acknowledge(ids(1))
    assert {(r.entry, r.owner, r.deliveries) for r in leases.pending.collect()} == {(2, "a", 1), (3, "a", 1), (4, "b", 1)}
    assert {r.entry for r in leases.claim("c", at(10)).collect()} == {2, 3}  # 4 was idle for five minutes only
    assert {r.entry for r in leases.claim("d", at(15)).collect()} == {4}
    assert {r.entry for r in leases.claim("a", at(30)).collect()} == {2, 3, 4}
    leases.acknowledge(ids(3))
    assert leases.claim("b", at(41)).count() == 0
    assert {(r.entry, r.owner, r.deliveries) for r in leases.dead.collect()} == {(2, "a", 3), (4, "a", 3)} and leases.pending.count() == 0
    leases.deliver(ids(2), "a", at(50))
    assert {(r.entry, r.deliveries) for r in leases.pending.collect()} == {(2, 1)} and leases.dead.count() == 2


def test_cron(spark):
    def brute(text, now):
        def one(part, least, most, names):
            value, _, step = part.partition("/")
            low, _, high = value.partition("-")

            def number(x):
                return names.index(x) + (names[0] == "jan") if x in names else int(x)

            low, high = (least, most) if value == "*" else (number(low), number(high) if high else most if step else number(low))
            return set(range(low, high + 1, int(step or 1)))

        kinds = [(), (), (), cron.MONTHS, cron.DAYS]
        fields = text.split()
        sets = [set().union(*(one(p, *cron.FIELDS[i], kinds[i]) for p in f.split(","))) for i, f in enumerate(fields)]
        week = {d % 7 for d in sets[4]}
        out, t = [], now.replace(second=0) + dt.timedelta(minutes=1)
        while len(out) < 2:
            dates = (t.day in sets[2], (t.weekday() + 1) % 7 in week)
            day = any(dates) if fields[2] != "*" and fields[4] != "*" else all(dates)
            if t.minute in sets[0] and t.hour in sets[1] and t.month in sets[3] and day:
                out.append(t)
            t += dt.timedelta(minutes=1)
        return int((out[1] - out[0]).total_seconds() // 60)

    now = dt.datetime(2024, 2, 28, 23, 50)
    right = ["*/5 * * * *", "20 */6 * * *", "35 3 * * *", "0 9-17/4 * * mon-fri", "15,45 1,13 * * *", "0 0 1 * *", "0 12 13 * fri", "5/20 8 * mar 0", "0 0 29 feb *", "59 23 31 12 7"]
    wrong = ["", "* * * *", "61 * * * *", "*/0 * * * *", "a b c d e", "5-1 * * * *", "* * * * * *", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*right[:8], *wrong])], "id long, cron string")
    got = {r.id: r.interval for r in cron.interval_minutes(df, "id", "cron", F.lit("2024-02-28 23:50:00")).collect()}
    assert [got[i] for i in range(len(got))] == [brute(x, now) for x in right[:8]] + [60] * len(wrong)


def test_budget_equals_brute_force(spark):
    rnd = random.Random(4)

    def count(texts):  # more for long words, so that no rule of characters holds
        return [sum(1 + len(w) // 5 for w in t.split()) for t in texts]

    texts = ["".join(rnd.choice("abc   \n") for _ in range(rnd.randrange(0, 90))) for _ in range(60)] + ["", "  ", "x" * 400]
    for budget in (0, 1, 7, 30):
        got = R.longest_prefixes(texts, budget, count)
        for text, fitted in zip(texts, got, strict=True):
            clean = text.strip()
            best = max((n for n in range(len(clean) + 1) if budget > 0 and count([clean[:n].rstrip()])[0] <= budget), default=0)
            assert fitted == clean[:best].rstrip()
    df = spark.createDataFrame([("  one two three four ",), (None,)], "t string")
    words = R.fit_budget(F.col("t"), 3, counter=lambda ts: [len(t.split()) for t in ts])
    assert [r.x for r in df.select(words.alias("x")).collect()] == ["one two three", ""]


PAGE = """<html><body><div id="main" class="list wide"><article class="post hot"><h2><a href=" /a ">First <b>one</b></a></h2><time datetime="2024-01-02T03:04:05Z">2 Jan</time><p>text<p>more</article>
<article class="post"><a href="">empty</a></article><div class="item"><h3>No link</h3></div><div class="item"><a href="https://x.org/b" rel="nofollow me">Second</a><time>3 Jan</time></div></div>
<ul><li class="item"><a data-x="1">none</a><li><a href="/c">Third</a></ul></body></html>"""


def test_selectors():
    root = C.tree(PAGE)

    def texts(selector):
        return [e.text() for e in C.select(root, selector)]

    assert texts("h2 a") == ["First one"] and texts("#main > .item h3") == ["No link"] and texts("article.post.hot p") == ["text", "more"]
    assert texts("div > a") == ["Second"] and texts("a[href^='https']") == texts("a[rel~=me]") == texts('.item a[href$="/b"]') == ["Second"]
    assert texts("ul > li") == ["none", "Third"] and len(texts("a[href]")) == 4 and texts("H3, time") == ["2 Jan", "No link", "3 Jan"] and texts("body *.item > a[data-x]") == ["none"]
    assert C.select(root, "div > p") == [] and texts("div p") == ["text", "more"]
    items = C.listed(PAGE)
    assert [(x["href"], x["title"], x["date"]) for x in items] == [("/a", "First one", "2024-01-02T03:04:05Z"), ("https://x.org/b", "Second", "3 Jan")]
    assert C.listed(None) == C.listed("") == [] and C.listed("<article>" * 3000 + "<a href=x>deep</a>")[0]["href"] == "x"
    for wrong in ("", "> a", "a >", "a b!", ",a"):
        with pytest.raises(ValueError):
            C.select(root, wrong)


def test_payloads(spark):
    assert payloads.merged({"a": {"b": 1, "c": {"d": [1]}}, "e": 2}, {"a": {"c": {"d": [2], "f": None}}, "e": {"g": 1}}) == {"a": {"b": 1, "c": {"d": [2], "f": None}}, "e": {"g": 1}}
    odd = json.loads(payloads.settings("web", json.dumps({"fetch": 7, "vision": {"mode": "OCR_only", "max_media_bytes": "x"}, "source_authority": None, "expected_signal_types": "no"})))
    assert odd["fetch"] == payloads.DEFAULTS["fetch"] and odd["vision"] == {"mode": "ocr_only", "max_media_bytes": 9_000_000} and odd["source_authority"] == 0.5 and odd["expected_signal_types"] == []
    assert json.loads(payloads.settings("fax", "no json")) == payloads.DEFAULTS and payloads.kind_of(" HABR ") == "rss"
    rows = [("habr", None, None, '{"preset": "p"}'), ("rss", None, None, None), ("telegram", None, "", None), ("email", None, None, '{"fetch": {"host": "h", "username": "u"}}'), (None, None, None, None)]
    got = payloads.checked(spark.createDataFrame(rows, "kind string, url string, channel string, extra string"), {"p": "http://feed"}).select("kind", "url", F.array_join("reasons", ";").alias("why")).collect()
    assert [tuple(r) for r in got] == [("rss", "http://feed", ""), ("rss", None, "a url is missing"), ("telegram", None, "a channel is missing"), ("email", None, ""), ("", None, "unknown kind ")]


def test_landed_pages_are_read_once(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()

    def put(n, etag, *items):
        (folder / f"{n}.json").write_text(json.dumps({"etag": etag, "items": [{"id": i} for i in items]}))

    put(0, "x", 1, 2)
    put(1, "x", 1, 2)
    put(2, "y", 3)
    put(3, None, 4)
    put(4, None, 4)
    landed.register(spark)

    def ids(**options):
        return sorted(json.loads(r.item)["id"] for r in spark.read.format("landed").options(path=str(folder), **options).load().collect())

    assert ids() == [1, 2, 3, 4, 4] and ids(**{"from": "2"}) == [3, 4, 4]
    stream = spark.readStream.format("landed").option("path", str(folder)).load().select("page", "item")
    place = str(tmp_path / "state")

    def run():
        stream.writeStream.format("parquet").option("checkpointLocation", place).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted((r.page, json.loads(r.item)["id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [(0, 1), (0, 2), (2, 3), (3, 4), (4, 4)]
    put(5, "z", 9)
    assert run() == [(0, 1), (0, 2), (2, 3), (3, 4), (4, 4), (5, 9)]  # nothing came again


def test_names_of_categories():
    known = ("technology", "business_models", "design", "science", "society")
    names = {"IT": "technology", "biz": "business_models", "UX": "design", "наука": "science", "Общество": "society", "информационные технологии": "technology", "другое": "other", "прочее": "other", "Tecnology": "technology", "zzz": "other", None: "other", "!": "other"}
    assert {k: model_output.category(k, known=known) for k in names} == names
    assert model_output.category("ux", known=("market",)) == "other"
