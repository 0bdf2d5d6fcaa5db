"""Formulas on literal rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import events, intents, model_output, scores as S, text as tx, vectors as v, vision
from tidemark.functions import html as H, requests as R


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(x).alias(k) for k, x in values.items()] or [F.lit(1).alias("_")])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("hours,want", [(1.0, 1.0), (24.0, 1.0), (30.0, 0.75), (100.0, 0.45), (500.0, 0.2)])
def test_freshness(spark, hours, want):
    assert one(spark, S.freshness(F.col("h")), h=hours) == want


def test_freshness_of_nothing(spark):
    none = F.lit(None).cast("double")
    assert one(spark, S.freshness_boost(none)) == 0.0
    assert one(spark, S.source_freshness(none)) == 0.2


def test_source_quality(spark):
    q = S.source_quality(*[F.lit(x) for x in (0.5, 6, 2, 40, 10, 0.25, 2.0, 0.5, 400.0)])
    row = spark.range(1).select(*[c.alias(n) for n, c in q.items()]).first()
    assert row["runtime_health"] == pytest.approx(0.7 * 0.75 + 0.3 * 0.25)  # .6
    assert row["yield_score"] == pytest.approx(0.6 * 0.25 + 0.2 * 0.4 + 0.2 * 0.5)  # .33
    assert row["freshness"] == 0.3  # 400 hours: within thirty days
    assert row["source_score"] == pytest.approx(0.35 * 0.5 + 0.30 * 0.6 + 0.20 * 0.33 + 0.15 * 0.3)


@pytest.mark.parametrize("hours,want", [(24.0, 1.0), (25.0, 0.8), (168.0, 0.55), (169.0, 0.3), (720.0, 0.3), (721.0, 0.15)])
def test_source_freshness(spark, hours, want):
    assert one(spark, S.source_freshness(F.lit(hours))) == want


@pytest.mark.parametrize(
    "kind,full,status,errors,text,fetched,emitted,want",
    [
        ("rss", True, "success", 0.1, "got 429 once", 8, 8, "summary-only"),
        ("rss", True, "success", 0.1, None, 8, 8, "full-content"),
        ("web", False, "success", 0.0, None, 10, 5, "listing-only"),
        ("web", True, "success", 0.1, None, 10, 5, "full-content"),
        ("telegram", True, "success", 0.0, None, 1, 1, "native"),
        ("api", True, "success", 0.0, None, 4, 0, "summary-only"),
    ],
)
def test_content_mode(spark, kind, full, status, errors, text, fetched, emitted, want):
    args = [F.lit(x) for x in (kind, full, status, errors)] + [F.lit(text).cast("string"), F.lit(fetched), F.lit(emitted)]
    assert one(spark, S.content_mode(*args)) == want


@pytest.mark.parametrize(
    "score,docs,sources,change,strength,want",
    [(0.82, 7, 5, False, 0.0, "high_score"), (0.95, 4, 5, True, 0.9, None), (0.75, 8, 4, True, 0.8, "change_point")],
)
def test_alert_reason(spark, score, docs, sources, change, strength, want):
    assert one(spark, S.alert_reason(*[F.lit(x) for x in (docs, sources, score, change, strength)])) == want


def test_ranks(spark):
    assert one(spark, S.search_rank(F.lit(0.8), F.lit(0.9), F.lit(1.0))) == pytest.approx(1.008)
    assert one(spark, S.trend_rank(F.lit(0.7), F.lit(0.9), F.lit(0.8), F.lit(6))) == pytest.approx(0.8855)


def test_gap(spark):
    strength = S.external_strength(F.lit(4), 8, F.lit(2), F.lit(1.2))
    assert one(spark, strength) == pytest.approx(0.55 * 0.5 + 0.30 * 0.25 + 0.15 * 0.4)  # .41: hosts of the results asked for
    assert one(spark, S.external_strength(F.lit(8), 8, F.lit(8), F.lit(9.0))) == 1.0
    assert one(spark, S.gap(F.lit(0.41), F.lit(0.7))) == pytest.approx(0.21)
    assert one(spark, S.gap(F.lit(0.41), F.lit(7.0))) == 0.0


@pytest.mark.parametrize(
    "state,touched,idle,want",
    [("active", False, 49.0, "cooling"), ("active", False, 48.0, "active"), ("active", True, 900.0, "active"), ("cooling", False, 337.0, "archived"), ("archived", False, 60.0, "archived"), ("cooling", False, 60.0, "cooling")],
)
def test_lifecycle(spark, state, touched, idle, want):
    assert one(spark, S.lifecycle(F.lit(state), F.lit(touched), F.lit(idle))) == want


def test_fading(spark):
    assert one(spark, S.fading(F.lit("stable"), F.lit(False), F.lit(169.0))) == "fading"
    assert one(spark, S.fading(F.lit("stable"), F.lit(True), F.lit(169.0))) == one(spark, S.fading(F.lit("stable"), F.lit(False), F.lit(168.0))) == "stable"


def test_april(spark):
    flag = S.april_joke(F.lit("2026-04-01 12:00:00").cast("timestamp_ntz"), F.lit("Big April Fool news"), F.lit("x"))
    assert one(spark, flag)
    mult, blocked = S.april_penalty(F.lit(1.0))
    assert one(spark, mult) == pytest.approx(0.55) and one(spark, blocked)


def test_relevance_gates(spark):
    assert one(spark, S.relevant(F.lit(0.5), F.lit("technology")))
    assert not one(spark, S.relevant(F.lit(0.5), F.lit("other")))


def test_urls(spark):
    def safe(u):
        return one(spark, tx.safe_url(F.lit(u)))

    assert safe("HTTPS://Host.net/a//?q=&UTM_x=1&k=v&yclid=9&Ref=z&w=a=b#top") == "https://Host.net/a?k=v&w=a=b"
    assert safe("http://host.net?x=1") == "http://host.net/?x=1"
    for u in ("ftp://host.net/x", "host.net/x", "http://172.20.3.4/x", "http://198.51.100.7:80/", "http://redis:6379/", "https://my-casino.net/", "https://"):
        assert safe(u) is None
    text = "look: https://b.net/1; http://www.telegram.dog/c, https://t.me/y (https://Y.net/2) https://b.net/1 https://youtube.com/w."
    assert one(spark, tx.urls(F.lit(text))) == ["https://b.net/1", "https://Y.net/2", "https://youtube.com/w"]
    assert one(spark, tx.canonical_url(F.lit("HTTP://A.net/P?rss_id=1&spm=2&Source=3&id=4#f"))) == "http://a.net/P?spm=2&id=4"
    assert one(spark, tx.netloc(F.lit("https://WWW.a.net:8080/x"))) == "www.a.net:8080"


@pytest.mark.parametrize("text,want", [(None, "unknown"), (" \n", "unknown"), ("plain", "en"), ("Їжак", "ru"), ("x" * 300 + "ж", "en"), ("  " + "x" * 299 + "ж", "ru")])
def test_detected_language(spark, text, want):
    assert one(spark, tx.detected_language(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("Which drone LAWS came in the last 45 days?", (None, 45, ["regulation"], False, 0.6)),
        ("funding and failed launches worldwide this quarter", ("global", 90, ["investment", "launch"], True, 0.9)),
        ("Рост и запрет за 3 дня, Россия", ("ru", 3, ["growth"], True, 0.9)),
        ("nothing much", (None, 30, [], False, 0.35)),
        ("999 days", (None, 365, [], False, 0.4)),
    ],
)
def test_intents(spark, text, want):
    found = intents.parse(F.lit(text), F.lit(30))
    row = spark.range(1).select(*[c.alias(n) for n, c in found.items()]).first()
    assert (row["source_region"], row["days_back"], row["signal_types"], row["wants_counter"], row["confidence"]) == want


def test_intents_of_a_full_request(spark):
    found = intents.parse(F.lit("policy risk in the world today"), F.lit(1), F.lit("de"), F.array(F.lit("x")))
    row = spark.range(1).select(*[c.alias(n) for n, c in found.items()]).first()
    assert (row["source_region"], row["region_reason"], row["confidence"]) == ("de", "explicit_request", 0.95)


def test_uuid5(spark):
    import uuid

    for s in ("post:1", "Привет"):
        assert one(spark, tx.uuid5_url(F.lit(s))) == str(uuid.uuid5(uuid.NAMESPACE_URL, s))


@pytest.mark.parametrize("value,ok", [("2024-01-02T03:04:05Z", True), ("Tue, 02 Jan 2024 03:04:05 +0000", True), ("2024-01-02", True), ("1704164645", True), ("soon", False)])
def test_times(spark, value, ok):
    found = one(spark, tx.parsed_time(F.lit(value)).cast("string"))
    assert (found is not None and found.startswith("2024-01-02")) == ok


def test_cosine(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, v.cosine(a, F.array(F.lit(1.0), F.lit(0.0), F.lit(5.0)))) == 1.0
    assert one(spark, v.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, v.cosine(a, F.array().cast("array<double>"))) == 0.0


def test_event_coercion(spark):
    m = {"event_id": "e", "workspace_id": "w", "source_id": "s", "external_id": "x", "content": "", "has_media": "False", "media_urls": '["u"]', "linked_urls": "", "published_at": "null", "extra": "[]"}
    message = F.create_map(*[F.lit(x) for pair in m.items() for x in pair])
    fields = events.post_event(message)
    row = spark.range(1).select(*[c.alias(n) for n, c in fields.items()], events.problem(fields).alias("problem")).first()
    assert row["media_urls"] == ["u"] and row["linked_urls"] == [] and row["published_at"] is None
    assert row["extra"] == "{}" and row["has_media"] is False and row["problem"] == "empty post"


def test_model_output():
    assert model_output.extract_json('Sure:\n```json\n{"a": [1, 2,], "b": {"c": "}"},}\n```') == '{"a": [1, 2], "b": {"c": "}"}}'
    assert model_output.extract_json("none") is None
    assert [model_output.category(x) for x in ("business", "дизайн", "другое", "zzz", "Tecnology")] == ["business_models", "design", "other", "other", "technology"]


def test_concepts(spark):
    schema = "array<struct<name:string,category:string,weight:int>>"
    c = F.from_json(F.lit('[{"name":"b","weight":9},{"name":" ","weight":2},{"name":"a","category":"x","weight":2}]'), schema)
    assert [tuple(x) for x in one(spark, model_output.valid_concepts(c))] == [("b", "other", 5), ("a", "x", 2)]


def test_valence(spark):
    assert [one(spark, model_output.valence(F.lit(x))) for x in (" Negative", "pos", "neutral")] == ["negative", "neutral", "neutral"]
    assert [one(spark, model_output.confidence(F.lit(x).cast("string"))) for x in ("1.5", None, "high", "0.25")] == [1.0, 0.0, 0.0, 0.25]
    assert [one(spark, model_output.signal_type(F.lit(x))) for x in ("Launch ", "scandal")] == ["launch", "other"]


def test_html():
    html = (
        '<html lang="en"><head><title>T &amp; x</title><meta property="og:image" content="I"><meta name="twitter:title" content="TW"></head><body><nav><p>menu</p></nav><h1> Head <i>on</i></h1>'
        '<p>One <b>two</b>, three<p>Four<ul><li>item <p>inner</p></li><li>last</ul><h4>Small</h4><form><p>asked</p></form><td>cell</td><a href="/l">go</a> <a href=" https://a.net/1 ">x</a>'
        '<a href="https://x.com/u">y</a><p>see http://b.net/2.</p><script>p("<p>x</p>")</script></body></html>'
    )
    blocks = ["One two , three", "Four", "item inner", "inner", "last", "asked", "see http://b.net/2."]
    t = H.text_of(html)
    assert t == {"title": "Headon", "text": "\n\n".join(blocks), "summary": blocks[0], "links": ["https://a.net/1", "http://b.net/2"]}
    assert H.markdown_of(html).split("\n\n") == ["# Headon", "Onetwo, three", "Four", "- iteminner", "inner", "- last", "#### Small", "asked", "see http://b.net/2."]
    m = H.meta_of(html)
    assert (m["title"], m["description"], m["lang"], m["og_title"], m["og_image"], m["og_url"]) == ("T & x", None, "en", "TW", "I", None)
    assert H.meta_of("<p>" + "long words " * 40)["description"] == ("long words " * 40)[:300] and H.meta_of("<h1>é</h1>")["lang"] == "ru"
    assert H.fragment_text("<p>Hello world</p> <b>Continue</b> !") == "Hello world Continue!"
    assert H.text_of(None) == {"title": "", "text": "", "summary": "", "links": []}


def test_request_arguments(spark):
    assert R.stages([" WEAK", "odd", ""], ("stable",)) == ["weak"] and R.stages(["odd"], ("stable",)) == R.stages(None, ("stable",)) == ["stable"]
    s = R.Search("  solid state ", lang=" DE ", entities="a, ,b", limit=50, days_back=365)
    assert (s.query, s.lang, s.entities) == ("solid state", "de", ["a", "b"]) and R.entities([str(i) for i in range(30)])[-1] == "19" and R.entities(7) is None
    for bad in ({"query": " "}, {"query": "x", "limit": 51}, {"query": "x", "days_back": 0}, {"query": "x", "lang": "d"}):
        with pytest.raises(ValueError):
            R.Search(**bad)
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, kind string")
    assert [R.matching(df, id=i, kind=k).count() for i, k in ((None, ""), (2, None), (2, "a"))] == [3, 1, 0]


def test_request_functions(spark):
    def joint(w, s, *allowed):
        return one(spark, R.joint_mode(F.lit(w).cast("string"), F.lit(s).cast("string"), *allowed))

    assert [joint("w", "s", False, "w"), joint("w", "s", True), joint("w", "s", True, "v, w"), joint(None, "s", True, "v"), joint("x", "s", True, "v", "s")] == [False, True, True, False, True]
    weights = F.create_map(F.lit("a"), F.lit(1.0), F.lit("threshold"), F.lit(0.2))
    assert one(spark, R.with_threshold(weights, F.lit(0.7))) == {"a": 1.0, "threshold": 0.7} and one(spark, R.with_threshold(F.lit(None).cast("map<string,double>"), F.lit(None).cast("double"))) == {}
    marks = F.array(F.lit(" b "), F.lit(""), F.lit("a10"))
    want = "admin:alertmanager:delivery:" + hashlib.sha256(b"firing|Lag||crawl|a10,b").hexdigest()
    assert one(spark, R.delivery_key(F.lit(""), F.lit(" "), [F.lit("Lag"), F.lit(None).cast("string"), F.lit("crawl")], marks)) == want
    assert one(spark, R.delivery_key(F.lit("Resolved"), F.lit("g"), [], marks)) == "admin:alertmanager:delivery:" + hashlib.sha256(b"resolved|g").hexdigest()
    assert [one(spark, R.fit_budget(F.lit(t), n)) for t, n in (("  some words here ", 2), ("ab", 9), ("ab", 0))] == ["some wor", "ab", ""]
    links = ["/@me/story-1", "https://m.net/tag/x/y", "https://m.net/a", "/@me/story-1", "https://other.net/a/b", "/p/about-us", "/x/followers", "/pub/story-2", "/pub/story-3"]
    assert one(spark, R.archive_links(F.array(*map(F.lit, links)), "https://m.net/", 2)) == ["https://m.net/@me/story-1", "https://m.net/pub/story-2"]


def test_published_of():
    def page(body):
        return f'<html><script type="application/ld+json">{body}</script><script>var x = "datePublished";</script></html>'

    assert H.published_of(page('[{"@graph": [{"name": "x"}, {"mainEntity": {"dateCreated": "2024-03-01"}}]}]')) == "2024-03-01"
    assert H.published_of(page('{"datePublished": "2023-01-02T03:04:05Z", "@graph": [{"datePublished": "2020-01-01"}]}')) == "2023-01-02T03:04:05Z"
    assert H.published_of(page("{broken")) is None and H.published_of(page('{"other": {"datePublished": "2020"}}')) is None and H.published_of(None) is None


def test_vision_messages(spark):
    m = {"post_id": "p", "media_s3_keys": '["a", 7]', "grouped_id": " None ", "album_item_index": " 3 ", "album_total_items": "x", "vision_mode": " OCR_only ", "max_media_bytes": ""}
    fields = vision.vision_event(F.create_map(*[F.lit(x) for pair in m.items() for x in pair]))
    row = spark.range(1).select(*[c.alias(n) for n, c in fields.items()]).first()
    assert (row["media_s3_keys"], row["grouped_id"], row["album_item_index"], row["album_total_items"], row["vision_mode"], row["max_media_bytes"]) == (["a", "7"], "", 3, 1, "ocr_only", 9_000_000)
    mode, most = vision.policy(F.lit("none"), F.lit("-5"))
    assert (one(spark, mode), one(spark, most)) == ("full", 0)
    labels = F.array(F.lit(" cat "), F.lit(""), F.lit("sofa"))
    assert one(spark, vision.summary(labels, F.lit("two \n lines"), F.lit(None).cast("string"))) == "cat, sofa; two lines"
    assert one(spark, vision.mime(F.lit("x.MOV"), F.lit(b""))) == "video/quicktime" and one(spark, vision.mime(F.lit(None).cast("string"), F.lit(b"GIF89a"))) == "image/gif"
