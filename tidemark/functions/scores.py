"""Scores, gates and stages of posts, sources, signals and alerts, as expressions.

Weights and limits that fix the results are fixed values, stated beside the formulas they belong to.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def steps(x: Column, limits: list[tuple[float, float]], rest: float, missing: float) -> Column:
    """The value of the first limit that ``x`` doesn't exceed."""
    out = F.when(x.isNull(), F.lit(missing))
    for limit, value in limits:
        out = out.when(x <= limit, F.lit(value))
    return out.otherwise(F.lit(rest))


def freshness(hours: Column) -> Column:
    """Of a post in a cluster."""
    return steps(hours, [(24, 1.0), (72, 0.75), (168, 0.45)], 0.2, 0.2)


def freshness_boost(hours: Column) -> Column:
    """Of a search hit."""
    return steps(hours, [(24, 1.0), (72, 0.75), (168, 0.45)], 0.15, 0.0)


def source_freshness(hours: Column) -> Column:
    """Of a source by its newest post."""
    return steps(hours, [(24, 1.0), (72, 0.8), (168, 0.55), (720, 0.3)], 0.15, 0.2)


def ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def source_quality(authority: Column, success: Column, errors: Column, fetched: Column, emitted: Column, relevant: Column, tags: Column, linked: Column, hours: Column) -> dict[str, Column]:
    """Health of the runs, yield of the posts, freshness, and the composite of them with authority."""
    health = clamp(0.7 * ratio(success, success + errors) + 0.3 * ratio(emitted, fetched))
    yields = clamp(0.6 * relevant + 0.2 * F.least(tags / 5, F.lit(1.0)) + 0.2 * linked)
    fresh = source_freshness(hours)
    return {
        "runtime_health": health,
        "yield_score": yields,
        "freshness": fresh,
        "source_score": clamp(0.35 * authority + 0.30 * health + 0.20 * yields + 0.15 * fresh),
    }


def content_mode(kind: Column, full_content: Column, last_status: Column, error_ratio: Column, error_text: Column, fetched: Column, emitted: Column) -> Column:
    """How much of a source's items to take."""
    flaky = F.coalesce(error_text, F.lit("")).rlike("403|429") | (error_ratio >= 0.45) | ((fetched > 0) & (emitted == 0))
    return (
        F.when(kind.isin("telegram", "email"), "native")
        .when(kind == "web", F.when(~full_content | (last_status == "error") | (error_ratio >= 0.4), "listing-only").otherwise("full-content"))
        .when(kind.isin("rss", "api"), F.when(flaky, "summary-only").otherwise("full-content"))
        .otherwise("summary-only")
    )


def search_rank(raw: Column, source_score: Column, boost: Column) -> Column:
    return raw * (1 + 0.20 * F.coalesce(source_score, F.lit(0.0)) + 0.08 * boost)


def trend_rank(raw: Column, signal: Column, burst: Column, sources: Column) -> Column:
    return raw * (1 + 0.15 * signal + 0.10 * burst + 0.05 * F.least(sources / 6, F.lit(1.0)))


def relevant(score: Column, category: Column, threshold: float = 0.6, gray: float = 0.1) -> Column:
    """At the threshold, or a little under it if the category is a known one."""
    return (score >= threshold) | ((category != "other") & (score >= threshold - gray))


def needs_review(score: Column, category: Column, coerced: Column, threshold: float = 0.6, band: float = 0.1) -> Column:
    return (F.abs(score - threshold) <= band) | ((category == "other") & coerced)


def representative(relevance: Column, source: Column, fresh: Column, similarity: Column, tags: Column, same_source: Column) -> Column:
    """Standing of a post in its cluster; posts of a source that is there more than once lose some."""
    plus = 0.46 * relevance + 0.22 * source + 0.14 * fresh + 0.12 * similarity + 0.06 * F.least(tags, F.lit(5)) / 5
    return plus - F.greatest(F.lit(0.0), (same_source - 1) * 0.03)


def diversity(sources: Column, clusters: Column) -> Column:
    return F.when(sources <= 1, F.lit(0.0)).otherwise(F.least(F.lit(1.0), sources / F.greatest(clusters, F.lit(2))))


def evidence_strength(evidence: Column, least: int, relevance: Column) -> Column:
    return F.least(F.lit(1.0), evidence / max(least, 1) * 0.5 + relevance * 0.5)


def burst(recent: Column, docs: Column, clusters: Column) -> Column:
    return F.least(F.lit(1.0), ratio(recent, docs) + F.least(clusters, F.lit(4)) * 0.08)


def signal_score(burst: Column, velocity: Column, acceleration: Column, coherence: Column, novelty: Column, diversity: Column, fresh: Column, evidence: Column, strength: Column) -> Column:
    return clamp(
        0.18 * burst + 0.14 * velocity + 0.10 * acceleration + 0.20 * coherence + 0.12 * novelty + 0.12 * diversity + 0.08 * fresh + 0.06 * evidence + 0.14 * strength
    )


def signal_stage(clusters: Column, docs: Column, sources: Column, score: Column, diversity: Column, recent_change: Column, velocity: Column, acceleration: Column, evidence: Column, idle: Column, blocked: Column, least_sources: int = 2) -> Column:
    """stable, emerging, fading or weak; ``idle``: last seen over ten days ago."""
    rising = recent_change | (velocity > 0)
    wide = (sources >= least_sources) & (diversity >= 0.2)
    stable = (clusters >= 2) & (docs >= 4) & wide & (score >= 0.58) & rising
    emerging = (score >= 0.42) & (evidence >= 2) & wide & (rising | (acceleration > 0))
    return (
        F.when((stable | emerging) & blocked, "weak")
        .when(stable, "stable")
        .when(emerging, "emerging")
        .when(idle | ((velocity <= 0) & ~recent_change), "fading")
        .otherwise("weak")
    )


def confidence(coherence: Column, evidence: Column, diversity: Column) -> Column:
    return F.least(F.lit(1.0), 0.45 * coherence + 0.30 * evidence + 0.25 * diversity)


def alert_reason(docs: Column, sources: Column, score: Column, recent_change: Column, strength: Column) -> Column:
    """Why a trend is worth an alert; null if it isn't."""
    enough = (docs >= 5) & (sources >= 3)
    return F.when(enough & (score >= 0.8), "high_score").when(enough & recent_change & (score >= 0.74) & (strength >= 0.7), "change_point")


def lifecycle(state: Column, touched: Column, idle_hours: Column, cooling: float = 48, archived: float = 336) -> Column:
    """The state of a cluster after a run: those that the run didn't touch cool down, then are archived."""
    return (
        F.when(touched, state).when(idle_hours > archived, "archived").when((idle_hours > cooling) & (state != "archived"), "cooling").otherwise(state)
    )


def fading(stage: Column, touched: Column, idle_hours: Column) -> Column:
    """The stage of a signal after a run: those that it didn't touch fade after seven days."""
    return F.when(~touched & (idle_hours > 168), "fading").otherwise(stage)


def external_strength(results: Column, most: int, hosts: Column, mean_score: Column) -> Column:
    """Coverage of a topic elsewhere: ``results`` of ``most`` asked for, from so many different hosts."""
    return F.least(F.lit(1.0), 0.55 * results / max(most, 1) + 0.30 * hosts / max(most, 1) + 0.15 * F.least(mean_score / 3, F.lit(1.0)))


def gap(external: Column, frequency: Column) -> Column:
    """How much of the outside coverage the own one lacks."""
    return F.greatest(F.lit(0.0), external - F.least(F.lit(1.0), frequency / 3.5))


#: Cues of first-of-April posts.
APRIL_CUES = (
    "april fool", "april fools", "1 april", "1st april", "first of april", "prank", "joke", "gotcha", "satire", "satirical", "hoax",
    "шутка", "розыгрыш", "первоапрель", "1 апреля", "первое апреля", "сатира",
)


def april_joke(published: Column, title: Column, content: Column) -> Column:
    """Published on 1 or 2 April (UTC) with a cue in the title or the first 800 characters."""
    low = F.lower(F.concat_ws(" ", title, F.left(content, F.lit(800))))
    cue = F.lit(False)
    for c in APRIL_CUES:
        cue = cue | low.contains(c)
    return (F.month(published) == 4) & (F.dayofmonth(published) <= 2) & cue


def april_penalty(share: Column, penalty: float = 0.45, block: float = 0.34) -> tuple[Column, Column]:
    """Multiplier of the score, and whether high stages are blocked."""
    return F.greatest(F.lit(0.0), 1 - share * min(1.0, max(0.0, penalty))), share >= block


def days_to_range(days: Column) -> Column:
    return F.when(days <= 1, "day").when(days <= 7, "week").when(days <= 31, "month").otherwise("year")
