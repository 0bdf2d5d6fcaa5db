"""What a search question asks for, read from its words."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Parts of words that tell the region, the kind of signal or doubt.
RUSSIA = ("ru", "russia", "russian", "россия", "россии", "россий", "российский", "русск")
WORLD = ("global", "world", "worldwide", "международ", "глобальн")
COUNTER = (
    "risk", "failure", "failed", "closure", "delay", "recall", "lawsuit", "ban", "reject", "ризик", "риск", "провал", "закрыт", "задерж", "отзыв", "суд", "запрет",
)
SIGNAL_TYPES = {
    "regulation": ("regulation", "regulatory", "law", "policy", "закон", "регулир", "политик"),
    "adoption": ("adoption", "adopt", "rollout", "внедрен", "приняти"),
    "growth": ("growth", "scale", "rising", "surge", "рост", "растет", "масштаб"),
    "investment": ("investment", "funding", "raise", "инвест", "финансир"),
    "partnership": ("partnership", "partner", "deal", "партнер", "сделк"),
    "launch": ("launch", "release", "announce", "запуск", "релиз", "анонс"),
}
#: Words for spans of time and their days; a number of days goes before.
SPANS = ((("today", "сегодня"), 1), (("week", "недел"), 7), (("month", "месяц"), 30), (("quarter", "квартал"), 90))
DAYS = r"\b(?:last|за)?\s*(\d{1,3})\s*(?:d|day|days|дн)"


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def parse(text: Column, days: Column, region: Column | None = None, entities: Column | None = None) -> dict[str, Column]:
    """``days`` and ``region`` are what the request says beside the question; what it names of a region goes first."""
    low = F.lower(text)
    region = F.lit(None).cast("string") if region is None else region
    found = F.coalesce(region, F.when(_holds(low, RUSSIA), "ru").when(_holds(low, WORLD), "global"))
    reason = F.when(region.isNotNull(), "explicit_request").when(found == "ru", "query_mentions_russia").when(found == "global", "query_mentions_global_scope").otherwise("")
    kinds = F.array_compact(F.array(*[F.when(_holds(low, words), kind) for kind, words in SIGNAL_TYPES.items()]))
    number = F.regexp_extract(low, DAYS, 1).try_cast("int")
    back = F.when(number.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(365), number)))
    for words, n in SPANS:
        back = back.when(_holds(low, words), n)
    back = back.otherwise(days)
    counter = _holds(low, COUNTER)
    sure = (
        F.lit(0.35) + F.when(found.isNotNull(), 0.15).otherwise(0.0) + F.when(F.size(kinds) > 0, 0.2).otherwise(0.0) + F.when(counter, 0.15).otherwise(0.0)
        + (F.lit(0.0) if entities is None else F.when(F.size(entities) > 0, 0.1).otherwise(0.0)) + F.when(~back.eqNullSafe(days), 0.05).otherwise(0.0)
    )
    return {
        "source_region": found, "region_reason": reason, "days_back": back, "signal_types": F.slice(kinds, 1, 3), "wants_counter": counter,
        "confidence": F.round(F.least(sure, F.lit(0.95)), 2),
    }
