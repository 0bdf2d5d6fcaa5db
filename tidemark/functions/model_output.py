"""Reading what language models return: JSON in prose, categories, concepts and valences."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F

#: Other names of categories.
ALIASES = {
    "tech": "technology",
    "it": "technology",
    "technologies": "technology",
    "технологии": "technology",
    "техника": "technology",
    "информационные_технологии": "technology",
    "business": "business_models",
    "бизнес": "business_models",
    "biz": "business_models",
    "стартап": "business_models",
    "стартапы": "business_models",
    "модель": "business_models",
    "дизайн": "design",
    "ux": "design",
    "ui": "design",
    "наука": "science",
    "исследования": "science",
    "общество": "society",
    "социум": "society",
    "social": "society",
}
#: Words for no known category.
OTHER = ("other", "другое", "прочее", "misc", "none", "неизвестно", "не_определено", "иное")
CATEGORIES = ("technology", "business_models", "design", "regulation", "market", "science", "other")


def extract_json(text: str | None) -> str | None:
    """The first JSON object in a text: fences dropped, trailing commas forgiven."""
    body = re.sub(r"```(?:json)?", "", text or "")
    start = body.find("{")
    while start >= 0:
        depth, quoted, i = 0, False, start
        while i < len(body):
            c = body[i]
            if quoted:
                if c == "\\":
                    i += 1
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c in "{[":
                depth += 1
            elif c in "}]":
                depth -= 1
                if depth == 0:
                    break
            i += 1
        piece = re.sub(r",\s*([}\]])", r"\1", body[start : i + 1])
        try:
            return json.dumps(json.loads(piece), ensure_ascii=False, sort_keys=True)
        except ValueError:
            start = body.find("{", start + 1)
    return None


def slug(value: str) -> str:
    """Lower case, blanks and hyphens as underscores, nothing but letters of two scripts, digits and underscores."""
    joined = re.sub(r"[\s\-]+", "_", value.strip().lower())
    return re.sub(r"[^a-z0-9а-яё_]", "", joined).strip("_")


def category(value: str | None, cutoff: float = 0.76, known: tuple[str, ...] = CATEGORIES) -> str:
    """One of the ``known`` categories for what a model wrote: by its slug, another name, or likeness; else ``other``."""
    named = {slug(k): k for k in known if k.strip()}
    wanted = slug(value or "")
    if not wanted or wanted in OTHER:
        return "other"
    for key in (wanted, ALIASES.get(wanted)):
        if key in named:
            return named[key]
    near = difflib.get_close_matches(wanted, list(named), 1, cutoff)
    return named[near[0]] if near else "other"


def _series(function):
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([function(x) for x in batch], dtype=object)

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")


def json_column(text: Column) -> Column:
    return _series(extract_json)(text)


def category_column(value: Column) -> Column:
    return _series(category)(value)


def valence(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin("positive", "negative", "neutral"), low).otherwise("neutral")


#: Kinds of signals.
SIGNAL_TYPES = (
    "growth", "failure", "launch", "closure", "regulation", "adoption", "rejection", "delay", "recall", "lawsuit", "partnership", "investment", "policy", "other",
)


def signal_type(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin(*SIGNAL_TYPES), low).otherwise("other")


def confidence(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(0.0))))


def valid_concepts(concepts: Column, most: int = 10) -> Column:
    """Concepts with names, cut to 100 and 50 characters, weights within 1 to 5, heaviest first."""
    named = F.filter(concepts, lambda c: F.length(F.trim(c["name"])) > 0)
    clean = F.transform(
        named,
        lambda c: F.struct(
            (-F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(c["weight"], F.lit(1))))).alias("w"), F.left(F.trim(c["name"]), F.lit(100)).alias("name"), F.left(F.coalesce(c["category"], F.lit("other")), F.lit(50)).alias("category")
        ),
    )
    return F.transform(F.slice(F.array_sort(clean), 1, most), lambda c: F.struct(c["name"].alias("name"), c["category"].alias("category"), (-c["w"]).alias("weight")))
