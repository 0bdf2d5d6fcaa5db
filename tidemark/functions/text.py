"""Text, URL and id expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Query parameters that only track, by prefix.
TRACKED_PREFIXES = ("utm_", "rss", "ref", "source", "fbclid", "gclid")
#: Hosts whose links are not followed, with or without ``www.``.
SOCIAL_HOSTS = ("t.me", "telegram.me", "telegram.dog", "twitter.com", "x.com")
#: Query parameters, parts of hosts and hosts that results of a search may not have.
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "source", "spm", "yclid", "_ga")
BLOCKED_PARTS = ("1337x", "casino", "porn", "torrent", "xvideos", "xnxx")
PRIVATE_HOSTS = (
    "127.0.0.1", "0.0.0.0", "admin", "crawl4ai", "localhost", "neo4j", "postgres", "qdrant", "redis", "searxng", "worker", "xray",
)
#: Addresses of private, local or reserved networks.
PRIVATE_ADDRESS = (
    r"^((0|10|127|2[4-9]\d)\.\d+|192\.168|169\.254|172\.(1[6-9]|2\d|3[01])|198\.1[89])\.\d+\.\d+$"
    r"|^(192\.0\.[02]|198\.51\.100|203\.0\.113)\.\d+$"
)
TERM = r"[A-Za-zА-Яа-я0-9][A-Za-zА-Яа-я0-9\-_]{2,}"
URL = r"https?://[^\s<>\"'\)\]]+"
_NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def digest(value: Column, prefix: str) -> Column:
    """``prefix:`` and the first 16 hex digits of the SHA-1."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha1(value), 1, 16))


def uuid5_url(value: Column) -> Column:
    """Version-5 UUID of a string in the URL namespace."""
    raw = F.sha1(F.concat(F.unhex(F.lit(_NAMESPACE_URL)), F.encode(value, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(raw, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(
        F.substring(raw, 1, 8), F.lit("-"), F.substring(raw, 9, 4), F.lit("-5"), F.substring(raw, 14, 3), F.lit("-"),
        variant, F.substring(raw, 18, 3), F.lit("-"), F.substring(raw, 21, 12),
    )


def terms(text: Column) -> Column:
    """Lower-cased words of three characters or more, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def compact(text: Column) -> Column:
    """White space collapsed to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def preview(text: Column, n: int) -> Column:
    """Tags stripped, white space collapsed, cut to ``n`` characters."""
    return F.left(compact(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " ")), F.lit(n))


def urls(text: Column, limit: int | None = 10) -> Column:
    """The first different URLs whose hosts are not social ones, trailing punctuation removed; all without a limit."""
    found = F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))
    kept = F.filter(found, lambda u: ~host(u).isin(*SOCIAL_HOSTS))
    every = F.array_distinct(kept)
    return every if limit is None else F.slice(every, 1, limit)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def host(url: Column) -> Column:
    """Host in lower case without a leading ``www.``; empty if there is none."""
    return F.regexp_replace(_host(url), r"^www\.", "")


def netloc(url: Column) -> Column:
    """Host in lower case with its ``www.`` and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))


def _query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def _tracked(pair: Column) -> Column:
    name = F.lower(F.split_part(pair, F.lit("="), F.lit(1)))
    out = F.lit(False)
    for prefix in TRACKED_PREFIXES:
        out = out | name.startswith(prefix)
    return out


def _rebuilt(base: Column, pairs: Column) -> Column:
    joined = F.array_join(pairs, "&")
    return F.when(joined == "", base).otherwise(F.concat(base, F.lit("?"), joined))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, tracking parameters and the fragment dropped."""
    head = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    pairs = F.filter(F.split(_query(url), "&"), lambda p: (p != "") & ~_tracked(p))
    return _rebuilt(F.concat(head, path), pairs)


def crawl_url(url: Column) -> Column:
    """All in lower case, parameters sorted, fragment dropped."""
    low = F.lower(F.trim(url))
    base = F.regexp_extract(low, r"^([^?#]*)", 1)
    return _rebuilt(base, F.array_sort(F.filter(F.split(_query(low), "&"), lambda p: p != "")))


def safe_url(url: Column) -> Column:
    """A search result's URL without tracking, empty parameters, fragment and trailing slash; null if it isn't
    http(s), or its host is private or blocked."""
    raw, h = F.trim(url), _host(F.trim(url))
    blocked = h.isin(*PRIVATE_HOSTS) | h.rlike(PRIVATE_ADDRESS)
    for part in BLOCKED_PARTS:
        blocked = blocked | h.contains(part)
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z]+)://", 1))
    path = F.regexp_replace(F.regexp_extract(raw, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    base = F.concat(scheme, F.lit("://"), F.regexp_extract(raw, r"^[A-Za-z]+://([^/?#]*)", 1), F.when(path == "", "/").otherwise(path))

    def kept(pair: Column) -> Column:
        name = F.lower(F.split_part(pair, F.lit("="), F.lit(1)))
        return pair.rlike("^[^=]+=.") & ~name.startswith("utm_") & ~name.isin(*TRACKING_KEYS)

    return F.when(scheme.isin("http", "https") & (h != "") & ~blocked, _rebuilt(base, F.filter(F.split(_query(raw), "&"), kept)))


def external_id(guid: Column, url: Column, title: Column, published: Column) -> Column:
    """The feed's id, else the canonical URL, else a digest of title and time."""
    made = F.sha2(F.concat_ws("|", F.coalesce(title, F.lit("")), F.coalesce(published.cast("string"), F.lit(""))), 256)
    return F.coalesce(F.nullif(F.trim(guid), F.lit("")), F.nullif(canonical_url(url), F.lit("")), made)


def detected_language(text: Column) -> Column:
    """``ru`` if the first 300 characters hold a Cyrillic letter, else ``en``; ``unknown`` if there is no text."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(body == "", "unknown").when(F.left(body, F.lit(300)).rlike("[\u0400-\u04FF]"), "ru").otherwise("en")


def passes_keywords(text: Column, include: list[str], exclude: list[str]) -> Column:
    """Some word of ``include`` (if any are given) and none of ``exclude`` occurs."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(True)
    if include:
        some = F.lit(False)
        for k in include:
            some = some | low.contains(k.lower())
        out = some
    for k in exclude:
        out = out & ~low.contains(k.lower())
    return out


def passes_language(lang: Column, allowed: list[str]) -> Column:
    """A null language passes."""
    return lang.isNull() | F.lower(lang).isin(*[x.lower() for x in allowed]) if allowed else F.lit(True)


def parsed_time(value: Column) -> Column:
    """ISO 8601, RFC 822, day-only and epoch-second times; null if none fits."""
    text = F.trim(value)
    epoch = F.when(text.rlike(r"^\d{9,11}$"), F.timestamp_seconds(text.try_cast("bigint")))
    forms = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "EEE, d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd"]
    return F.coalesce(epoch, *[F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3}, ", "") if "EEE" in f else text, F.lit(f.replace("EEE, ", ""))) for f in forms])
