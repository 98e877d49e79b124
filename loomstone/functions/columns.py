"""Scalar functions as Column expressions: URLs, text, tokens, time, vectors, redaction, risk. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_url(url) -> Column:
    """https for http, lower-case host without www. and default port, . and .. resolved, escapes decoded and written anew, no query,
    fragment or trailing slash. A root with a slash ends in the host, one without ends in "/.". On mp.weixin.qq.com the parameters
    __biz and mid stay: they name the article. Malformed escapes are taken as they are. Null: null."""
    u = F.regexp_replace(F.trim(col(url)), r"^//", "https://")
    old = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    rest = F.regexp_replace(rest, r"[?#].*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/]*)", 1)), r"^www\.", "")
    host = F.when(old == "http", F.regexp_replace(host, r":80$", "")).otherwise(F.regexp_replace(host, r":443$", ""))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/]*(.*)$", 1), r"\+", "%2B")
    path = F.coalesce(F.try_url_decode(path), path)
    step = lambda kept, p: F.when(p.isin("", "."), kept).when(p == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(p)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    lead = F.when(path.rlike(r"^//([^/]|$)"), "//").otherwise("/")
    clean = F.when(path == "", "/.").otherwise(F.regexp_replace(F.concat(lead, F.array_join(parts, "/")), r"/+$", ""))
    quoted = F.url_encode(clean)
    for spelled, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        quoted = F.replace(quoted, F.lit(spelled), F.lit(plain))
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: p.startswith("__biz=") | p.startswith("mid=")), "&")
    scheme = F.when(old.isin("http", ""), "https").otherwise(old)
    return F.concat(scheme, F.lit("://"), host, quoted, F.when((host == "mp.weixin.qq.com") & (kept != ""), F.concat(F.lit("?"), kept)).otherwise(""))


def short_hash(x, digits: int = 16) -> Column:
    return F.substring(F.sha2(col(x).cast("binary"), 256), 1, digits)


def url_host(url) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^[A-Za-z]+://([^/?#]+)", 1))


def strip_tags(html) -> Column:
    """Tags out, seven character references decoded, white space collapsed."""
    t = F.regexp_replace(col(html), r"<[^>]+>", " ")
    for name, text in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(text))
    return F.trim(F.regexp_replace(t, r"[ \t\n\r\f]+", " "))


def token_estimate(text) -> Column:
    """One for each CJK character, one for four others."""
    han = F.length(col(text)) - F.length(F.regexp_replace(col(text), r"[\x{4e00}-\x{9fff}]", ""))
    return (han + F.floor((F.length(col(text)) - han) / 4)).cast("long")


def script_of(text) -> Column:
    han, latin = col(text).rlike(r"[\x{4e00}-\x{9fff}]"), col(text).rlike(r"[A-Za-z]")
    return F.when(han & latin, "mixed").when(han, "chinese").when(latin, "english").otherwise("other")


def snippet(text, n: int = 500) -> Column:
    return F.when(F.length(col(text)) > n, F.concat(F.substring(col(text), 1, n), F.lit("…"))).otherwise(col(text))


def age_days(ts, now: Column) -> Column:
    """Never below 0; no time: 0."""
    seconds = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(col(ts).cast("timestamp"))) / 1e6
    return F.coalesce(F.greatest(F.lit(0.0), seconds / 86400), F.lit(0.0))


def decay(age: Column, half_life: float) -> Column:
    """exp(-ln 2 / half_life * age); 1 where the half-life is no positive number or the age is not finite or negative."""
    if not half_life > 0 or math.isinf(half_life):
        return F.lit(1.0)
    fine = (age >= 0) & (age < F.lit(float("inf")))
    return F.when(fine, F.exp(-F.lit(math.log(2) / half_life) * age)).otherwise(1.0)


def timeliness(published, happened) -> Column:
    """1 within 6 hours between the event and its report, then .85 (24), .65 (72), .45 (168), .30; .7 where a time is unknown."""
    apart = F.abs(F.unix_micros(col(published).cast("timestamp")) - F.unix_micros(col(happened).cast("timestamp"))) / 3.6e9
    return F.when(apart.isNull(), 0.7).when(apart <= 6, 1.0).when(apart <= 24, 0.85).when(apart <= 72, 0.65).when(apart <= 168, 0.45).otherwise(0.3)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(col(a), lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a, b) -> Column:
    """0 where a vector is null, empty or zero."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def hamming(a, b) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def tokens(text) -> Column:
    """Lower-cased words; punctuation parts them."""
    return F.filter(F.split(F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def keyword_overlap(text, words: list[str]) -> Column:
    found = sum((F.lower(col(text)).contains(w.lower()).cast("int") for w in words), F.lit(0))
    return found / float(max(1, len(words)))


def backoff_seconds(attempt) -> Column:
    return (F.lit(60) * F.pow(F.lit(2), col(attempt))).cast("long")


# What a secret looks like, and what takes its place.
SECRETS = (
    (r"(?i)(postgresql(?:\+[a-z]+)?://[^:]+:)([^@]+)(@.+)", "$1***$3"),
    (r"(?i)(redis://[^:]+:)([^@]+)(@.+)", "$1***$3"),
    (r"(?i)(bolt://[^:]+:)([^@]+)(@.+)", "$1***$3"),
    (r"(?i)([?&]api[_-]?key=)([^&]+)", "$1***"),
    (r"(?i)(password[\"']?\s*[=:]\s*[\"']?)([^\"'\s,]+)", "$1***"),
    (r"(?i)(token[\"']?\s*[=:]\s*[\"']?)([^\"'\s,]+)", "$1***"),
    (r"(?i)(secret[\"']?\s*[=:]\s*[\"']?)([^\"'\s,]+)", "$1***"),
)


def redact(text) -> Column:
    out = col(text)
    for pattern, put in SECRETS:
        out = F.regexp_replace(out, pattern, put)
    return out


def status_label(score) -> Column:
    return F.when(col(score) >= 80, "healthy").when(col(score) >= 60, "moderate").when(col(score) >= 40, "degraded").otherwise("critical")


# Words, ports and shorteners of suspicious addresses, and hosts that must not be called.
SUSPICIOUS_WORDS = (
    "login", "signin", "sign-in", "verify", "verification", "secure", "security", "account", "update", "confirm", "password", "credential", "auth", "authenticate", "banking", "wallet", "payment", "transaction", "phishing", "scam", "fraud", "suspended", "locked", "alert", "warning", "urgent", "limited", "expire",
)
SUSPICIOUS_PORTS = (22, 23, 445, 3389, 4444, 5555, 6667)
SHORTENERS = ("bit.ly", "goo.gl", "tinyurl.com", "t.co", "is.gd", "buff.ly", "ow.ly", "short.link", "dlvr.it", "cutt.ly")
METADATA_HOSTS = ("metadata.google.internal", "metadata", "169.254.169.254", "100.100.100.200")
BLOCKED_V4 = r"^(10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|169\.254\.|127\.|0\.|22[4-9]\.|2[3-5]\d\.)[\d.]+$"
BLOCKED_V6 = r"^\[(::1|::|fe[89ab][0-9a-f]?:.*|f[cd][0-9a-f]{0,2}:.*)\]$"
RISKS = ("safe", "low", "medium", "high", "blocked")


def _level(*tests) -> Column:
    """The level of the first test that holds, else 0."""
    out = None
    for test, level in tests:
        out = F.when(test, level) if out is None else out.when(test, level)
    return out.otherwise(0)


def url_checks(url) -> dict[str, Column]:
    """Level of each check: 0 safe, 1 low, 2 medium, 3 high, 4 blocked. Names are not looked up in the network. Null: blocked scheme."""
    u = F.coalesce(col(url), F.lit(""))
    address = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    host = F.regexp_replace(F.lower(address), r":\d*$", "")
    port = F.coalesce(F.regexp_extract(address, r":(\d+)$", 1).try_cast("int"), F.lit(0))
    plain = F.coalesce(F.try_url_decode(F.regexp_replace(u, r"\+", "%2B")), u)
    labels = F.split(host, r"\.")
    words = sum(F.lower(plain).contains(w).cast("int") for w in SUSPICIOUS_WORDS)
    odd = sum(t.cast("int") for t in (F.size(labels) > 5, F.exists(labels, lambda p: F.length(p) > 63), F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))) > 5, host.contains("xn--"), labels[0].rlike(r"^\d+$")))
    return {
        "address": _level((~F.lower(u).rlike(r"^https?://") | (host == "") | host.isin(*METADATA_HOSTS) | host.rlike(BLOCKED_V4) | host.rlike(BLOCKED_V6), 4)),
        "encoding": _level((plain.contains("%"), 2), (F.lower(u).rlike(r"%00|%0d|%0a|%2e%2e|%25"), 3)),
        "words": _level((words >= 3, 3), (words >= 1, 2)),
        "domain": _level((host.isin(*SHORTENERS), 1), (odd >= 2, 3), (odd == 1, 2)),
        "port": _level((port.isin(*SUSPICIOUS_PORTS), 3), (port > 49151, 2)),
        "length": _level((F.length(u) > 2000, 2), (F.length(u) > 1000, 1)),
    }


def url_risk(url) -> Column:
    """The worst level of all checks (RISKS names the levels)."""
    return F.greatest(*url_checks(url).values())
