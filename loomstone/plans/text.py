"""Scalar functions and URL checks over pages, documents and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from .registry import Registry, table

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL

_URL = "regexp_replace(regexp_replace(regexp_replace(trim(url), '^//', 'https://'), '[?#].*$', ''), '^[hH][tT][tT][pP][sS]?://', '')"
_NORM = f"'https://' || regexp_replace(regexp_replace(lower(regexp_extract({_URL}, '^([^/]*)', 1)), '^www\\.|:(80|443)$', ''), ':(80|443)$', '') || regexp_replace(regexp_replace(regexp_extract({_URL}, '^[^/]*(.*)$', 1), '/+', '/', 'g'), '/$', '')"


@R.frame("X1_normalize_url", f"SELECT page_id, {_NORM} AS normal FROM pages")
def x1(spark, d):
    return table(spark, d, "pages").select("page_id", C.normalize_url("url").alias("normal"))


@R.frame("X2_url_hash", f"SELECT page_id, left(sha256({_NORM}), 16) AS h FROM pages")
def x2(spark, d):
    return table(spark, d, "pages").select("page_id", C.short_hash(C.normalize_url("url")).alias("h"))


@R.frame("X3_text_key", "SELECT doc_id, left(sha256(text), 32) AS k FROM documents")
def x3(spark, d):
    return table(spark, d, "documents").select("doc_id", C.short_hash("text", 32).alias("k"))


@R.frame("X5_host", "SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) AS host FROM pages")
def x5(spark, d):
    return table(spark, d, "pages").select("page_id", C.url_host("url").alias("host"))


@R.frame("X6_strip_tags", "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS body FROM pages")
def x6(spark, d):
    return table(spark, d, "pages").select("page_id", C.strip_tags("html").alias("body"))


@R.frame("X12_script", "SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') THEN 'chinese' WHEN regexp_matches(text, '[A-Za-z]') THEN 'english' ELSE 'other' END AS script FROM documents")
def x12(spark, d):
    return table(spark, d, "documents").select("doc_id", C.script_of("text").alias("script"))


@R.frame("X20_token_estimate", "SELECT doc_id, CAST(len(regexp_extract_all(t, '[一-鿿]')) + (length(t) - len(regexp_extract_all(t, '[一-鿿]'))) // 4 AS BIGINT) AS tokens FROM (SELECT doc_id, repeat('中文 and 例', doc_id % 5) || text AS t FROM documents)")
def x20(spark, d):
    mixed = F.concat(F.expr("repeat('中文 and 例', CAST(doc_id % 5 AS INT))"), "text")
    return table(spark, d, "documents").select("doc_id", C.token_estimate(mixed).alias("tokens"))


@R.frame("X24_snippet", "SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '…' ELSE text END AS snippet FROM documents")
def x24(spark, d):
    return table(spark, d, "documents").select("doc_id", C.snippet("text").alias("snippet"))


@R.frame("X25_tokenize", "SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')) AS BIGINT) AS n FROM documents")
def x25(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(C.tokens("text")).cast("long").alias("n"))


@R.frame("X27_decay", "SELECT event_id, round(exp(-0.023104906018664842 * greatest(0, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 86400000000.0)), 9) AS weight FROM events")
def x27(spark, d):
    e = table(spark, d, "events")
    newest = e.agg(F.max("ts").alias("newest"))
    return e.crossJoin(F.broadcast(newest)).select("event_id", F.round(C.decay(C.age_days("ts", F.col("newest")), 30.0), 9).alias("weight"))  # newest is one row


@R.frame("X28_timeliness", "SELECT o_orderkey, l_linenumber, CASE WHEN a IS NULL THEN 0.7 WHEN a <= 6 THEN 1.0 WHEN a <= 24 THEN 0.85 WHEN a <= 72 THEN 0.65 WHEN a <= 168 THEN 0.45 ELSE 0.3 END::DOUBLE AS score FROM (SELECT o_orderkey, l_linenumber, abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3600000000.0 AS a FROM orders JOIN lineitem ON l_orderkey = o_orderkey)")
def x28(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("o_orderkey", "l_linenumber", C.timeliness("l_shipdate", "o_orderdate").alias("score"))


@R.frame("X32_cosine", "SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def x32(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(C.cosine("embedding", "q"), 6).alias("similarity"))  # q is one row


@R.frame("X34_hamming", "SELECT event_id, CAST(bit_count(xor(event_id, user_id)) AS INTEGER) AS bits FROM events")
def x34(spark, d):
    return table(spark, d, "events").select("event_id", C.hamming("event_id", "user_id").cast("int").alias("bits"))


@R.frame("X36_keyword_overlap", "SELECT doc_id, (CAST(contains(lower(text), 'tion') AS INTEGER) + CAST(contains(lower(text), 'der') AS INTEGER)) / 2.0::DOUBLE AS overlap FROM documents")
def x36(spark, d):
    return table(spark, d, "documents").select("doc_id", C.keyword_overlap("text", ["tion", "der"]).alias("overlap"))


@R.frame("X37_backoff", "SELECT event_id, CAST(60 * power(2, event_id % 5) AS BIGINT) AS wait FROM events WHERE event_type = 'error'")
def x37(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").select("event_id", C.backoff_seconds(F.col("event_id") % 5).alias("wait"))


@R.frame("X38_json_parse", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def x38(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def _redacted() -> str:
    out = "text"
    for pattern, put in C.SECRETS:
        quoted, put = pattern.replace("'", "''"), put.replace("$", "\\")
        out = f"regexp_replace({out}, '{quoted}', '{put}', 'g')"
    return out


@R.frame("X39_redact", f"SELECT doc_id, {_redacted()} AS text FROM documents")
def x39(spark, d):
    return table(spark, d, "documents").select("doc_id", C.redact("text").alias("text"))


@R.frame("X42_status_label", "SELECT s_suppkey, CASE WHEN s_acctbal / 100 >= 80 THEN 'healthy' WHEN s_acctbal / 100 >= 60 THEN 'moderate' WHEN s_acctbal / 100 >= 40 THEN 'degraded' ELSE 'critical' END AS status FROM supplier")
def x42(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", C.status_label(F.col("s_acctbal") / 100).alias("status"))


_HOST = "regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)), ':[0-9]*$', '')"
_PORT = "coalesce(try_cast(regexp_extract(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1), ':([0-9]+)$', 1) AS INTEGER), 0)"
# Fixed values, written apart from those that the functions use.
LISTED = ["login", "signin", "sign-in", "verify", "verification", "secure", "security", "account", "update", "confirm", "password", "credential", "auth", "authenticate",
          "banking", "wallet", "payment", "transaction", "phishing", "scam", "fraud", "suspended", "locked", "alert", "warning", "urgent", "limited", "expire"]
_WORDS = " + ".join(f"contains(lower(p), '{w}')::INTEGER" for w in LISTED)
_RISK = f"""WITH u AS (SELECT page_id, u, {_HOST} AS host, {_PORT} AS port, url_decode(replace(u, '+', '%2B')) AS p FROM (SELECT page_id, coalesce(url, '') AS u FROM pages)),
c AS (SELECT *, string_split(host, '.') AS labels, {_WORDS} AS words FROM u),
o AS (SELECT *, (len(labels) > 5)::INTEGER + (len(list_filter(labels, lambda x: length(x) > 63)) > 0)::INTEGER + (length(host) - length(replace(host, '-', '')) > 5)::INTEGER + contains(host, 'xn--')::INTEGER + regexp_matches(labels[1], '^[0-9]+$')::INTEGER AS odd FROM c),
r AS (SELECT page_id, CASE WHEN NOT regexp_matches(lower(u), '^https?://') OR host = '' OR host IN {C.METADATA_HOSTS} OR regexp_matches(host, '{C.BLOCKED_V4}') OR regexp_matches(host, '{C.BLOCKED_V6}') THEN 4 ELSE 0 END AS address,
 CASE WHEN contains(p, '%') THEN 2 WHEN regexp_matches(lower(u), '%00|%0d|%0a|%2e%2e|%25') THEN 3 ELSE 0 END AS encoding, CASE WHEN words >= 3 THEN 3 WHEN words >= 1 THEN 2 ELSE 0 END AS words,
 CASE WHEN host IN {C.SHORTENERS} THEN 1 WHEN odd >= 2 THEN 3 WHEN odd = 1 THEN 2 ELSE 0 END AS domain, CASE WHEN port IN {C.SUSPICIOUS_PORTS} THEN 3 WHEN port > 49151 THEN 2 ELSE 0 END AS port,
 CASE WHEN length(u) > 2000 THEN 2 WHEN length(u) > 1000 THEN 1 ELSE 0 END AS length FROM o)"""


@R.frame("V1_url_risk", f"{_RISK} SELECT page_id, greatest(address, encoding, words, domain, port, length) AS risk FROM r")
def v1(spark, d):
    return table(spark, d, "pages").select("page_id", C.url_risk("url").alias("risk"))


@R.frame("V2_url_checks", f"{_RISK} SELECT * FROM r")
def v2(spark, d):
    return table(spark, d, "pages").select("page_id", *(c.alias(n) for n, c in C.url_checks("url").items()))


@R.frame("D1_url_dedup", f"SELECT normal, min(page_id) AS page_id, count(*) AS n FROM (SELECT page_id, {_NORM} AS normal FROM pages) GROUP BY normal")
def d1(spark, d):
    return table(spark, d, "pages").select("page_id", C.normalize_url("url").alias("normal")).groupBy("normal").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))
