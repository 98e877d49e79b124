"""Columns over raw pages, feed entries and untyped values: what needs a browser, bodies, cut texts, times, conversions, validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col, strip_tags, token_estimate

# Marks of pages that scripts fill.
EMPTY_ROOT = r"(?i)<(?:div|section)\s+id=[\"'](?:app|root)[\"'][^>]*>\s*</(?:div|section)>"
FRAMEWORKS = ("__NEXT_DATA__", "__NUXT__", "ng-version", "data-reactroot")
# What follows the end of a feed's article, and the gap between an article and its source line.
RECOMMENDED = r"近期热门视频你会关注[\s\S]+"
SOURCE_LINE = r"来源：[\s\S]*?文章原文"
CUT_MARK = "\n...[内容截断]...\n"
# Fixed value: the DNS name space of name-based UUIDs.
DNS_SPACE = "6ba7b8109dad11d180b400c04fd430c8"


def filled_by_script(html) -> Column:
    """Whether a page looks empty without its scripts: an empty root element, a framework's mark, or more than five scripts and fewer
    than 200 visible characters. Null: false."""
    page = F.coalesce(col(html), F.lit(""))
    low = F.lower(page)
    visible = F.trim(F.regexp_replace(F.regexp_replace(page, r"<[^>]+>", ""), r"\s+", " "))
    marked = page.rlike(EMPTY_ROOT)
    for name in FRAMEWORKS:
        marked = marked | low.contains(name.lower())
    return marked | ((F.regexp_count(low, F.lit("<script")) > 5) & (F.length(visible) < 200))


def needs_browser(html, least: int = 500) -> Column:
    return filled_by_script(html) | (F.length(F.coalesce(col(html), F.lit(""))) < least)


def strip_feed_noise(text) -> Column:
    """Text before recommendations, without the source line, at most one empty line in a row."""
    out = F.regexp_replace(F.regexp_replace(col(text), RECOMMENDED, ""), SOURCE_LINE, "")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def feed_body(content, summary) -> Column:
    """The first of content and summary that has text, without tags and noise; else empty."""
    chosen = [F.when(strip_tags(x) != "", strip_feed_noise(strip_tags(x))) for x in (content, summary)]
    return F.coalesce(*chosen, F.lit(""))


def article_address(content, link) -> Column:
    """The address by the two identifiers in the content, if both are there; else the link."""
    biz = F.rtrim(F.regexp_replace(F.regexp_extract(col(content), r"(?i)(?:biz|__biz)=([^&\"'<>]+)", 1), "=+$", ""))
    mid = F.regexp_extract(col(content), r"(?i)\bmid=([^&\"'<>]+)", 1)
    return F.when((biz != "") & (mid != ""), F.concat(F.lit("https://mp.weixin.qq.com/s?__biz="), biz, F.lit("&mid="), mid)).otherwise(col(link))


def body_or_description(body, description, least: int = 200) -> Column:
    """The description where the body is shorter than `least` and there is one."""
    return F.when((F.length(F.coalesce(col(body), F.lit(""))) < least) & (F.coalesce(col(description), F.lit("")) != ""), col(description)).otherwise(col(body))


def quarter_tokens(text) -> Column:
    return F.floor(F.length(F.coalesce(col(text), F.lit(""))) / 4).cast("long")


def truncate_at_sentence(text, most: int) -> Column:
    """Texts of more than `most` estimated tokens cut in proportion, then back to the last full stop or line end beyond 70 % of
    the cut; "..." marks the cut."""
    t, n = col(text), token_estimate(text)
    size = F.floor(F.length(t) * F.lit(most) / n).cast("int")
    cut = F.substring(t, F.lit(1), size)
    back = F.length(F.regexp_extract(cut, r"^([\s\S]*[。.\n])", 1))
    return F.when(n <= most, t).otherwise(F.concat(F.when(back - 1 > 0.7 * size, F.substring(cut, F.lit(1), back)).otherwise(cut), F.lit("...")))


def head_and_tail(text, most: int) -> Column:
    """Texts of more than `most` words: the first 70 % of so many words, a mark, and the last ones. Words are what blanks part."""
    words = F.split(col(text), " ")
    head = most * 7 // 10
    kept = F.concat(F.array_join(F.slice(words, 1, head), " "), F.lit(CUT_MARK), F.array_join(F.slice(words, -(most - head), most - head), " "))
    return F.when(F.size(words) > most, kept).otherwise(col(text))


def from_epoch(number) -> Column:
    """Time of seconds, or of milliseconds where the number is above 10**12; null stays null."""
    n = col(number).cast("double")
    return F.timestamp_micros(F.round(F.when(n > 1e12, n * 1000).otherwise(n * 1e6)).cast("long"))


def parse_iso(text) -> Column:
    """Time of an ISO text; null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(col(text)), "Z$", "+00:00"))


def name_uuid(name, space: str = DNS_SPACE) -> Column:
    """Version-5 UUID of a name: the same name always gives the same one."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), col(name).cast("binary")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def convert(value, source: str, target: str) -> Column:
    """A value of one store's type in another's: times as epoch milliseconds and back, JSON and arrays as text, numbers and booleans
    into each other, yes-words as booleans. What has no rule stays as it is; what cannot be read is null."""
    v, source, target = col(value), source.lower(), target.lower()
    whole, real, text = any(x in target for x in ("int", "epoch")), any(x in target for x in ("float", "double")), target in ("string", "varchar")
    if "timestamp" in source or "datetime" in source:
        return F.floor(F.unix_micros(v.cast("timestamp")) / 1000).cast("long") if "int64" in target or "epoch" in target else v
    if ("int64" in source or "epoch" in source) and ("timestamp" in target or "datetime" in target):
        return F.timestamp_millis(v.cast("long"))
    if source in ("list", "array", "json", "struct", "map") or source.endswith("[]"):
        return F.to_json(v) if text else v
    if "bool" in source:
        return v.cast("int") if whole else F.lower(v.cast("string")) if text else v
    if "bool" in target and source in ("string", "varchar"):
        return F.lower(v).isin("true", "1", "yes", "on")
    if whole:
        return (F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)) if any(x in source for x in ("float", "double", "decimal")) else v).try_cast("long")
    return v.try_cast("double") if real else v


def usage_field(field) -> Column:
    """struct(label, call_point, metric) of "label::call_point::metric", parted from the right; null where a part is missing."""
    parts = F.split(col(field), "::")
    n = F.size(parts)
    return F.when(n >= 3, F.struct(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(1))), "::").alias("label"), F.try_element_at(parts, n - 1).alias("call_point"), F.try_element_at(parts, n).alias("metric")))


def usage_label(label) -> Column:
    """struct(kind, provider, model) of "kind::provider::model" or "provider::model"; other labels are a model of an unknown provider."""
    parts = F.split(col(label), "::")
    n = F.size(parts)
    as_ = lambda kind, provider, model: F.struct(kind.alias("kind"), provider.alias("provider"), model.alias("model"))
    at = lambda k: F.try_element_at(parts, F.lit(k))
    return F.when(n == 3, as_(at(1), at(2), at(3))).when(n == 2, as_(F.lit("chat"), at(1), at(2))).otherwise(as_(F.lit("chat"), F.lit("unknown"), col(label)))


def faults(rules: dict[str, Column]) -> Column:
    """Names of the rules (conditions for a good row) that a row breaks, in order; a condition that is null is broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def article_rules(title, body, score, quality) -> dict[str, Column]:
    """What a row must hold: a title of 1 to 500 characters, a body, scores from 0 to 1 (none counts as .5)."""
    n = F.length(F.trim(col(title)))
    share = lambda x: F.coalesce(col(x), F.lit(0.5)).between(0, 1)
    return {"title": n.between(1, 500), "body": F.length(F.trim(col(body))) >= 1, "score": share(score), "quality": share(quality)}


def safe_name(name, kind: str = "column") -> Column:
    """Whether a name may stand in a statement: letters, digits and underscores, not a digit first; a label or edge type in capitals too."""
    pattern = {"column": r"^[A-Za-z_][A-Za-z0-9_]*$", "label": r"^[A-Z][A-Za-z0-9_]*$", "edge": r"^[A-Z][A-Z0-9_]*$", "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"}[kind]
    return F.coalesce(col(name).rlike(pattern), F.lit(False))


def included(item, wanted: str | None) -> Column:
    """Whether a section is asked for by a comma list; none or "all": every section."""
    if wanted is None or wanted.lower() == "all":
        return F.lit(True)
    return F.lower(col(item)).isin(*{x.strip().lower() for x in wanted.split(",")})


def script_sort_key(normal: Column) -> Column:
    """Key that sorts Latin names first, Han names last, by a normal_name() struct."""
    first = F.when(normal["script"] == "chinese", "z_").when(normal["script"] == "english", "a_").otherwise("m_")
    return F.concat(first, F.lower(normal["normalized"]))
