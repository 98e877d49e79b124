"""Taking rows in: duplicates by address and title, retries, lists of bad addresses, authorities, field mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import backoff_seconds, col, url_host
from ..sources.tables import discard, written


def expire(entries: DataFrame, now: Column, seen: str = "seen", days: int = 7) -> DataFrame:
    """Entries seen within `days`; those whose time is older, or missing, go."""
    return entries.where(F.col(seen) >= now - F.expr(f"INTERVAL {days} DAYS"))


def new_rows(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not null and not among the known ones, one for each key (anti join; the known side is never collected)."""
    return rows.where(F.col(key).isNotNull()).dropDuplicates([key]).join(known.select(key).distinct(), key, "left_anti")


def _once(value: Column, use) -> Column:
    """use(value) with the value taken once a row: a lambda's variable holds it, where an expression would be taken anew at every place and step."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def title_fingerprint(title, gram: int = 4) -> Column:
    """64-bit SimHash of the letters and digits of a title by character n-grams: each bit is set where more grams' hashes have it than
    not. Null and empty: 0. Word, grams and votes are made once a title."""
    word = F.regexp_replace(F.lower(F.coalesce(col(title), F.lit(""))), r"[^\p{L}\p{N}]+", "")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def hashes(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (gram - 1), F.lit(1))), lambda k: F.xxhash64(F.substring(w, k, F.lit(gram))))
        return F.when(w == "", F.array().cast("array<bigint>")).otherwise(each)

    def majority(grams: Column) -> Column:
        votes = F.aggregate(grams, F.array_repeat(F.lit(0), 64), lambda acc, h: F.transform(acc, lambda v, k: v + F.call_function("shiftright", h, k).bitwiseAND(one).cast("int")))
        bits = lambda v: F.transform(v, lambda x, k: F.when(x * 2 > F.size(grams), F.call_function("shiftleft", one, k)).otherwise(zero))
        return _once(votes, lambda v: F.aggregate(bits(v), zero, lambda a, b: a.bitwiseOR(b)))

    return _once(_once(word, hashes), majority)


def bands(fp, parts: int = 4) -> Column:
    """(number, value) of each 16-bit part of a fingerprint: two that differ in fewer bits than there are parts share one."""
    return F.array(*[F.struct(F.lit(k).alias("number"), F.shiftrightunsigned(col(fp), 16 * k).bitwiseAND(F.lit(0xFFFF)).alias("value")) for k in range(parts)])


def near_pairs(rows: DataFrame, fp: str = "fp", bits: int = 3) -> DataFrame:
    """(a, b), a < b: distinct fingerprints within `bits` (at most 3) bits, joined by their parts and verified.

    All links are asked for, so very many fingerprints close to each other give very many pairs; greedy_keep() does not need them.
    """
    if not 0 <= bits <= 3:
        raise ValueError("four parts find every pair within 3 bits")
    cut = rows.select(fp).distinct().select(F.col(fp).alias("f"), F.explode(bands(fp)).alias("band"))
    a, b = cut.select(F.col("f").alias("a"), "band"), cut.select(F.col("f").alias("b"), "band")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    return a.join(b, "band").where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()


def greedy_keep(rows: DataFrame, order: str, fp: str = "fp", bits: int = 3) -> DataFrame:
    """(fp): fingerprints that stay when rows come in order and each that is within `bits` (at most 3) bits of a kept one goes.

    In rounds: an undecided fingerprint that is the first of the undecided in all its parts (bands) stays, and what is near it goes; so does each
    without an earlier undecided near one. The set is that of the pass in order (ties of arrival by fingerprint). Who comes first in a band is an
    aggregate, and only those who are not are compared, with the earlier undecided ones of their bands; a fingerprint's duplicates share its row. A round
    is a few joins, however large a group is; rounds follow the longest chain of earlier near ones, which is short unless titles arrive along it.
    """
    if not 0 <= bits <= 3:
        raise ValueError("four parts find every pair within 3 bits")
    left = written(rows.groupBy(F.col(fp).alias("f")).agg(F.min(order).alias("at")))
    kept = None
    close = F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= bits
    while left.take(1):
        cut = left.select("f", F.struct("at", "f").alias("rank"), F.explode(bands("f")).alias("band"))
        first = cut.groupBy("band").agg(F.min("rank").alias("first"))
        ahead = cut.join(first, "band").where(F.col("first.f") != F.col("f"))
        # Near an undecided one that comes first in a shared band: waits for it. Else it is compared with all earlier ones of its bands.
        waits = ahead.where(F.bit_count(F.col("f").bitwiseXOR(F.col("first.f"))) <= bits).select("f").distinct()
        open_ = ahead.select("f").distinct().join(waits, "f", "left_anti")
        mine = cut.join(open_, "f", "left_semi")
        held = mine.join(cut.select("band", F.col("f").alias("g"), F.col("rank").alias("before")), "band").where((F.col("before") < F.col("rank")) & close).select("f").distinct()
        stay = written(left.join(waits.unionByName(held), "f", "left_anti").select("f"))
        near = cut.join(stay.toDF("g").select("g", F.explode(bands("g")).alias("band")), "band").where(close).select("f").distinct()
        kept, old_kept = written(stay if kept is None else kept.unionByName(stay)), kept
        left, old = written(left.join(near, "f", "left_anti")), left
        discard(old, old_kept, stay)
    discard(left)
    return (rows.select(F.col(fp).alias("f")).limit(0) if kept is None else kept).select(F.col("f").alias(fp))


def retry_plan(failures: DataFrame, attempt: str = "attempt", failed_at: str = "failed_at", most: int = 3) -> DataFrame:
    """failures with next_attempt, due (60 * 2^attempt seconds later) and dead: attempts that are used up have no due time."""
    dead = F.col(attempt) >= most
    due = F.timestamp_micros(F.unix_micros(F.col(failed_at).cast("timestamp")) + backoff_seconds(attempt) * 1_000_000)
    return failures.withColumn("dead", dead).withColumn("next_attempt", F.when(~dead, F.col(attempt) + 1)).withColumn("due", F.when(~dead, due))


def due_items(plan: DataFrame, now: Column, by: str = "host", batch: int = 50) -> DataFrame:
    """Each host's `batch` longest due items, in order of their time: `place` from 1. The rest stays for the next flush."""
    w = Window.partitionBy(by).orderBy("due", F.xxhash64(*[c for c in plan.columns if c != "due"]))
    return plan.where(~F.col("dead") & (F.col("due") <= now)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= batch)


def bad_addresses(entries: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """(url, entries) and (domain, addresses) of a list of bad addresses; rows without an address go."""
    good = entries.where(F.coalesce(F.col(url), F.lit("")) != "")
    return good.groupBy(F.col(url).alias("url")).agg(F.count(F.lit(1)).alias("entries")), good.groupBy(url_host(url).alias("domain")).agg(F.countDistinct(url).alias("addresses"))


def listed_risk(rows: DataFrame, entries: DataFrame, url: str = "url", listed: str = "url") -> DataFrame:
    """rows with `risk`: blocked where the address is listed, high where its domain has listed ones, else safe."""
    exact, domains = bad_addresses(entries, listed)
    both = rows.withColumn("__domain", url_host(url)).join(exact.select(F.col("url").alias(url), F.lit(True).alias("__exact")), url, "left").join(domains.select(F.col("domain").alias("__domain"), F.lit(True).alias("__near")), "__domain", "left")
    return both.withColumn("risk", F.when(F.col("__exact"), "blocked").when(F.col("__near"), "high").otherwise("safe")).drop("__domain", "__exact", "__near")


def authority(hosts: DataFrame, presets: DataFrame, stored: DataFrame, host: str = "host", default: float = 0.5) -> DataFrame:
    """hosts with `authority` and `origin`: the preset one, else the stored one, else the default. presets, stored (host, authority)."""
    a, b = presets.groupBy(host).agg(F.max("authority").alias("__a")), stored.groupBy(host).agg(F.max("authority").alias("__b"))
    both = hosts.join(a, host, "left").join(b, host, "left")
    return both.withColumn("authority", F.coalesce("__a", "__b", F.lit(default))).withColumn("origin", F.when(F.col("__a").isNotNull(), "preset").when(F.col("__b").isNotNull(), "stored").otherwise("default")).drop("__a", "__b")


def set_authority(stored: DataFrame, changes: DataFrame, host: str = "host") -> DataFrame:
    """stored (host, authority, tier, note) after changes (host and any of these): what a change gives is set, nulls keep what was."""
    both = stored.alias("s").join(changes.groupBy(host).agg(*[F.max(c).alias(f"__{c}") for c in ("authority", "tier", "note")]), host, "full")
    return both.select(host, *[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) for c in ("authority", "tier", "note")])


def map_fields(rows: DataFrame, names: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """rows with columns renamed (others pass), and nulls of a column, or a column that is missing, filled by its default."""
    out = rows.withColumnsRenamed(names)
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in out.columns else F.lit(value))
    return out


def success_rate(batch: DataFrame, ok: Column) -> DataFrame:
    """One row (total, succeeded, rate): rate 0 without rows."""
    n = batch.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(ok, 1)).alias("succeeded"))
    return n.withColumn("rate", F.when(F.col("total") > 0, F.col("succeeded") / F.col("total")).otherwise(0.0))
