"""Names of entities: normal forms, match rules, resolution against a table of known entities, relation types.

Every rule is a Column expression; the fixed tables of aliases travel as map literals. Names meet known entities in equi-joins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, script_of

MERGE_FROM = 0.9  # a rule of less confidence never merges

# Suffixes of organisations and their usual spelling, in order of trial.
ORG_SUFFIXES = {"Inc.": "Inc", "Inc": "Inc", "Corp.": "Corp", "Corp": "Corp", "Ltd.": "Ltd", "Ltd": "Ltd", "LLC": "LLC", "Co.": "Co", "Co": "Co", "Corporation": "Corp", "Incorporated": "Inc", "Limited": "Ltd", "GmbH": "GmbH", "AG": "AG", "SA": "SA"}
ORG_ENDINGS_ZH = ("有限公司", "股份有限公司", "集团", "公司", "科技", "技术", "网络", "信息", "互联网")
# Endings that name variants differ by.
PERSON_TITLES = ("先生", "女士", "博士", "教授", "总", "董", "长", "Mr.", "Ms.", "Dr.", "Prof.")
ORG_VARIANTS = ("公司", "集团", "有限", "股份", "科技", "技术", "Inc.", "Corp.", "Ltd.", "LLC", "GmbH", "Co.", "Corporation", "Incorporated", "Limited")
PLACE_VARIANTS = ("市", "省", "县", "区", "州", "国", "地区")
# Abbreviations.
ABBREVIATIONS = {
    "AI": "人工智能", "ML": "机器学习", "NLP": "自然语言处理", "CV": "计算机视觉", "API": "应用程序接口", "SDK": "软件开发工具包", "GDP": "国内生产总值", "CPI": "消费者价格指数",
    "IPO": "首次公开募股", "CEO": "首席执行官", "CTO": "首席技术官", "CFO": "首席财务官", "NBA": "美国职业篮球联赛", "NFL": "美国国家橄榄球联盟", "FIFA": "国际足球联合会", "WHO": "世界卫生组织",
    "UN": "联合国", "EU": "欧盟", "NATO": "北大西洋公约组织", "WTO": "世界贸易组织", "IMF": "国际货币基金组织", "NASA": "美国国家航空航天局", "FBI": "联邦调查局", "CIA": "中央情报局",
}
# Names of places in two languages.
TRANSLATIONS = {
    "United States": "美国", "United Kingdom": "英国", "China": "中国", "Japan": "日本", "Germany": "德国", "France": "法国", "Russia": "俄罗斯", "South Korea": "韩国", "North Korea": "朝鲜",
    "India": "印度", "Australia": "澳大利亚", "Canada": "加拿大", "Brazil": "巴西", "Italy": "意大利", "Spain": "西班牙", "Mexico": "墨西哥", "Taiwan": "台湾", "Hong Kong": "香港", "Macau": "澳门",
    "Beijing": "北京", "Shanghai": "上海", "Shenzhen": "深圳", "Guangzhou": "广州", "Hangzhou": "杭州", "Nanjing": "南京", "New York": "纽约", "Los Angeles": "洛杉矶", "San Francisco": "旧金山",
    "Silicon Valley": "硅谷", "Washington": "华盛顿", "London": "伦敦", "Paris": "巴黎", "Tokyo": "东京", "Seoul": "首尔", "Singapore": "新加坡", "Dubai": "迪拜",
}
# Other names of companies.
ALIASES = {
    "OpenAI": ("OpenAI Inc", "OpenAI LP", "OpenAI公司"), "Google": ("谷歌", "Google Inc", "Alphabet", "Google公司"), "Microsoft": ("微软", "Microsoft Corp", "微软公司"),
    "Apple": ("苹果", "Apple Inc", "苹果公司"), "Amazon": ("亚马逊", "Amazon.com", "亚马逊公司"), "Meta": ("Facebook", "Meta Platforms", "脸书", "Meta公司"), "Tesla": ("特斯拉", "Tesla Inc", "特斯拉公司"),
    "NVIDIA": ("英伟达", "Nvidia", "NVIDIA Corp", "英伟达公司"), "Alibaba": ("阿里巴巴", "Alibaba Group", "阿里", "阿里巴巴集团"), "Tencent": ("腾讯", "Tencent Holdings", "腾讯控股", "腾讯公司"),
    "ByteDance": ("字节跳动", "字节", "ByteDance Ltd"), "Huawei": ("华为", "Huawei Technologies", "华为技术", "华为公司"), "Baidu": ("百度", "Baidu Inc", "百度公司"), "JD": ("京东", "JD.com", "京东集团"),
    "Didi": ("滴滴", "DiDi", "滴滴出行"), "Pinduoduo": ("拼多多", "PDD"),
}
# Categories and emotions in their closed sets.
CATEGORIES = {
    "technology": "科技", "tech": "科技", "politics": "政治", "political": "政治", "military": "军事", "army": "军事", "economy": "经济", "economic": "经济", "business": "经济", "society": "社会",
    "social": "社会", "culture": "文化", "cultural": "文化", "sports": "体育", "sport": "体育", "international": "国际", "world": "国际", "global": "国际",
}
EMOTIONS = {
    "optimistic": "乐观", "hope": "期待", "excited": "振奋", "calm": "平静", "neutral": "客观", "objective": "客观", "worried": "担忧", "concern": "担忧", "pessimistic": "悲观", "sad": "悲观",
    "angry": "愤怒", "anger": "愤怒", "panic": "恐慌", "fear": "恐慌",
}
# Relation types as name, English name, symmetric, other names.
RELATION_TYPES = (
    ("任职于", "WORKS_AT", False, ("就职于", "工作于", "供职于", "担任", "就职")),
    ("隶属于", "AFFILIATED_WITH", False, ("隶属", "下属", "从属", "归属", "所属")),
    ("控股", "CONTROLS", False, ("控制", "控股关系", "持股", "持有", "掌控", "实际控制")),
    ("位于", "LOCATED_IN", False, ("地处", "坐落于", "在", "驻地", "所在地")),
    ("收购", "ACQUIRES", False, ("并购", "收购了", "吞并", "买下", "收购案")),
    ("供应", "SUPPLIES", False, ("提供", "供应商", "供货", "供给", "供应了")),
    ("投资", "INVESTS_IN", False, ("注资", "投资了", "融资", "领投", "参投", "入股")),
    ("合作", "PARTNERS_WITH", True, ("战略合作", "联合", "合作开发", "协作", "携手", "结盟", "联名")),
    ("竞争", "COMPETES_WITH", True, ("对抗", "竞品", "竞争关系", "对手", "对峙", "相争")),
    ("发布", "PUBLISHES", False, ("公布", "宣布", "发表", "推出", "公布于", "对外发布")),
    ("签署", "SIGNS", False, ("签订", "签约", "缔结", "达成", "签署了", "签订协议")),
    ("参与", "PARTICIPATES_IN", False, ("加入", "参加了", "介入", "出席", "参与活动")),
    ("监管", "REGULATES", False, ("监管关系", "监督", "管理", "管辖", "监察", "督导")),
    ("支持", "SUPPORTS", False, ("援助", "资助", "扶持", "力挺", "背书", "支持了")),
    ("制裁", "SANCTIONS", False, ("惩罚", "封禁", "处罚", "禁运", "制裁了", "限制")),
    ("引发", "CAUSES", False, ("导致", "触发", "造成", "引起", "引发了", "催生")),
    ("影响", "INFLUENCES", False, ("左右", "波及", "影响了", "作用于", "传导")),
)
RELATION_ENDING = "(了|关系|于|中|的)$"


# What is cleaned off a name, in order, and what takes its place.
NAME_CLEANING = (
    ("[「『](.+?)[」』]", "$1"),
    ("[《》](.+?)[《》]", "$1"),
    ("[\"'`]", ""),
    (r"[\x00-\x1f\x7f-\x{9f}]", ""),
    (r"\s*[-–—]\s*", "-"),
)


@F.pandas_udf(T.StringType())
def nfkc(names: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no function for it."""
    return names.str.normalize("NFKC")


def _lookup(words: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), key)


def normal_name(name, organisation: Column | bool = False, composed: bool = False) -> Column:
    """struct(normalized, script, changes, confidence) of a name.

    Composed form, single spaces, no corner brackets, quotes or control characters, bare hyphens, a capital on lower-case Latin words,
    usual organisation suffixes. composed=True says that names are in NFKC already, which keeps the plan in the JVM. A null or
    empty name gives "" with confidence 0 and the change empty_name.
    """
    raw = F.coalesce(col(name), F.lit(""))
    script = script_of(raw)
    unicode_ = raw if composed else nfkc(raw)
    spaced = F.trim(F.regexp_replace(unicode_, r"\s+", " "))
    bare = spaced
    for pattern, put in NAME_CLEANING:
        bare = F.regexp_replace(bare, pattern, put)
    runs = F.regexp_extract_all(bare, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    capital = F.array_join(F.transform(runs, lambda w: F.when(w.rlike("^[a-z]+$"), F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))).otherwise(w)), "")
    cased = F.when(script.isin("english", "mixed"), capital).otherwise(bare)
    usual = cased
    for short in sorted(set(ORG_SUFFIXES.values())):
        spelled = "|".join(sorted({old.rstrip(".") for old, new in ORG_SUFFIXES.items() if new == short}))
        dots = "{0,2}" if f"{short}." in ORG_SUFFIXES else "?"
        usual = F.regexp_replace(usual, rf"(?i)\s+({spelled})\.{dots}$", f" {short}")
    final = F.when(F.lit(organisation) if isinstance(organisation, bool) else organisation, usual).otherwise(cased)
    steps = (("unicode_normalization", unicode_ != raw), ("whitespace_normalization", spaced != raw), ("special_chars_removed", bare != spaced), ("case_normalization", cased != bare), ("org_suffix_normalization", final != cased))
    changes = F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in steps]))
    empty = raw == ""
    return F.struct(
        F.trim(final).alias("normalized"), script.alias("script"), F.when(empty, F.array(F.lit("empty_name"))).otherwise(changes).alias("changes"),
        F.when(empty, 0.0).when(F.size(changes) == 0, 1.0).otherwise(0.95).alias("confidence"),
    )


def chinese_ratio(text) -> Column:
    """Share of Han characters; 0 for an empty text."""
    n = F.length(col(text))
    return F.when(n > 0, F.regexp_count(col(text), F.lit(r"[\x{4e00}-\x{9fff}]")) / n).otherwise(0.0)


def canonical_score(normal: Column, prefer_chinese: bool = True) -> Column:
    """How well a normal_name() struct serves as the name to keep: script, capital, length, being unchanged, confidence."""
    name, script = normal["normalized"], normal["script"]
    by_script = F.when(script == "chinese", 10.0).when(script == "mixed", 5 * chinese_ratio(name)).otherwise(0.0) if prefer_chinese else F.when(script == "english", 10.0).otherwise(0.0)
    n = F.length(name)
    size = F.when(n.between(2, 50), 5.0).when(n > 50, -F.least(F.lit(5.0), (n - 50) * 0.1)).otherwise(0.0)
    capital = F.when((script == "english") & name.rlike("^[A-Z]"), 2.0).otherwise(0.0)
    return by_script + capital + size + F.when(F.size(normal["changes"]) == 0, 3.0).otherwise(0.0) + normal["confidence"] * 5


def best_name(names: DataFrame, by: str, name: str = "name", composed: bool = False) -> DataFrame:
    """(by, canonical): the best-scored name of each group in its normal form; ties go to the smaller name."""
    scored = names.select(by, name, normal_name(name, composed=composed).alias("__n"))
    rank = F.struct((-F.round(canonical_score(F.col("__n")), 9)).alias("s"), F.col(name))
    return scored.groupBy(by).agg(F.min_by(F.col("__n.normalized"), rank).alias("canonical"))


def bare_name(name) -> Column:
    """The name without one bracket at its end."""
    return F.regexp_replace(col(name), r"^(.+?)\s*\(([^)]+)\)\s*$", "$1")


def without_ending(name, endings) -> Column:
    """The name without the first of the endings that it has."""
    n, out = col(name), None
    for e in endings:
        cut = F.trim(n.substr(F.lit(1), F.length(n) - len(e)))
        out = F.when(n.endswith(e), cut) if out is None else out.when(n.endswith(e), cut)
    return out.otherwise(n)


def equivalence(a: Column, b: Column) -> Column:
    """Confidence that two normal names are one: 1 equal, .95 but for case, .85 but for suffixes, .90 but for a bracket, else 0."""
    endings = (*ORG_SUFFIXES, *ORG_ENDINGS_ZH)
    return F.when(a == b, 1.0).when(F.lower(a) == F.lower(b), 0.95).when(without_ending(a, endings) == without_ending(b, endings), 0.85).when(bare_name(a) == bare_name(b), 0.90).otherwise(0.0)


# What a figure, not a name, looks like.
METRICS = (r"^[\d,．.]+\s*%$", r"^[\d,．.]+\s*[万亿]元$", r"^[\d,．.]+\s*[万亿]?股$", r"^[\d,．.]+\s*[万亿千百十]+[元股人]?$", r"[\x{4e00}-\x{9fff}].*[\x{4e00}-\x{9fff}].*?\d[\d,．.]*[万亿千百十零点]?[元股人]?元?", r"每\d+股.*红利.*元")


def is_metric(name) -> Column:
    n = F.trim(F.coalesce(col(name), F.lit("")))
    found = F.lit(False)
    for pattern in METRICS:
        found = found | n.rlike(pattern)
    return found


def category(raw) -> Column:
    """A category of the closed set; all else is 社会."""
    known = F.coalesce(_lookup(CATEGORIES, F.lower(F.trim(col(raw)))), col(raw))
    return F.when(known.isin(*sorted(set(CATEGORIES.values()))), known).otherwise("社会")


def emotion(raw) -> Column:
    """The set's word for an emotion; an unknown one stays, none is 客观."""
    return F.when(F.coalesce(col(raw), F.lit("")) == "", "客观").otherwise(F.coalesce(_lookup(EMOTIONS, F.lower(F.trim(col(raw)))), col(raw)))


def relation_type(raw) -> Column:
    """English name of a relation type, null if unknown: by alias, after up to three endings are cut, or by its English name in capitals."""
    names = {x: en for zh, en, _, others in RELATION_TYPES for x in (zh, en, *others)}
    tries = [col(raw)]
    for _ in range(3):
        tries.append(F.regexp_replace(tries[-1], RELATION_ENDING, ""))
    return F.coalesce(*[_lookup(names, t) for t in tries], _lookup({en: en for _, en, _, _ in RELATION_TYPES}, F.upper(col(raw))))


def unknown_types(rows: DataFrame, raw: str, seen: str) -> DataFrame:
    """(raw_type, hit_count, last_seen) of relation types that are not known."""
    return rows.where(relation_type(raw).isNull() & F.col(raw).isNotNull()).groupBy(F.col(raw).alias("raw_type")).agg(F.count(F.lit(1)).alias("hit_count"), F.max(seen).alias("last_seen"))


def match_rule(name, known, kind=None) -> Column:
    """struct(rule, confidence, canonical) of the first rule by priority that says the two names are one, null if none does.

    kind (人物, 组织机构, 地点) opens the rule for variants of its kind; they stay below MERGE_FROM.
    """
    a, b = col(name), col(known)
    group = {x: own for own, others in ALIASES.items() for x in others}
    of_a, of_b = _lookup(group, a), _lookup(group, b)
    long_a, long_b = _lookup(ABBREVIATIONS, a), _lookup(ABBREVIATIONS, b)
    other_a, other_b = _lookup(TRANSLATIONS, a), _lookup(TRANSLATIONS, b)
    give = lambda rule, confidence, canonical: F.struct(F.lit(rule).alias("rule"), F.lit(confidence).alias("confidence"), canonical.alias("canonical"))
    out = F.when(a == b, give("exact", 1.0, b)).when(F.lower(a) == F.lower(b), give("case", 0.95, b)).when((bare_name(a) == bare_name(b)) & (a != b), give("bracket", 0.90, b))
    out = out.when(of_a == b, give("alias", 0.95, b)).when(of_b == a, give("alias", 0.95, a)).when(of_a == of_b, give("alias", 0.90, of_a))
    out = out.when(long_a == b, give("abbreviation", 0.90, b)).when(long_b == a, give("abbreviation", 0.90, a)).when(long_a == long_b, give("abbreviation", 0.85, b))
    out = out.when(other_a == b, give("translation", 0.90, b)).when(other_b == a, give("translation", 0.90, a))
    if kind is not None:
        for label, rule, endings in (("人物", "person", PERSON_TITLES), ("组织机构", "organisation", ORG_VARIANTS), ("地点", "place", PLACE_VARIANTS)):
            out = out.when((col(kind) == label) & (without_ending(a, endings) == without_ending(b, endings)), give(rule, 0.85, b))
    return out


def canonical(name) -> Column:
    """The name a fixed table gives for an alias, an abbreviation or a foreign spelling; else the name itself."""
    group = {x: own for own, others in ALIASES.items() for x in others}
    return F.coalesce(_lookup(group, col(name)), _lookup(ABBREVIATIONS, col(name)), _lookup(TRANSLATIONS, col(name)), col(name))


def resolve(names: DataFrame, known: DataFrame, candidates: DataFrame | None = None, composed: bool = False) -> DataFrame:
    """(name, kind, entity, how, confidence): which known entity each distinct name means; entity null: a new one.

    names (name, kind); known (name, kind, aliases); candidates (name, known, similarity) from a vector search, optional. First an exact match of
    the normal name, then of the raw name, then of an alias, then the first candidate, by similarity, that a rule merges with at
    least MERGE_FROM. Joins are by name, so a name shared by many rows costs one row. Null names go.
    """
    asked = names.where("name IS NOT NULL").select("name", "kind").distinct().withColumn("normal", normal_name("name", F.col("kind") == "组织机构", composed)["normalized"])
    own = known.select(F.col("name").alias("entity"), "kind").distinct()
    alias = known.select(F.explode("aliases").alias("alias"), "kind", F.col("name").alias("entity")).groupBy("alias", "kind").agg(F.min("entity").alias("by_alias"))
    by_normal = own.select(F.col("entity").alias("by_normal"), F.col("entity").alias("normal"), "kind")
    by_raw = own.select(F.col("entity").alias("by_raw"), F.col("entity").alias("name"), "kind")
    found = asked.join(by_normal, ["normal", "kind"], "left").join(by_raw, ["name", "kind"], "left").join(alias.withColumnRenamed("alias", "name"), ["name", "kind"], "left")
    found = found.select("name", "kind", F.coalesce("by_normal", "by_raw", "by_alias").alias("entity"), F.when(F.col("by_normal").isNotNull(), "normal").when(F.col("by_raw").isNotNull(), "raw").when(F.col("by_alias").isNotNull(), "alias").alias("how"))
    found = found.withColumn("confidence", F.when(F.col("entity").isNotNull(), 1.0))
    if candidates is None:
        return found
    hit = candidates.join(asked.select("name", "kind"), "name").withColumn("m", match_rule("name", "known", "kind")).where(F.col("m.confidence") >= MERGE_FROM)
    first = hit.groupBy("name", "kind").agg(F.min_by(F.struct(F.col("known").alias("entity"), F.col("m.rule").alias("how"), F.col("m.confidence").alias("confidence")), F.struct(-F.col("similarity"), "known")).alias("c"))
    joined = found.join(first, ["name", "kind"], "left")
    return joined.select("name", "kind", *[F.when(F.col("entity").isNotNull(), F.col(x)).otherwise(F.col(f"c.{x}")).alias(x) for x in ("entity", "how", "confidence")])


def merge_entities(known: DataFrame, resolved: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """known (name, kind, aliases, description) after resolve(): other names become aliases, unresolved names new entities.

    descriptions (name, kind, description) fill what is null, never what is there.
    """
    more = resolved.where(F.col("entity").isNotNull() & (F.col("entity") != F.col("name"))).groupBy(F.col("entity").alias("name"), "kind").agg(F.array_sort(F.collect_set("name")).alias("more"))
    new = resolved.where("entity IS NULL").select("name", "kind").distinct()
    old = known.join(more, ["name", "kind"], "left").select("name", "kind", F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>"))).alias("aliases"), "description")
    every = old.unionByName(new.select("name", "kind", F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("description")))
    if descriptions is None:
        return every
    text = descriptions.groupBy("name", "kind").agg(F.min("description").alias("given"))
    return every.join(text, ["name", "kind"], "left").select("name", "kind", "aliases", F.coalesce("description", "given").alias("description"))


def merge_relations(mentions: DataFrame) -> DataFrame:
    """(src, dst, type, weight, mentions): weight 1 for the first mention and .1 for each more; types by their known names."""
    typed = mentions.withColumn("type", F.coalesce(relation_type("type"), F.col("type")))
    return typed.groupBy("src", "dst", "type").agg((1 + 0.1 * (F.count(F.lit(1)) - 1)).alias("weight"), F.count(F.lit(1)).alias("mentions"))

