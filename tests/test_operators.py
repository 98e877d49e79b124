import itertools
import math
import random

from pyspark.sql import functions as F

from loomstone.functions import columns as C
from loomstone.functions import texts as T
from loomstone.operators import as_of, communities, context, entities, graph, health, intake, leiden, memory, retrieval, similar_names, table_functions
from loomstone.plans import lifecycle, search, streams
from loomstone.plans import texts as text_plans
from loomstone.sources import tables


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "x string").select(make("x").alias("y")).first()["y"]


def test_normalize_url(spark):
    for url, want in {
        "//a.com/x": "https://a.com/x", "http://WWW.A.com:80/x/?q=1#f": "https://a.com/x", "https://a.com:443": "https://a.com/.", "https://a.com/": "https://a.com", "http://a.com:443/": "https://a.com:443",
        "https://a.com/b/../c/./d//e": "https://a.com/c/d/e", "https://a.com/a%20b%2Bc/%E4%B8%AD+x": "https://a.com/a%20b%2Bc/%E4%B8%AD%2Bx", "https://a.com/100%": "https://a.com/100%25",
        "https://mp.weixin.qq.com/s?__biz=1&x=2&mid=3": "https://mp.weixin.qq.com/s?__biz=1&mid=3", "ftp://a.com/f": "ftp://a.com/f",
    }.items():
        assert one(spark, url, C.normalize_url) == want, url


def test_redact_and_risk(spark):
    for text, want in {"redis://u:pw@h": "redis://u:***@h", "a?api_key=k1&b": "a?api_key=***&b", "password = x1, Token: y": "password = ***, Token: ***", "plain": "plain"}.items():
        assert one(spark, text, C.redact) == want
    for url, level in {
        "https://a.com/": 0, "ftp://a.com": 4, None: 4, "http://127.0.0.1/": 4, "http://172.20.1.1/": 4, "http://[fe80::1]/": 4, "http://metadata/": 4, "http://8.8.8.8/": 2, "https://a.com:22/": 3,
        "https://a.com:50000/": 2, "https://bit.ly/x": 1, "https://a.com/login": 2, "https://a.com/login-verify-account": 3, "https://1.b.c.d.e.com/": 3, "https://a.com/%00": 3, "https://a.com/" + "x" * 1001: 1,
    }.items():
        assert one(spark, url, C.url_risk) == level, url


def test_timeliness(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS a, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, h) AS b FROM VALUES (0), (6), (24), (-72), (168), (169), (NULL) AS t(h)")
    assert [r[0] for r in df.select(C.timeliness("a", "b")).collect()] == [1.0, 1.0, 0.85, 0.65, 0.45, 0.3, 0.7]


def test_decay_guards(spark):
    df = spark.createDataFrame([(0.0,), (30.0,), (-1.0,), (float("inf"),)], "a double")
    got = [r[0] for r in df.select(C.decay(F.col("a"), 30.0)).collect()]
    assert [round(x, 9) for x in got] == [1.0, 0.5, 1.0, 1.0]
    assert df.select(C.decay(F.col("a"), 0.0)).first()[0] == 1.0


def test_rrf_and_mmr(spark):
    rows = [("v", "doc1", 1), ("v", "doc2", 2), ("v", "doc3", 3), ("b", "doc2", 1), ("b", "doc4", 2), ("b", "doc1", 3)]
    got = {r["id"]: r["score"] for r in retrieval.reciprocal_rank_fusion(spark.createDataFrame(rows, "list string, id string, rank int")).collect()}
    assert math.isclose(got["doc2"], 1 / 62 + 1 / 61) and math.isclose(got["doc4"], 1 / 62)
    pool = [(1, "a", 1.0, "x y z"), (1, "b", 0.9, "x y z"), (1, "c", 0.5, "p q r")]
    picked = retrieval.mmr(spark.createDataFrame(pool, "query_id int, id string, score double, text string"), 2, weight=0.5)
    assert [r["id"] for r in picked.orderBy("place").collect()] == ["a", "c"]


def test_components_and_hops(spark):
    r = random.Random(1)
    pairs = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    edges = spark.createDataFrame(pairs, "src long, dst long")
    nodes = spark.createDataFrame([(x,) for x in parent] + [(999,)], "node long")
    got = {x["node"]: x["component"] for x in graph.components(edges, nodes).collect()}
    assert got == {x: find(x) for x in parent} | {999: 999}
    reached = {x["node"]: x["hops"] for x in graph.hops(edges, spark.createDataFrame([(100,)], "node long"), 3).collect()}
    assert reached == {100: 0, 101: 1, 102: 2, 103: 3}
    assert graph.components(edges.limit(0)).count() == 0


def test_communities_of_two_cliques(spark):
    pairs = [*itertools.combinations(range(5), 2), *itertools.combinations(range(10, 15), 2), (4, 10)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double")
    found = leiden.communities(edges)
    got = {}
    for x in found.collect():
        got.setdefault(x["community"], set()).add(x["node"])
    assert sorted(map(sorted, got.values())) == [list(range(5)), list(range(10, 15))]
    q = graph.modularity(edges, found, group="community").first()[0]
    assert q > 0.4


def test_merge_chains(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("w", "x")], "id string, merged_into string")
    assert {r["item"]: r["final"] for r in graph.resolve_chains(df).collect() if r["item"] in "abcxyw"} == {"a": "c", "b": "c", "c": "c", "x": None, "y": None, "w": None}


def test_upsert_and_columns(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, n int")
    assert {(r["k"], r["v"]) for r in tables.upsert(old, new, ["k"], "n").collect()} == {(1, "a"), (2, "d"), (3, "e")}
    assert tables.ensure_columns(old, {"z": "double"}).columns == ["k", "v", "z"]


def test_normal_names(spark):
    for name, want in {"  open　ai  Inc. ": "Open Ai Inc", "Ｇｏｏｇｌｅ": "Google", "「华为」技术": "华为技术", "USA - made": "USA-Made", "acme CORPORATION": "Acme Corp", "": "", None: ""}.items():
        assert one(spark, name, lambda x: entities.normal_name(x, True)["normalized"]) == want, name
    got = one(spark, "", lambda x: entities.normal_name(x))
    assert (got["changes"], got["confidence"]) == (["empty_name"], 0.0)
    names = spark.createDataFrame([(1, "openai"), (1, "OpenAI"), (1, "人工智能"), (2, None), (3, "b"), (3, "B")], "g int, name string")
    assert {r["g"]: r["canonical"] for r in entities.best_name(names, "g").collect()} == {1: "人工智能", 2: "", 3: "B"}


def test_match_rules(spark):
    pairs = [("A", "A", None, "exact", 1.0), ("a", "A", None, "case", 0.95), ("Phone (4a)", "Phone", None, "bracket", 0.9), ("谷歌", "Google", None, "alias", 0.95), ("谷歌", "Alphabet", None, "alias", 0.9), ("AI", "人工智能", None, "abbreviation", 0.9),
             ("Japan", "日本", None, "translation", 0.9), ("王先生", "王", "人物", "person", 0.85), ("某某公司", "某某集团", "组织机构", "organisation", 0.85), ("南京市", "南京", "地点", "place", 0.85), ("x", "y", "地点", None, None), (None, "y", None, None, None)]
    df = spark.createDataFrame([p[:3] for p in pairs], "a string, b string, k string").select(entities.match_rule("a", "b", "k").alias("m"))
    assert [(r["m"]["rule"], r["m"]["confidence"]) if r["m"] else (None, None) for r in df.collect()] == [p[3:] for p in pairs]


def test_relation_types_and_metrics(spark):
    for raw, want in {"收购了": "ACQUIRES", "合作的关系中": "PARTNERS_WITH", "supplies": "SUPPLIES", "unheard": None, None: None}.items():
        assert one(spark, raw, entities.relation_type) == want, raw
    for raw, want in {"12.73%": True, "97.65亿元": True, "2.42亿股": True, "本土市场游戏收入1642亿元": True, "每10股派发现金红利0.86元(含税)": True, "华为": False, "Windows 11": False, "": False, None: False}.items():
        assert one(spark, raw, entities.is_metric) == want, raw


def test_resolve_and_merge(spark):
    known = spark.createDataFrame([("Google", "ORG", ["谷歌"], None), ("Acme Corp", "ORG", None, "old")], "name string, kind string, aliases array<string>, description string")
    names = spark.createDataFrame([("google", "ORG"), ("谷歌", "ORG"), ("Acme  Corp", "ORG"), ("New One", "ORG"), ("Alphabet", "ORG"), (None, "ORG"), ("google", "ORG")], "name string, kind string")
    near = spark.createDataFrame([("Alphabet", "Acme Corp", 0.99), ("Alphabet", "Google", 0.9)], "name string, known string, similarity double")
    got = {r["name"]: (r["entity"], r["how"]) for r in entities.resolve(names, known, near).collect()}
    assert got == {"google": ("Google", "normal"), "谷歌": ("Google", "alias"), "Acme  Corp": ("Acme Corp", "normal"), "New One": (None, None), "Alphabet": ("Google", "alias")}
    text = spark.createDataFrame([("Google", "ORG", "given"), ("Acme Corp", "ORG", "not taken")], "name string, kind string, description string")
    rows = {r["name"]: r for r in entities.merge_entities(known, entities.resolve(names, known, near), text).collect()}
    assert set(rows) == {"Google", "Acme Corp", "New One"} and rows["Google"]["aliases"] == ["谷歌", "Alphabet", "google"] and rows["Google"]["description"] == "given" and rows["Acme Corp"]["description"] == "old"
    assert entities.resolve(names.limit(0), known).count() == 0


def test_walks_against_loops(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(30), rng.randrange(30), rng.choice(["causal", "temporal", "entity", "semantic"])) for _ in range(90)]
    df = spark.createDataFrame(edges, "src int, dst int, kind string")
    got = {(r["query"], r["node"]): (round(r["score"], 6), r["depth"]) for r in memory.beam_search(df, spark.createDataFrame([(1, "why", 3), (2, "none", 7)], "query int, intent string, node int"), 4, 3).collect()}
    want = {}
    for q, intent, at in ((1, "why", 3), (2, "open", 7)):
        beam, seen = {at: 0.0}, {at}
        want[q, at] = (0.0, 0)
        for k in range(1, 5):
            level = {}
            for a, b, kind in edges:
                if a in beam and b not in seen:
                    level[b] = max(level.get(b, 0), beam[a] * 0.9 + math.exp(memory.INTENTS[intent][memory.KINDS.index(kind)]))
            beam = dict(sorted(level.items(), key=lambda x: (-round(x[1], 9), x[0]))[:3])
            seen |= set(beam)
            want |= {(q, n): (round(s, 6), k) for n, s in beam.items()}
    assert got == want
    typed = df.withColumn("type", F.when(F.col("kind") == "semantic", "PREVENTS").otherwise("CAUSES"))
    chain = {r["node"]: r["distance"] for r in memory.causal_chain(typed, spark.createDataFrame([(3,)], "event int"), 3).collect()}
    reach, front = {3: 0}, {3}
    for k in (1, 2, 3):
        front = {a for a, b, kind in edges if b in front and kind != "semantic"} - set(reach)
        reach |= dict.fromkeys(front, k)
    assert chain == {n: d for n, d in reach.items() if d}


def test_pack_context(spark):
    rows = spark.createDataFrame([(1, 5.0, 1, "a" * 40), (1, 4.0, 2, "b" * 40), (1, 3.0, 3, "c" * 400), (1, 2.0, 4, None), (2, 1.0, 9, "d" * 999)], "query int, score double, node int, text string")
    got = {r["query"]: (r["used"], r["kept"], r["dropped"]) for r in memory.pack_context(rows, 25).collect()}
    assert got == {1: (20, [1, 2], [3, 4]), 2: (0, [], [9])}


def test_health_of_empty_tables(spark):
    c = spark.createDataFrame([], "community int, parent int, entity_count long")
    m = spark.createDataFrame([], "node int, community int")
    r = spark.createDataFrame([], "community int, stale boolean, updated_at timestamp")
    found = health.issues(c, m, r, F.current_timestamp())
    assert found.count() == 0 and health.repair(c, m).count() == 0 and health.drifted(c, m).count() == 0
    assert health.community_score(c, found).first().asDict() == {"score": 0.0, "status": "critical"}


def test_scores(spark):
    df = spark.createDataFrame([("政治", 0.8, None, 1.0), ("其他", None, 1.0, 0.5)], "k string, s double, c double, t double")
    assert [r[0] for r in df.select(context.credibility("k", "s", "c", "t")).collect()] == [0.83, 0.7]
    assert one(spark, "为什么下跌", lambda x: context.route(context.intent(x))) == "local" and one(spark, None, lambda x: context.route(context.intent(x))) == "global"


def test_r7_fuses_two_lists_for_every_query(spark, tmp_path):
    from loomstone.plans import catalog

    r = random.Random(7)
    docs = [(i, " ".join(r.choices(["red", "blue", "green", "grey"], k=r.randint(0, 30))) if i % 11 else None, f"src{i % 23}") for i in range(700)]
    items = [(i, r.choice(["red blue", "green", "grey grey red", "none"])) for i in range(90)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = {i: (t or "").split() for i, t, _ in docs}
    mean, df = sum(map(len, words.values())) / len(docs), {t: sum(t in w for w in words.values()) for t in ("red", "blue", "green", "grey", "none")}
    want = {}
    for q, text in items:
        score = {i: sum(math.log(1 + (700 - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in text.split()) for i, w in words.items() if set(w) & set(text.split())}
        longest = sorted((-len(t) if t is not None else math.inf, i) for i, t, s in docs if s == f"src{q % 20}")
        for best in (sorted(score, key=lambda i: (-round(score[i], 12), i)), [i for _, i in longest]):
            for rank, i in enumerate(best[:20], 1):
                want[q, i] = want.get((q, i), 0) + 1 / (60 + rank)
    got = {(x["query_id"], x["id"]): x["score"] for x in catalog.queries()["R7_rrf"](spark, str(tmp_path)).collect()}
    assert {k for k in got if k[0] >= 40} and {q for q, _ in got} == {q for q, _ in items}
    assert all(abs(got.get(k, 0) - v) < 1e-8 for k, v in want.items()) and len(got) == len(want)


def test_communities_are_a_local_optimum(spark, sf):
    edges = graph.undirected(lifecycle._edges(spark, sf))
    e = [(r["src"], r["dst"], r["weight"]) for r in edges.collect()]
    of = {r["node"]: r["community"] for r in leiden.communities(edges).collect()}
    k, near, m = {}, {}, sum(w for *_, w in e)
    for a, b, w in e:
        for x, y in ((a, b), (b, a)):
            k[x] = k.get(x, 0) + w
            near.setdefault(x, {})[y] = w
    total = {}
    for x, c in of.items():
        total[c] = total.get(c, 0) + k[x]
    for x in of:  # no node gains by a move to a neighbour's community
        gain = lambda c: sum(w for y, w in near[x].items() if of[y] == c) - k[x] * (total[c] - (k[x] if c == of[x] else 0)) / (2 * m)  # noqa: B023,E731
        assert all(gain(of[y]) <= gain(of[x]) + 1e-6 for y in near[x])
    assert len(set(of.values())) < len(of)


def test_mmr_by_brute_force(spark, sf):
    rows = search.QUERIES["R11_mmr"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = {r["doc_id"]: set(r["w"]) for r in docs.select("doc_id", C.tokens(F.coalesce("text", F.lit(""))).alias("w")).collect()}
    scores = retrieval.ranked(retrieval.bm25(docs, search._queries(spark, sf)), ["query_id"]).where("rank <= 20")
    pools = {}
    for r in scores.collect():
        pools.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    same = lambda a, b: len(words[a] & words[b]) / len(words[a] | words[b]) if words[a] | words[b] else 0.0
    for query, pool in pools.items():
        top, picked = max(s for _, s in pool), []
        rest = sorted(pool, key=lambda x: (-x[1], x[0]))
        while rest and len(picked) < 5:
            value = lambda x: 0.7 * (x[1] / top if top > 0 else 0) - 0.3 * max((same(x[0], y) for y in picked), default=0.0)  # noqa: B023,E731
            best = max(value(x) for x in rest)
            chosen = next(x for x in rest if value(x) >= best - 1e-12)
            picked.append(chosen[0])
            rest.remove(chosen)
        assert [r["id"] for r in sorted((r for r in rows if r["query_id"] == query), key=lambda r: r["place"])] == picked


def test_merges_and_chains_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 50)
    keys = spark.createDataFrame([(k % 90, k % 7) for k in range(300)] + [(None, 1)] * 2, "a int, b int")
    merged = tables.upsert(keys, keys, ["a", "b"], rows=604)
    assert merged.rdd.getNumPartitions() == 13
    assert sorted(map(tuple, merged.collect()), key=str) == sorted({*((k % 90, k % 7) for k in range(300)), (None, 1)}, key=str)
    wide = keys.where("a IS NOT NULL").withColumn("v", F.lit("old"))
    newer = wide.where("a < 10").withColumn("v", F.lit("new"))
    got = tables.upsert(wide, newer, ["a"], rows=400)
    assert got.rdd.getNumPartitions() == 8 and {(r["a"], r["v"]) for r in got.collect()} == {(a, "new" if a < 10 else "old") for a in range(90)}
    rows = spark.createDataFrame([(k, k % 5, k // 2) for k in range(100)], "event_id int, user_id int, ts int").withColumn("ts", F.timestamp_seconds("ts"))
    plain, dealt = (memory.append_chain(rows.where("event_id % 2 = 0"), rows, by="user_id", rows=n)[1] for n in (None, 200))
    assert dealt.rdd.getNumPartitions() == 4 and sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))


def test_budget_that_skips(spark, sf):
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], len(r["text"] or "") // 4))
    for r in lifecycle.QUERIES["W7_skipping_budget"](spark, sf).collect():
        used, kept = 0, []
        for t, n in sorted(turns[r["conv_id"]]):
            if used + n <= 100:
                used, kept = used + n, [*kept, t]
        assert (r["kept"], r["used"]) == (kept, used)


def test_titles_by_brute_force(spark, sf):
    got = {r["id"]: int(r["fingerprint"], 16) for r in text_plans.QUERIES["D3_title_fingerprint"](spark, sf).collect()}
    titles = {r["id"]: "".join(c for c in r["title"].lower() if c.isalnum()) for r in text_plans._titles(spark, sf).collect()}
    grams = sorted({t[k : k + 4] for t in titles.values() for k in range(max(1, len(t) - 3))})
    h = {r["g"]: r["h"] for r in spark.createDataFrame([(g,) for g in grams], "g string").select("g", F.xxhash64("g").alias("h")).collect()}
    for i, t in titles.items():
        hashes = [h[t[k : k + 4]] for k in range(max(1, len(t) - 3))] if t else []
        assert got[i] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))
    kept = []
    for i in sorted(got):
        if all((got[i] ^ got[j]).bit_count() > 3 for j in kept):
            kept.append(i)
    assert sorted(r["id"] for r in text_plans.QUERIES["D4_greedy_titles"](spark, sf).collect()) == kept


def test_title_is_cleaned_once(spark):
    """A word, or all grams, taken anew for each gram and bit make the time of a title many times that of its length."""
    plan = spark.createDataFrame([("a title",)], "title string").select(intake.title_fingerprint("title").alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and plan.count("xxhash64") == 1
    odd = spark.createDataFrame([(None,), ("",), ("!!",), ("ab",), ("a-B",)], "title string").select(intake.title_fingerprint("title").alias("f")).collect()
    assert [r["f"] for r in odd[:3]] == [0, 0, 0] and odd[3]["f"] == odd[4]["f"] != 0


def test_greedy_keep_is_in_order(spark):
    fps = [0b0, 0b111, 0b111111, 0b1, -1]  # 0 drops 0b111 and 0b1; 0b111111 stays: it is near what went, not what stayed
    rows = spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "fp long, at int")
    kept = intake.greedy_keep(rows, "at")
    assert sorted(r["fp"] for r in kept.collect()) == [-1, 0, 0b111111]
    assert intake.greedy_keep(rows.limit(0), "at").count() == 0


def test_greedy_keep_equals_the_fold(spark):
    r = random.Random(6)
    for _ in range(3):
        base = [r.getrandbits(63) for _ in range(6)]
        data = [(b ^ sum(1 << k for k in r.sample(range(63), r.randint(0, 4))), r.randint(0, 60)) for b in base for _ in range(25)]
        kept = []
        first = {}
        for f, at in data:
            first[f] = min(at, first.get(f, at))
        for f in sorted(first, key=lambda f: (first[f], f)):
            if all((f ^ g).bit_count() > 3 for g in kept):
                kept.append(f)
        got = intake.greedy_keep(spark.createDataFrame(data, "fp long, at int"), "at")
        assert sorted(x["fp"] for x in got.collect()) == sorted(kept)


def test_triangles_by_brute_force(spark):
    r = random.Random(7)
    edges = {(r.randint(0, 30), r.randint(0, 30)) for _ in range(160)}
    near = {frozenset(e) for e in edges if e[0] != e[1]}
    want = {t for t in itertools.combinations(range(31), 3) if all(frozenset(x) in near for x in itertools.combinations(t, 2))}
    got = [tuple(x) for x in graph.triangles(spark.createDataFrame([*edges, *edges], "src long, dst long")).collect()]
    assert sorted(got) == sorted(want)
    star = spark.range(1, 20_000).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    assert graph.triangles(star).count() == 0


def test_name_links_by_brute_force(spark):
    r = random.Random(8)
    stems = ["Acme Holding", "International Paper", "Ünited Steel", "北京大学", "A", "Anna Schmidt"]
    names = {s + r.choice(["", " Ltd", " ltd", "s", " AG", " Co"]) for s in stems for _ in range(8)} | {"", "x" * 300, "x" * 299}
    df = spark.createDataFrame([(n,) for n in [*names, *names, None]], "name string")
    sets = {}
    for n in names - {""}:
        p = "\x02\x02" + n.lower() + "\x03\x03"
        sets[n] = {p[k : k + 3] for k in range(len(p) - 2)}
    for share in (60, 80):
        want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])}
        got = {(x["a"], x["b"]): x["similarity"] for x in similar_names.name_links(df, share).collect()}
        assert set(got) == want and all(abs(v - len(sets[a] & sets[b]) / len(sets[a] | sets[b])) < 1e-12 for (a, b), v in got.items())
    asked = df.where("name like 'Acme%'")
    found = {(x["asked"], x["name"]) for x in similar_names.name_candidates(df, asked, 60).collect()}
    mine = [n for n in sets if n.startswith("Acme")]
    assert found == {(a, b) for a in mine for b in sets if 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b])}


def test_near_state_of_a_stream(spark, sf):
    near = {r["id"]: r["near"] for r in streams.QUERIES["Y6_near_state"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.xxhash64("event_type", F.floor("value")).alias("fp")).orderBy("t", "event_id").collect()
    seen = []
    for r in rows:
        assert near[r["event_id"]] == any(((r["fp"] ^ f) & (2**64 - 1)).bit_count() <= 3 and r["t"] // 1000 - t // 1000 <= 3_600_000 for f, t in seen)
        seen.append((r["fp"], r["t"]))


def test_vector_links_in_blocks(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    pairs = lambda rows: {(r["src"], r["dst"]): round(r["weight"], 9) for r in retrieval.vector_links(e, 0.3, "label", rows=rows).collect()}
    whole, v = pairs(10**6), {r["vec_id"]: (r["label"], r["embedding"]) for r in e.collect()}
    assert pairs(3) == whole
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, b in itertools.combinations(sorted(v), 2):
        if v[a][0] == v[b][0]:
            c = dot(v[a][1], v[b][1]) / math.sqrt(dot(v[a][1], v[a][1]) * dot(v[b][1], v[b][1]))
            assert abs(c - 0.3) < 1e-9 or ((a, b) in whole) == (c >= 0.3)


def test_text_functions_on_odd_values(spark):
    assert one(spark, None, T.filled_by_script) is False and one(spark, "<div id='root'> </div>" + "x" * 600, T.filled_by_script) is True
    assert one(spark, "One. Two three four", lambda x: T.truncate_at_sentence(x, 100)) == "One. Two three four"
    assert one(spark, "a" * 39 + "." + "b" * 8 + " " * 40, lambda x: T.truncate_at_sentence(x, 11)) == "a" * 39 + "...."
    assert one(spark, "a b c d e f g h i j k", lambda x: T.head_and_tail(x, 10)) == "a b c d e f g" + T.CUT_MARK + "i j k"
    assert one(spark, "no time", T.parse_iso) is None and one(spark, None, T.parse_iso) is None
    assert one(spark, "a::b::c::call::count", T.usage_field).asDict() == {"label": "a::b::c", "call_point": "call", "metric": "count"} and one(spark, "a::b", T.usage_field) is None
    assert one(spark, "python.org", lambda x: T.name_uuid(x)) == "886313e1-3b8a-5372-9b90-0c9aee199e5d"
    assert one(spark, "正文。来源：甲\n文章原文\n\n\n\n再见近期热门视频你会关注 x", T.strip_feed_noise) == "正文。\n\n再见"


def test_as_of_and_cycles(spark):
    rows = spark.createDataFrame([(1, 1, 10), (1, 1, 11), (1, 2, 12), (2, 5, 13)], "by int, s int, k int").withColumn("at", F.timestamp_seconds("s"))
    assert {r["k"]: r["previous"] for r in as_of.previous(rows, "by", "at", "k").collect()} == {10: None, 11: None, 12: 11, 13: None}
    merges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (7, 7)], "id int, merged_into int")
    assert sorted(r["id"] for r in graph.on_cycles(merges).collect()) == [1, 2, 3, 7]


def test_incremental_update_keeps_names(spark):
    members = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 30), (9, 40)], "node int, community int")
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 5, 1.0), (3, 6, 1.0), (3, 4, 1.0), (7, 8, 1.0)], "src int, dst int, weight double")
    waiting = spark.createDataFrame([(5,), (6,), (7,), (8,)], "node int")
    changes = communities.incremental_update(members, edges, waiting)
    assert {(r["node"], r["before"], r["after"]) for r in changes.collect()} == {(5, None, "10"), (6, None, "20"), (4, "30", "20"), (7, None, "new:7"), (8, None, "new:7")}
    reports = spark.createDataFrame([(10, False), (20, False), (40, False)], "community int, stale boolean")
    assert {r["community"]: r["stale"] for r in communities.mark_stale(members, changes, reports).collect()} == {"10": True, "20": True, "40": False}


def test_batches_that_are_tried_again_are_written_once(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    assert streams.QUERIES["Y5_dedup_stream"](spark, sf).count() == e.select("user_id", "event_type").distinct().count()


def test_no_local_folder_on_a_cluster():
    class Fake:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)

    import pytest

    with pytest.raises(ValueError):
        tables.shared_dir(Fake)


def test_budget_function_equals_the_fold(spark):
    r = random.Random(9)
    rows = [(g, k, r.choice([None, 0, 5, 30, 60, 120])) for g in range(12) for k in range(r.randint(1, 15))]
    df = spark.createDataFrame(rows, "g long, k long, n long").repartition(3)
    fold = {x["g"]: (x["kept"], x["used"]) for x in context.fit_budget(df, 100, "g", "k", "n").collect()}
    got = {}
    for x in table_functions.fit_budget(df, 100, "g", "k", "k", "n").collect():
        got.setdefault(int(x["name"]), []).append((int(x["item"]), x["used"]))
    assert {g: ([i for i, _ in sorted(v)], max(u for _, u in v)) for g, v in got.items()} == {g: v for g, v in fold.items() if v[0]}


def test_cycles_follow_only_what_is_merged_into(spark, monkeypatch):
    """Items that nothing is merged into are not carried through the rounds, and rounds end when no chain is left."""
    made, written = [], graph.written

    def counted(df):
        made.append(out := written(df))
        return out

    monkeypatch.setattr(graph, "written", counted)
    star = spark.range(10, 1010).selectExpr("id", "id % 5 AS merged_into")
    assert graph.on_cycles(star).count() == 0 and len(made) == 1 and made[0].count() == 0
    ring = star.unionByName(spark.createDataFrame([(0, 1), (1, 0), (2, 2), (3, 4)], "id long, merged_into long"))
    assert sorted(r["id"] for r in graph.on_cycles(ring).collect()) == [0, 1, 2]
