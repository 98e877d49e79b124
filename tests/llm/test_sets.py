"""Centroids, phrases and the Jaccard join against their SQL and plain recomputation, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import centroids, jaccard, phrases, queries
from loomstone.llm.common import Bloom, WordHashes, bloom

DOCS = "doc_id long, text string, lang string, n long, key string, number int, salt int, f int"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    theirs = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in theirs.description]
    ours = queries.QUERIES[name](spark, sf)
    assert sorted(names) == sorted(ours.columns)
    assert sorted(map(str, (tuple(r) for r in ours.select(*names).collect()))) == sorted(map(str, theirs.fetchall()))


def plain_kmeans(rows, k, rounds, dims):
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()))
    c = [v for _, v in order[:k]]
    far = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        mine = [[v for _, v in kept if far(v)[1] == j] for j in range(len(c))]
        c = [[sum(x) // len(m) for x in zip(*m)] if m else c[j] for j, m in enumerate(mine)]
    found = [(i, *far(v)) for i, v in kept]
    inside = Counter()
    for _, d, j in found:
        inside[j] += d
    fits = lambda x: x if x < 1 << 63 else None
    return sorted([(i, j, fits(d), fits(inside[j]), fits(sum(inside.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found], key=str)


@pytest.mark.parametrize("kind", ["small", "large"])
def test_clusters_on_odd_vectors(spark, kind):
    r = random.Random(1)
    rows = [(i, [r.gauss(i % 3, 0.3) for _ in range(4)]) for i in range(60)] + [(None, [0.5] * 4), (7, [0.25, -0.25, 0.0, 1.0]), (7, [0.25, -0.25, 0.0, 1.0]), (90, None), (91, []), (92, [1.0] * 3), (93, [1.0, None, 2.0, 3.0]), (94, [1.0, float("nan"), 2.0, 3.0]), (95, [float("inf"), 0.0, 0.0, 0.0])]
    if kind == "large":
        rows += [(100, [1e300, -1e306, 0.0, 1.5]), (101, [3e9, 1e9, -7e8, 2.0]), (102, [70000.5, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "ints": F.lit(1), "cluster": F.lit(2)})
    got = centroids.cluster_vectors(df, k=4, rounds=5, dims=4, leading=2)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_kmeans(rows, 4, 5, 4)
    few = df.where("vec_id < 2")
    assert sorted(map(tuple, centroids.cluster_vectors(few, k=4, rounds=5, dims=4, leading=2).collect()), key=str) == plain_kmeans(rows[:2], 4, 5, 4)
    assert centroids.cluster_vectors(df.limit(0), dims=4, leading=2).count() == 0


def test_filter_is_exact_and_prunes():
    rng = np.random.default_rng(1)
    basis = rng.normal(0, 300, (5, 32))
    v = np.floor(rng.normal(0, 1, (3000, 5)) @ basis + rng.normal(0, 20, (3000, 32))).astype(np.int64)
    c = [x.tolist() for x in v[:16]]
    c[9] = c[4]  # a tie goes to the smaller number
    rotation = centroids.Rotation(v[:500].astype(float), 32, 6)
    lead, rest = rotation.apply(v)
    cluster, far, verified = centroids.nearest(v, lead, rest, c, rotation)
    d = ((v[:, None, :] - np.array(c)[None]) ** 2).sum(2)
    assert (cluster == d.argmin(1)).all() and (far == d.min(1)).all() and 9 not in cluster and verified < 0.2 * d.size
    for x in (0, 5, -5, 2**31, -(2**31), 2**70 + 3, -(2**70) - 3):
        assert sum(y << (32 * k) for k, y in enumerate(centroids.limbs(x))) == x


def plain_phrases(rows, longest, least, top, share):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", *w[a : a + m]) for m in range(1, longest + 1) for a in range(len(w) - m + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    over = Counter()
    for p, a in cand.items():
        for m in range(2, len(p) - 1):
            for at in range(1, len(p) - m + 1):
                q = (p[0], *p[at : at + m])
                over[q] = max(over[q], a)
    out = []
    for lang in {p[0] for p in cand}:
        rows = []
        for p, a in cand.items():
            if p[0] == lang and 100 * over[p] < share * a:
                s, k = min((1000 * a * n[lang] // (f[p[: k + 1]] * f[(lang, *p[k + 1 :])]), k) for k in range(1, len(p) - 1))
                rows.append((-s, -a, " ".join(p[1:]), f[p[: k + 1]], f[(lang, *p[k + 1 :])]))
        rows.sort(key=lambda r: (r[0], r[1], r[2].encode()))
        out += [(lang, i + 1, t, -a, l, r, n[lang], -s) for i, (s, a, t, l, r) in enumerate(rows[:top])]
    return sorted(out)


def random_texts(seed, count=150):
    r = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "ÉCOLE", "école", "a\x0bb", "x y", "\x85", "日本", ";", ",", "\n", "\t", "end.", "ok?"]
    return [(" ".join(r.choices(words, weights=range(17, 0, -1), k=r.randint(0, 30))), r.choice(["en", "de", None, "und"])) for _ in range(count)]


@pytest.mark.parametrize("least,top,share,longest", [(1, 50, 100, 5), (4, 2000, 100, 5), (3, 7, 60, 3), (2, 2000, 1000, 4)])
def test_phrases_by_brute_force(spark, least, top, share, longest):
    rows = [*random_texts(1), (None, "en"), ("", "en"), ("one two " * 20000, "en"), ("same text here", "fr"), ("same text here", "fr")]
    docs = spark.createDataFrame([(k, t, lang, 1, "x", 2, 3, 4) for k, (t, lang) in enumerate(rows)], DOCS).repartition(3)
    got = phrases.collocations(docs, longest, least, top, share)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, longest, least, top, share)


def test_windows_end_before_rare_pairs_only(spark):
    """The filter shortens windows; one that lets everything through gives the same phrases."""
    docs = spark.createDataFrame([(k, t, lang, 1, "x", 2, 3, 4) for k, (t, lang) in enumerate(random_texts(2))], DOCS)
    source = phrases._source(docs, "lang", "text")
    often = phrases.pair_counts(source).where("f >= 12").select("h")
    few = phrases.lead_windows(source, 5, bloom(often, "h"))
    all_ = phrases.lead_windows(source, 5, Bloom(np.full(16, ~np.uint64(0))))
    assert few.count() < all_.count() and few.agg(F.sum("n")).first() == all_.agg(F.sum("n")).first()
    assert phrases.collocations(docs.limit(0)).count() == 0


def plain_sets(rows, share, width):
    sets = []
    for _, t in rows:
        w = re.findall("[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({" ".join(w[a : a + width]) for a in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= share * len(a | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return sorted(out, key=str)


def near_copies(seed, families=12):
    r, rows = random.Random(seed), []
    for f in range(families):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.choice([3, 5, 12, 60, 200]))]
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = f"v{r.randint(0, 9999)}"
            rows.append((r.randint(0, 400), " ".join(w + ["common passage that many texts share here"] * r.randint(0, 1))))
    return rows


@pytest.mark.parametrize("share,width,sketch", [(85, 4, 16), (60, 4, 6), (95, 2, 16)])
def test_similar_documents_by_brute_force(spark, share, width, sketch):
    odd = [(1, None), (2, ""), (3, " \t\n"), (4, "A b C"), (5, "a B c"), (None, "no id at all here"), (None, "no id at all here"), (6, "no id at all HERE"), (None, "alone without an id"), (7, "x y z q w"), (8, "go on " * 20000), (8, "go on " * 20000), (8, "something else entirely")]
    rows = near_copies(share) + odd
    docs = spark.createDataFrame([(d, t, "en", 1, "x", 2, 3, 4) for d, t in rows], DOCS).repartition(3)
    got = jaccard.similar_documents(docs, share, width, sketch=sketch)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_sets(rows, share, width)


def test_similar_documents_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert jaccard.similar_documents(docs).count() == 0
    with pytest.raises(ValueError):
        jaccard.similar_documents(docs, share=0)


def test_prefixes_meet_under_every_order():
    r, known = random.Random(3), WordHashes()
    classes = np.array([r.randint(0, 9) for _ in range(1 << 10)], np.uint8)
    met = 0
    for _ in range(400):
        w = [f"w{r.randint(0, 60)}" for _ in range(r.randint(4, 80))]
        v = [x if r.random() > 0.02 else "new" for x in w]
        a, b = (jaccard.shingles(" ".join(x), known) for x in (w, v))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 85 * (len(a) + len(b) - common):
            met += 1
            assert all(len(np.intersect1d(x, y)) for x, y in zip(jaccard.prefixes(a, classes, 85), jaccard.prefixes(b, classes, 85)))
    assert met > 50


def test_texts_pass_through_workers_once(spark, monkeypatch):
    """A kept text is not sent beside itself; rows that are told apart stay in the JVM; the code's table is made in parts."""
    import tracemalloc

    from loomstone.llm import common, simhash

    seen, real = [], common.arrow_map
    monkeypatch.setattr(common, "arrow_map", lambda df, fn, schema: (seen.append(df.columns), real(df, fn, schema))[1])
    docs = spark.createDataFrame([(1, "a b c d e"), (2, None), (3, "")], "doc_id long, text string")
    got = common.map_text(docs, "text", lambda texts: [[len(t) for t in texts]], [("n", "int")], ["doc_id", "text"])
    assert sorted(map(tuple, got.collect())) == [(1, "a b c d e", 9), (2, None, 0), (3, "", 0)] and seen == [["doc_id", "text"]]
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [1, 2] and seen[1] == ["rank", common.TEXT]
    tracemalloc.start()
    simhash.golay.__wrapped__()
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
