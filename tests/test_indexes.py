"""The vector index and the posting index against full searches, and the retry stream against a plain simulation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.operators import posting_index, retrieval, vector_index

# ---- vectors


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(1)
    centres = r.normal(0, 1, (12, 16))
    rows = [(k, (centres[k % 12] + r.normal(0, 0.35, 16)).tolist()) for k in range(1200)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, rows[5][1]), (2003, rows[5][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.where("vec_id % 40 = 0 OR vec_id = 5").select(F.col("vec_id").alias("query_id"), "embedding")


def ranks(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["similarity"], 9)) for r in df.collect())


def test_exact_search_equals_the_scan(spark, vectors, queries, tmp_path):
    index = vector_index.VectorIndex.build(vectors, str(tmp_path / "i"), lists=20)
    assert index.rows().count() == vectors.count() and {r["id"] for r in index.rows([-1]).collect()} == {2000, 2001}
    near = retrieval.similarities(vectors, queries).withColumn("similarity", F.round("similarity", 12))
    want = retrieval.ranked(near, ["query_id"], "similarity").where("rank <= 10")
    assert ranks(index.search(queries, 10)) == ranks(want) == ranks(vector_index.VectorIndex(spark, index.path).search(queries, 10, block=7))
    assert ranks(index.search(queries, 10, threshold=0.8)) == [x for x in ranks(want) if x[3] >= 0.8]
    assert index.search(queries.limit(0), 5).count() == 0


def test_probes_reach_the_recall_and_prune(vectors, queries, tmp_path):
    index = vector_index.VectorIndex.build(vectors, str(tmp_path / "i"), lists=24)
    exact, found = index.search(queries, 10), index.search(queries, 10, probes=6)
    seen = vector_index.recall(found, exact).first()
    assert seen["queries"] == queries.count() and seen["recall"] >= 0.9
    for target in (0.5, 0.95):
        probes = index.probes_for(queries, 10, target)
        assert vector_index.recall(index.search(queries, 10, probes), exact).first()["recall"] >= target - 0.02 and probes < 24
    few = index.search(queries.where("query_id = 5"), 10, probes=2)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r["list"] for r in index.rows([3, 4]).select("list").distinct().collect()} <= {3, 4}


def test_every_row_is_in_its_nearest_list(vectors, tmp_path):
    index = vector_index.VectorIndex.build(vectors, str(tmp_path / "i"), lists=9, sample=50)  # fitted on few rows, holds all
    for r in index.rows().where("list >= 0").collect():
        v = np.array(r["v"]) / np.linalg.norm(r["v"])
        assert index.centroids[r["list"]] @ v >= (index.centroids @ v).max() - 1e-9


def test_index_of_nothing(spark, vectors, queries, tmp_path):
    none = vector_index.VectorIndex.build(vectors.limit(0), str(tmp_path / "a"))
    assert none.search(queries, 3).count() == 0
    dark = vector_index.VectorIndex.build(vectors.where("vec_id in (2000, 2001)"), str(tmp_path / "b"))
    assert dark.search(queries, 3).where("similarity = 0").count() == 2 * queries.count()


# ---- postings


def texts(seed, ids):
    r = random.Random(seed)
    return [(k, " ".join(r.choices([f"w{n}" for n in range(60)], weights=[1 / (n + 1) for n in range(60)], k=r.choice([0, 3, 20, 80])))) for k in ids]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def table_of(df):
    return {(r["query_id"], r["id"]): round(r["score"], 9) for r in df.collect()}


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "w0 w3 w3 w50"), (2, "W7"), (3, "nothing here"), (4, ""), (5, None), (6, "w1 w2 w4 w8 w16 w32")], "query_id long, query string")


def test_updates_equal_a_rebuild(spark, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(posting_index, "BLOCK", 16)
    held = dict(texts(1, range(300)))
    index = posting_index.PostingIndex(spark, str(tmp_path / "p"))
    assert index.add(docs_of(spark, list(held.items())), batch="a") and index.top(asked, 5).count() > 0
    for step in range(3):
        new = dict(texts(10 + step, range(step * 70, step * 70 + 90)) + texts(20 + step, range(1000 + step * 30, 1020 + step * 30)))
        gone = list(range(step * 40, step * 40 + 15))
        assert index.add(docs_of(spark, list(new.items())), batch=f"add-{step}") and index.delete(docs_of(spark, [(k, "") for k in [*gone, 99999]]), batch=f"gone-{step}")
        assert not index.add(docs_of(spark, [(0, "w0")]), batch=f"add-{step}")
        held = {k: v for k, v in (held | new).items() if k not in gone}
    whole = docs_of(spark, list(held.items()))
    want = table_of(retrieval.bm25(whole, asked))
    fresh = posting_index.PostingIndex(spark, str(tmp_path / "fresh"))
    fresh.add(whole)
    best = retrieval.ranked(retrieval.bm25(whole, asked).withColumn("score", F.round("score", 6)), ["query_id"]).where("rank <= 5")
    order = lambda df: sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())
    for one in (index, fresh):
        assert (one.version()["docs"], one.version()["words"]) == (len(held), sum(len(t.split()) for t in held.values()))
        assert table_of(one.scores(asked)) == want
        assert order(one.top(asked, 5)) == order(one.top(asked, 5, first=1)) == order(best)
    df = {r["term"]: r["df"] for r in index._part("terms", "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").collect()}
    assert df == {r["term"]: r["n"] for r in retrieval.postings(whole, "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    index.compact()
    assert table_of(index.scores(asked)) == want and order(index.top(asked, 5)) == order(best) and index.vacuum() == 7 and table_of(index.scores(asked)) == want


def test_blocks_are_skipped(spark, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(posting_index, "BLOCK", 16)
    index = posting_index.PostingIndex(spark, str(tmp_path / "p"))
    index.add(docs_of(spark, texts(3, range(2000))))
    _, read = index._search(asked, 3, "query_id", "query", 4, 6)
    every = index._part("blocks", "term string, block string").join(index._asked(index.version(), asked, "query_id", "query"), "term").select("query", "block").distinct()
    assert read.count() == read.distinct().count() < 0.7 * every.count()


def test_a_lost_segment_leaves_the_index(spark, asked, tmp_path, monkeypatch):
    index = posting_index.PostingIndex(spark, str(tmp_path / "p"))
    assert index.top(asked, 3).count() == 0
    index.add(docs_of(spark, [(1, "w0 w0"), (1, ""), (None, "w0")]), batch="a")
    before = table_of(index.scores(asked))
    monkeypatch.setattr(index, "_publish", lambda v: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        index.add(docs_of(spark, [(2, "w0")]), batch="b")
    monkeypatch.undo()
    assert table_of(index.scores(asked)) == before and index.version()["docs"] == 1
    assert index.add(docs_of(spark, [(2, "w0")]), batch="b") and index.version()["docs"] == 2


def test_comparisons_in_chunks_equal_the_column_function(spark, monkeypatch):
    """Odd vectors, equal ones, ties by id, blocks of queries; no pair is made for a count, none beyond a task's best for the nearest."""
    import random

    from pyspark.sql import Window

    from loomstone.functions.columns import cosine

    r = random.Random(3)
    some = lambda: [r.choice([0.0, 1.0, 2.0, -1.0, 0.3]) for _ in range(3)]
    rows = [(k, some()) for k in range(60)] + [(60, None), (61, []), (62, [0.0] * 3), (63, [1.0, 2.0]), (64, [1.0, None, 2.0]), (65, [2.0, 1.0]), (66, [float("nan"), 1.0, 1.0]), (None, [1.0] * 3), (2**60 + 1, some())]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = e.where("vec_id % 5 = 0 or vec_id > 58").select(F.col("vec_id").alias("query_id"), "embedding")
    monkeypatch.setattr(retrieval, "CHUNK", 7)
    every = e.alias("e").crossJoin(q.alias("q")).select("query_id", F.col("vec_id").alias("id"), cosine("e.embedding", "q.embedding").alias("similarity"))
    told = lambda df: sorted(map(repr, map(tuple, df.collect())))
    brute = every.where("similarity >= 0")
    assert told(retrieval.similarities(e, q, 0.0, block=9)) == told(brute)
    ranked = lambda df, k: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= k)
    assert told(retrieval.knn(e, q, 4, 0.0)) == told(ranked(brute, 4))
    assert told(retrieval.knn(e, q, 4, 0.0, others=True)) == told(ranked(brute.where("id IS NULL OR id <> query_id"), 4))
    assert told(retrieval.similar_counts(e, q, 0.0)) == told(every.where("similarity > 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("similar")))
    # Ranked as rounded: of two that agree to one digit the smaller id is first. In a task only its k best are rows.
    near = spark.createDataFrame([(1, [1.0, 0.31]), (2, [1.0, 0.3]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [x["id"] for x in retrieval.knn(near, asked, 1).collect()] == [2] and [x["id"] for x in retrieval.knn(near, asked, 1, digits=1).collect()] == [1]
    assert "NestedLoop" not in retrieval.knn(e, q, 4)._jdf.queryExecution().toString()


def test_lexical_scores_in_tasks_equal_a_plain_count(spark, asked, monkeypatch):
    """Odd texts, null ids, equal documents, queries in blocks and chunks; a task keeps its best only, and no posting is shuffled."""
    import math
    from collections import Counter

    held = dict(texts(5, range(150))) | {200: None, 201: "", 202: "W0, w0! (w3)", 203: "w0 w3", 204: "w0 w3", 205: "w0 w3", None: "w50 w7"}
    docs = docs_of(spark, list(held.items())).repartition(3)
    words = {k: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split() for k, t in held.items()}
    mean, df, want = sum(map(len, words.values())) / len(words), Counter(t for w in words.values() for t in set(w)), {}
    for q in asked.collect():
        for k, w in words.items():
            common = [t for t in (q["query"] or "").lower().split() if t in w]
            if common:
                want[q["query_id"], k] = sum(math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in common)
    monkeypatch.setattr(retrieval, "CHUNK", 11)
    monkeypatch.setattr(retrieval, "CELLS", 64)
    monkeypatch.setattr(retrieval, "GROUP", 2)
    for block in (2, 16384):
        assert table_of(retrieval.bm25(docs, asked, block=block)) == {x: round(s, 9) for x, s in want.items()}
        got = retrieval.bm25_top(docs, asked, 4, digits=3, block=block)
        best = {q: sorted(((-math.floor(s * 1000 + 0.5) / 1000, -1 if k is None else k) for (p, k), s in want.items() if p == q))[:4] for q, _ in want}
        assert sorted((r["query_id"], r["rank"], -1 if r["id"] is None else r["id"], -r["score"]) for r in got.collect()) == sorted((q, n, k, s) for q, x in best.items() for n, (s, k) in enumerate(x, 1))
        assert sum(map(len, best.values())) <= retrieval.bm25(docs, asked, block=block).count()
    assert "Exchange" not in retrieval.bm25(docs, asked)._jdf.queryExecution().executedPlan().toString()
    assert retrieval.bm25_top(docs, asked.limit(0), 3).count() == retrieval.bm25(docs.limit(0), asked).count() == 0


def test_a_segment_is_written_in_bounded_tasks(spark, tmp_path, monkeypatch):
    """More postings make more tasks, not larger ones, and a document is counted where it is read."""
    monkeypatch.setattr(posting_index, "PIECE", 20)
    index = posting_index.PostingIndex(spark, str(tmp_path / "p"))
    index.add(docs_of(spark, texts(3, range(300))))
    for _ in range(2):
        shard = max((tmp_path / "p" / index.version()["segments"][0] / "postings").iterdir(), key=lambda x: len(list(x.glob("*.parquet"))))
        assert len(list(shard.glob("*.parquet"))) > 1
        index.compact()
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, None), (3, [])], "id long, words array<string>")
    assert sorted((r["id"], r["length"], r["terms"] and sorted(zip(r["terms"], r["counts"]))) for r in posting_index.counted(rows).collect()) == [(1, 3, [("a", 1), ("b", 2)]), (2, None, None), (3, 0, [])]
    assert "Exchange" not in posting_index.counted(rows)._jdf.queryExecution().executedPlan().toString()


def test_a_term_is_one_row_of_its_block_and_scores_are_made_there(spark, asked, tmp_path, monkeypatch):
    """Postings of a block's term are no rows of their own, nor are scores that cannot be among the best; names are strings, queries go in parts, and
    equal documents tie, also where one was dead before."""
    monkeypatch.setattr(posting_index, "QUERIES", 2)
    monkeypatch.setattr(posting_index, "GROUP", 1)
    index = posting_index.PostingIndex(spark, str(tmp_path / "p"), id_kind="string")
    held = {f"d{k}": t for k, t in texts(7, range(300))} | {f"e{k}": "w0 w3 w3" for k in range(20)}
    named = lambda x: spark.createDataFrame(list(x.items()), "doc_id string, text string")
    index.add(named({k: "w0 w1 w2" for k in list(held)[:50]} | {"gone": "w0 w3 w3"}))
    index.add(named(held))
    index.delete(named({"gone": ""}))
    whole = named(held)
    order = lambda df: sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())
    best = retrieval.ranked(retrieval.bm25(whole, asked).withColumn("score", F.round("score", 6)), ["query_id"]).where("rank <= 4")
    assert order(index.top(asked, 4)) == order(best) and table_of(index.scores(asked)) == table_of(retrieval.bm25(whole, asked))
    every = index.postings()
    assert {tuple(r) for r in every.collect()} == {(r["term"], r["id"], r["tf"], r["length"]) for r in retrieval.postings(whole, "doc_id", "text").collect()}
    rows = spark.read.parquet(str(tmp_path / "p" / index.version()["segments"][1] / "postings")).count()
    assert rows < 0.5 * every.count()
    now = index.version()
    weights = index._asked(now, asked, "query_id", "query")
    pairs = weights.join(index._part("blocks", "term string, block string", now), "term").select("query", "block").distinct().withColumn("least", F.lit(None).cast("double"))
    made = index._scored(now, weights, pairs, index._gone(now), 4)
    assert made.count() < 0.5 * index.scores(asked).count()
    assert made.where("id = 'gone'").count() == 0
