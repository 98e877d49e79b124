"""The keyed table: what it holds after changes, failures, repeated batches, and a stream that is started again."""

import random

import pytest
from pyspark.sql import functions as F

from loomstone.sources import keyed

SCHEMA = "k long, v string, n int"


def rows(table):
    return sorted(((r["k"], r["v"], r["n"]) for r in table.read().collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    return keyed.KeyedTable(spark, str(tmp_path / "t"), ["k"], SCHEMA, buckets=5)


def df(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_changes_against_a_plain_dict(spark, table):
    r, held = random.Random(1), {}
    for step in range(10):
        data = {r.choice([None, *range(40)]): (f"v{step}-{r.randint(0, 9)}", r.choice([None, step])) for _ in range(12)}
        new = df(spark, [(k, *v) for k, v in data.items()])
        kind = ("upsert", "insert", "delete", "fill", "firm")[step % 5]
        if kind == "upsert":
            assert table.upsert(new, f"b{step}")
            held |= data
        elif kind == "insert":
            assert table.insert(new, f"b{step}")
            held = data | held
        elif kind == "delete":
            assert table.delete(new.select("k"), f"b{step}")
            held = {k: v for k, v in held.items() if k not in data}
        elif kind == "fill":
            assert table.fill(new, ["n"], f"b{step}")
            held = {k: (v, n if n is not None or k not in data else data[k][1]) for k, (v, n) in held.items()}
        else:
            assert table.upsert(new, f"b{step}", keep_old="n >= 2")
            held = {k: held[k] if k in held and (held[k][1] or 0) >= 2 else data.get(k, held.get(k)) for k in held | data}
        assert rows(table) == sorted(((k, *v) for k, v in held.items()), key=str), kind
    again = keyed.KeyedTable(spark, table.path, ["k"])
    assert rows(again) == rows(table) and not again.upsert(df(spark, [(1, "x", 9)]), "b0")
    assert sorted(x["k"] for x in again.lookup(df(spark, [(k, "", 0) for k in range(5)])).collect()) == sorted(k for k in held if k in range(5))


def test_only_touched_buckets_are_written(spark, table):
    table.upsert(df(spark, [(k, "a", 1) for k in range(50)]))
    before = table.version()["folders"]
    table.upsert(df(spark, [(7, "b", 2)]))
    after = table.version()["folders"]
    assert len(before) == 5 and sum(before[b] != after[b] for b in before) == 1
    plan = table.lookup(df(spark, [(7, "", 0)]))._jdf.queryExecution().toString()
    assert sum(f in plan for f in after.values()) <= 1
    assert table.vacuum(1) == 1 and table.read().count() == 50


def test_a_failure_before_the_swap_leaves_the_old_table(spark, table, monkeypatch):
    table.upsert(df(spark, [(1, "a", 1)]), "first")
    monkeypatch.setattr(keyed.Files, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.upsert(df(spark, [(1, "b", 2), (2, "c", 3)]), "second")
    monkeypatch.undo()
    assert rows(table) == [(1, "a", 1)] and not table.done("second")
    assert table.upsert(df(spark, [(1, "b", 2), (2, "c", 3)]), "second") and not table.upsert(df(spark, [(1, "z", 9)]), "second")
    assert rows(table) == [(1, "b", 2), (2, "c", 3)]
    table.vacuum(1)
    assert table.done("first") and table.done("second") and rows(table) == [(1, "b", 2), (2, "c", 3)]


def test_a_note_that_was_not_made_is_made_up(spark, table, monkeypatch):
    monkeypatch.setattr(table, "_note", lambda v: None)  # the writer dies after the swap
    table.upsert(df(spark, [(1, "a", 1)]), "first")
    monkeypatch.undo()
    assert not table.upsert(df(spark, [(1, "b", 2)]), "first")
    table.upsert(df(spark, [(2, "b", 2)]), "second")
    assert table.done("first") and rows(table) == [(1, "a", 1), (2, "b", 2)]


def test_a_second_writer_is_refused(spark, table):
    stale = table.version()
    table.upsert(df(spark, [(1, "a", 1)]))
    with pytest.raises(keyed.Conflict):
        table._publish(stale | {"number": stale["number"] + 1})
    assert rows(table) == [(1, "a", 1)] and rows(keyed.KeyedTable(spark, table.path, ["k"])) == [(1, "a", 1)]


def test_readers_keep_their_version_and_columns_are_added(spark, table):
    table.upsert(df(spark, [(1, "a", 1)]))
    old, number = table.read(), table.version()["number"]
    table.replace(df(spark, [(2, "b", 2), (2, "b", 2)]))
    assert [r["k"] for r in old.collect()] == [1] and [r["k"] for r in table.read(number).collect()] == [1] and rows(table) == [(2, "b", 2)]
    table.add_columns({"score": "double", "v": "string"})
    assert table.read().columns == ["k", "v", "n", "score"] and table.read().first()["score"] is None
    table.upsert(df(spark, [(3, "c", 3)]))
    assert {r["k"]: r["score"] for r in table.read().collect()} == {2: None, 3: None}
    table.replace(df(spark, []))
    assert table.read().count() == 0
    with pytest.raises(ValueError):
        keyed.KeyedTable(spark, table.path, ["v"])
    with pytest.raises(ValueError):
        keyed.KeyedTable(spark, table.path + "-none", ["k"])


def test_a_stream_counts_each_batch_once(spark, tmp_path):
    source = tmp_path / "in"
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), ["k"], "k long, n long", buckets=3)

    def count(batch, label):
        def add(old, new):
            return old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))

        return table.commit(batch.groupBy("k").agg(F.count(F.lit(1)).alias("n")), add, label)

    fail = {"after": 1}

    def shaky(batch, label):
        count(batch, label)
        if fail["after"] == 0:
            fail["after"] = -1
            raise OSError("lost after the commit, before the stream's own note")
        fail["after"] -= 1
        return True

    for part in range(4):
        spark.range(part, part + 10).select((F.col("id") % 5).alias("k")).coalesce(1).write.mode("append").parquet(str(source))
    stream = lambda: spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(str(source))
    go = lambda: keyed.stream_into(stream(), table, "s", str(tmp_path / "state"), write=shaky).trigger(availableNow=True).start().awaitTermination()
    with pytest.raises(Exception, match="lost|Exception"):
        go()
    go()
    assert {r["k"]: r["n"] for r in table.read().collect()} == dict.fromkeys(range(5), 8)
