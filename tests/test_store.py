"""Bucketed tables: what a change rewrites, who wins, what stays readable."""

import threading

import pytest
from pyspark.sql import functions as F

from loregrid.sources.store import Conflict, Store, bucket, bucket_of


@pytest.fixture()
def store(spark, tmp_path):
    found = Store(spark, str(tmp_path / "s"), keep=2, buckets=8)
    found.replace("t", spark.range(200).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v")), "k")
    return found


def files(tmp_path):
    return {str(p) for p in (tmp_path / "s/t/data").rglob("*.parquet")}


def values(store):
    return {r.k: r.v for r in store.read("t").collect()}


def test_buckets_are_the_same_on_the_driver(spark):
    keys = ["", "a", "é", None, "x" * 1000]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", bucket("k", 13).alias("b")).collect()
    assert {r.k: r.b for r in rows} == {k: bucket_of(k, 13) for k in keys}


def test_one_key_rewrites_one_bucket(store, spark, tmp_path):
    before = files(tmp_path)
    touched = store.rewrite("t", spark.createDataFrame([("k7",)], "k string"), lambda old: old.withColumn("v", F.when(F.col("k") == "k7", -1).otherwise(F.col("v"))))
    made = files(tmp_path) - before
    assert touched == [bucket_of("k7", 8)] and {p.split("_bucket=")[1].split("/")[0] for p in made} == {str(touched[0])}
    assert values(store) == {f"k{i}": i for i in range(200)} | {"k7": -1}
    read = store.lookup("t", "k7")
    assert [r.v for r in read.collect()] == [-1] and all(f"_bucket={touched[0]}/" in f for f in read.inputFiles())


def test_upsert_append_delete(store, spark):
    store.upsert("t", spark.createDataFrame([("k1", 11, "n"), ("new", 5, "n")], "k string, v long, more string"), "k")
    assert store.read("t").where("more = 'n'").count() == 2 and values(store)["k1"] == 11 and len(values(store)) == 201
    store.append_new("t", spark.createDataFrame([("k1", 0), ("k300", 1), ("k300", 1)], "k string, v long"), "k")
    assert values(store)["k1"] == 11 and values(store)["k300"] == 1 and len(values(store)) == 202
    store.delete("t")
    store.delete("t", spark.createDataFrame([("new",), ("absent",)], "k string"))
    store.delete("t", where=F.col("v") > 100)
    store.delete("t", spark.createDataFrame([("k2",)], "k string"), F.col("v") == 3)
    assert set(values(store)) == {f"k{i}" for i in range(101) if i not in (2, 3)} | {"k300"}
    store.append("t", spark.createDataFrame([("tagged", 1, None)], "k string, v long, more string"), "w1", note="x")
    assert store.read("t", tags=["w1"]).first().k == "tagged" and store.version("t").info["w1"] == {"note": "x"}
    store.append("t", spark.createDataFrame([("second", 1, None)], "k string, v long, more string"), "w2", forget=["w1"])
    assert "tagged" not in values(store) and "second" in values(store)


def test_the_later_of_two_writers_fails(store, spark, tmp_path):
    other = Store(spark, str(tmp_path / "s"), keep=2, buckets=8)
    mine, theirs = store.read("t"), other.read("t")
    other.replace("t", theirs.withColumn("v", F.col("v") + 1))
    left = files(tmp_path)
    with pytest.raises(Conflict):
        store.replace("t", mine.withColumn("v", F.col("v") + 100))
    assert values(store)["k1"] == 2 and files(tmp_path) == left
    store.replace("t", store.read("t").withColumn("v", F.col("v") + 100))
    assert values(store)["k1"] == 102


@pytest.mark.parametrize("scheme", ["", "file://", "viewfs://"])
def test_of_many_publishers_one_wins(spark, tmp_path, scheme):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.races.link./in", f"file://{tmp_path}")
    root = {"": str(tmp_path), "file://": f"file://{tmp_path}", "viewfs://": "viewfs://races/in"}[scheme]
    store, won = Store(spark, root), []
    run = lambda i: won.append(i) if store._publish(f"{root}/log/1.json", str(i)) else None
    threads = [threading.Thread(target=run, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and store._text(f"{root}/log/1.json") == str(won[0])
    assert [n for n in store._names(f"{root}/log") if "draft" in n and not n.endswith(".crc")] == []


def test_old_versions_go_and_a_plan_that_began_before_can_end(store, spark, tmp_path):
    began = store.read("t")
    store.upsert("t", spark.createDataFrame([("k1", -1)], "k string, v long"), "k")
    assert began.count() == 200 and {r.v for r in began.where("k = 'k1'").collect()} == {1}
    for i in range(5):
        store.upsert("t", spark.createDataFrame([("k1", i)], "k string, v long"), "k")
    now = store.version("t")
    assert len([n for n in store._names(f"{store.root}/t/log") if n.endswith(".json")]) == 2
    assert len({p.rpartition("/")[0] for p in files(tmp_path)}) == len(now.folders()) + 1


def test_held_tables_are_of_one_call(store, spark):
    a, b = store.held(spark.range(3), "a"), store.held(spark.range(4), "b")
    store.release("a")
    assert b.count() == 4
    with pytest.raises(KeyError):
        store.read("absent")
    assert "FILE" in str(pytest.raises(Exception, a.count).value).upper()
