"""The stored inverted index against the index made for one search."""

import random

import pytest
from pyspark.sql import functions as F

from loregrid.operators import retrieval
from loregrid.sources import keyword_index
from loregrid.sources.keyword_index import KeywordIndex
from loregrid.sources.store import Store

SCHEMA = "collection string, chunk_id string, content string"


def made(n, seed=0):
    rng = random.Random(seed)
    words = ["common", "often", "Épée", "rare_pair", *[f"w{i}" for i in range(40)]]
    texts = [None, "", "common common common", *[" ".join(rng.choices(words, weights=[60, 20, 2, 2, *[1] * 40], k=rng.randint(1, 60))) for _ in range(n - 3)]]
    return [(f"c{i % 3}", f"id{seed}-{i:04d}", t) for i, t in enumerate(texts)]


@pytest.fixture()
def index(spark, tmp_path):
    return KeywordIndex(Store(spark, str(tmp_path / "s"), buckets=8), block=8)


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    found = KeywordIndex(Store(spark, str(tmp_path_factory.mktemp("s")), buckets=8), block=8)
    found.put(spark.createDataFrame(made(150), SCHEMA))
    return found


def wanted(spark, rows, phrases, k, collection=None):
    """By scoring all rows without a stored index."""
    chunks = spark.createDataFrame(rows, SCHEMA)
    scores = retrieval.bm25(retrieval.postings(chunks), retrieval.lengths(chunks), phrases)
    known = chunks.join(scores, "chunk_id") if collection is None else chunks.where(F.col("collection") == collection).join(scores, "chunk_id")
    return [(r.chunk_id, r.bm25) for r in known.orderBy("bm25", "chunk_id").limit(k).collect()]


def got(frame):
    return [(r.chunk_id, r.bm25) for r in frame.orderBy("bm25", "chunk_id").collect()]


@pytest.mark.parametrize("few", [0, 1000])
@pytest.mark.parametrize("query", ["w1 w2 common absent", "rare_pair EPEE"])
def test_top_equals_scoring_all(spark, filled, monkeypatch, few, query):
    monkeypatch.setattr(keyword_index, "FEW_BLOCKS", few)
    monkeypatch.setattr(keyword_index, "SEEDS", 3)
    rows, phrases = made(150), retrieval.query_phrases(query)
    assert got(filled.top(phrases, 10)) == wanted(spark, rows, phrases, 10)
    assert got(filled.top(phrases, 5, F.col("collection") == "c1")) == wanted(spark, rows, phrases, 5, "c1")
    assert sorted(got(filled.matches(phrases))) == sorted(wanted(spark, rows, phrases, 1000))


def test_appends_deletes_and_one_write_again(spark, index, monkeypatch):
    monkeypatch.setattr(keyword_index, "FEW_BLOCKS", 0)
    first, second = made(60), made(50, 1)
    table = lambda rows: spark.createDataFrame(rows, SCHEMA)
    index.put(table(first))
    index.put(table(second), gone=table([*first[10:30], ("c0", "absent", "common")]))
    index.put(table([]), gone=table(second[:5]))
    left = first[:10] + first[30:] + second[5:]
    for query in ("common often", "rare_pair", "w5"):
        phrases = retrieval.query_phrases(query)
        assert got(index.top(phrases, 12)) == wanted(spark, left, phrases, 12)
    assert {r.collection: r.n for r in index.counts().collect()} == {c: sum(x[0] == c for x in left) for c in ("c0", "c1", "c2")}
    index.replace_all(table(left))
    assert len(index._writes()) == 1 and index._read("dead", index._writes()).isEmpty() and len(index.store.version("keywords_docs").folders()) <= 8
    assert got(index.top([["common"]], 12)) == wanted(spark, left, [["common"]], 12)


def test_a_query_reads_the_folders_of_its_terms(filled):
    every = set(filled.store.read("keywords_postings").inputFiles())
    own = set(filled._posted([["w3"]], filled._writes()).inputFiles())
    bucket = keyword_index.bucket_of("w3", 8)
    assert own < every and all(f"_bucket={bucket}/" in f for f in own)


def test_blocks_that_cannot_win_are_not_read(spark, index, monkeypatch):
    monkeypatch.setattr(keyword_index, "SEEDS", 2)
    rows = [("c", f"id{i:04d}", "needle " * (0 if i % 3 else 30 if i in (3, 90, 171) else 1) + "hay " * (5 if i in (3, 90, 171) else 40)) for i in range(200)]
    index.put(spark.createDataFrame(rows, SCHEMA))
    writes, phrases = index._writes(), [["needle"]]
    posted = index._posted(phrases, writes)
    counts, blocks = index._term_counts(posted, phrases, writes)
    assert counts == {0: 67} and blocks in (25, 26)
    assert index._promising(posted, phrases, counts, writes, 2, None).select("block").distinct().count() == 3
    assert [c for c, _ in got(index.top(phrases, 3))] == [c for c, _ in wanted(spark, rows, phrases, 3)]


def test_a_write_that_broke_off_is_not_seen(spark, index):
    index.put(spark.createDataFrame(made(20), SCHEMA))
    index.store.append("keywords_docs", spark.createDataFrame([("broken", 0, 0, "c0", "ghost", 3)], "op string, block long, slot int, collection string, chunk_id string, len int"), "broken")
    assert index.docs().count() == 20 and index.docs().where("chunk_id = 'ghost'").isEmpty()


def test_bootstrap_fills_only_what_is_empty(spark, index):
    rows = made(30)
    index.put(spark.createDataFrame([r for r in rows if r[0] == "c0"], SCHEMA))
    assert index.bootstrap(spark.createDataFrame(rows, SCHEMA)) == ["c1", "c2"]
    assert index.bootstrap(spark.createDataFrame(rows, SCHEMA)) == []
    assert index.docs().count() == 30


def test_words_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Posting rows are made and written where the numbered documents are, in pieces of bounded size, with the same results."""
    monkeypatch.setattr(keyword_index, "WORDS", 64)  # here, not on executors
    rows = made(120)
    index = KeywordIndex(Store(spark, str(tmp_path / "s"), buckets=8), block=8)
    cut = index._numbered(spark.createDataFrame(rows, SCHEMA), "op")
    plan = keyword_index._posted(cut)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Generate" not in plan
    index.put(spark.createDataFrame(rows, SCHEMA))
    batches = [b for b in cut.select("block", "slot", "len", "words").toArrow().to_batches(max_chunksize=3)]
    cut_rows = [r for b in keyword_index._cut(iter(batches)) for r in b.to_pylist()]
    seen = sorted((r["term"], r["block"], s, at) for r in cut_rows for s, at in unpacked(r["n"], r["packed"]))
    words = [(w, r.block, r.slot, i) for r in cut.collect() for i, w in enumerate(r.words)]
    assert sorted((t, b, s, i) for t, b, s, at in seen for i in at) == sorted(words)
    stored = index._read("postings", index._writes()).collect()
    assert sorted((r.term, r.block, s, tuple(at)) for r in stored for s, at in zip(r.slots, r.positions)) == [(t, b, s, tuple(at)) for t, b, s, at in seen]
    assert all(r.max_tf == max(map(len, r.positions)) and r.tfs == [len(p) for p in r.positions] and r.min_len == min(r.lens) and r.n == len(r.slots) for r in stored)


def unpacked(n, packed):
    slots, _, tfs, ends = (packed[i * n : (i + 1) * n] for i in range(4))
    return [(s, packed[4 * n + e - f : 4 * n + e]) for s, f, e in zip(slots, tfs, ends)]
