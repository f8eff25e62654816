"""Every stage of the pipeline on odd rows, and all of them in a row against each stage's own rules."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from loregrid.llm.scratch import saved

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, row string, score double, `tick``s` int"
NASTY, NICE = "vile scum filth wretch crud muck", "river stone garden cloud meadow birch lantern harbour"


def prose(rng, n, bad=False):
    return " ".join(rng.choice((NASTY if bad else NICE).split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    passage = prose(rng, 60)
    base = [prose(rng, n) for n in (30, 80, 150, 300)]
    texts = [None, "", " \n ", "one", *base, base[2] + " tail", base[3], *[prose(rng, 90) + " " + passage + " " + prose(rng, 30) for _ in range(4)]]
    texts += [prose(rng, rng.randint(20, 60), bad=True) for _ in range(40)] + [prose(rng, rng.randint(20, 60)) for _ in range(60)]
    texts.append(" ".join(f"long{i % 5003}x{i // 5003}" for i in range(400_000)))
    out = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "") if i % 2 else None) for i, t in enumerate(texts)]
    return [*out, (3, "one", "en", "s0", 3), (None, base[1], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "dot", "row", 0.5, 7) for r in rows], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def folder(spark, rows, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    bad = [(i, 0, int(t is not None and t.split(" ")[0].rstrip("0123456789") in NASTY.split())) for i, t, *_ in rows if i is not None and t and t.strip() and i % 4 < 3]
    spark.createDataFrame(sorted(set(bad)), "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    docs.write.parquet(f"{at}/documents.parquet")
    return at


def toxic(text):
    return bool(text and text.strip()) and text.split()[0].rstrip("0123456789") in NASTY.split()


def as_rows(frame):
    return sorted(map(tuple, frame.select("doc_id", "text", "source").collect()), key=repr)


def test_toxic_documents_go_and_clean_ones_stay(spark, docs, rows, folder):
    out = pipeline.drop_toxic(spark, docs, folder)
    assert out.columns == docs.columns
    assert as_rows(out) == sorted(((i, t, s) for i, t, _, s, _ in rows if not toxic(t)), key=repr)


def test_one_of_each_group_of_near_duplicates_stays(spark, docs, rows):
    out = pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    gone = {r.doc_id for r in docs.select("doc_id").subtract(out.select("doc_id")).collect()}
    texts = {i: t for i, t, *_ in rows}
    assert gone == {8, 9} and texts[9] == texts[7] and texts[8].startswith(texts[6])
    assert out.where("doc_id IS NULL").count() == 1 and out.where("doc_id = 3").count() == 2


def test_repeated_passages_are_cut_once(spark, docs, rows):
    out = pipeline.cut_repeats(spark, docs, "")
    assert out.columns == docs.columns and out.count() == len(rows)
    found = {r.doc_id: r for r in out.where("doc_id IS NOT NULL").collect()}
    texts = {i: t for i, t, *_ in rows}
    passage = texts[10].split()[90:150]
    assert found[10].text == texts[10] and all(found[i].text.split() == [w for k, w in enumerate(texts[i].split()) if not 90 <= k < 150] for i in (11, 12, 13)) and len(passage) == 60
    assert found[11].n_chars == len(found[11].text) and found[0].text is None and found[114].text == texts[114]


def test_the_mix_takes_documents_whole_or_in_part(spark, docs, rows):
    out = pipeline.mix(spark, docs, "")
    assert out.columns == docs.columns
    sizes = {i: len((t or "").split()) for i, t, *_ in rows if i != 3}
    taken = {r.doc_id: r.n for r in out.where("doc_id <> 3").groupBy("doc_id").agg(F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).alias("n")).collect()}
    assert all(n <= 3 * sizes[i] for i, n in taken.items())


def test_encoding_is_read_back(spark, docs, rows):
    out = pipeline.encode(spark, docs, "").collect()
    assert len(out) == len(rows) and all(r.lossless for r in out)


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES])
def test_empty_tables(spark, docs, folder, stage):
    assert stage(spark, docs.limit(0), folder).isEmpty()


def test_stages_in_a_row_equal_the_run(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES:
        rows = saved(stage(spark, rows, folder))
    key = lambda frame: sorted((r.doc_id if r.doc_id is not None else -1, r.n_ids, r.decoded_sha256) for r in frame.select("doc_id", "n_ids", "decoded_sha256").collect())
    assert key(rows) == key(pipeline.run(spark, folder))
