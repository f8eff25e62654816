"""The operators on documents against brute force, and on odd rows."""

import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loregrid.llm import chat, graph, licenses, mixing, near_dedup, pieces, sharding, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, tokens string, score double, rep long, c int, at string, start int, cell int, family string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "Delta", "épée", "zeta", "eta", "theta"]) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (3, 4, 5, 19, 20, 21, 60, 200, 400)]
    texts = [None, "", " \t\n ", "a", "▁ b", base[0], base[0], *base, base[6] + " tail words", "lead " + base[7], base[8].replace("alpha", "ALPHA")]
    for k in range(40):  # a large group of near copies
        w = base[7].split()
        w[k * 4 + 3] = f"edit{k}"
        texts.append(" ".join(w))
    texts += [prose(rng, 70) + " " + base[6] + "\n" + prose(rng, 10) for _ in range(12)]
    texts.append("x" * 3000)
    texts.append(prose(rng, 4000))
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    out += [(None, base[8], "en", "s0"), (3, "a", "en", "s0"), (8, base[8], "en", "s1"), (None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(*r, 1, "row", 2, "t", 0.5, 3, 4, "at", 5, 6, "f") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("block", [near_dedup.TEXTS, 8])
def test_near_duplicates(docs, rows, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "TEXTS", block)
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    known = [(i, s) for i, s in sets if i is not None]
    linked = [(a, b) for a, x in known for b, y in known if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    root = roots({i for i, _ in known}, linked)
    found = near_dedup.near_duplicates(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles) for r in found) == sorted((-1 if i is None else i, len(s)) for i, s in sets)
    for r in found:
        assert r.kept and r.component_id is None if r.doc_id is None else (r.component_id, r.kept) == (root[r.doc_id], root[r.doc_id] == r.doc_id)


def test_near_duplicates_compares_what_stars_miss(spark):
    """A chain: neighbours are near duplicates, the ends and the hub are not."""
    w = [f"w{i}" for i in range(100)]
    texts = [" ".join(w[:k] + [f"n{i}" for i in range(k)] + w[k:] if False else [f"c{i}" for i in range(3 * k)] + w[3 * k :]) for k in range(20)]
    sets = [shingles(t) for t in texts]
    linked = [(a, b) for a in range(20) for b in range(a + 1, 20) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(range(20), linked)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table).collect()} == root


def test_near_duplicates_of_repeated_ids(spark):
    """A doc_id with two texts of as many shingles has the links of both."""
    a, b = ([f"{x}{i}" for i in range(30)] for x in "ab")
    texts = [(5, " ".join(a)), (5, " ".join(b)), (6, " ".join([*a, "tail"])), (7, " ".join([*b, "tail"])), (7, " ".join([*b, "tail"])), (8, "other words are here now")]
    found = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(5, 5), (5, 5), (6, 5), (7, 5), (7, 5), (8, 8)]


def test_near_duplicates_at_the_threshold(spark):
    """Pairs of a similarity from 0.75 to 0.76, none of which may be missed more than a few times in 100,000."""
    rows = []
    for i in range(300):
        w = [f"w{i}x{j}" for j in range(200)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[: 200 - i % 2] + [f"t{i}y{j}" for j in range(64 - i % 2)]))]
    sets = [shingles(t) for _, t in rows]
    near = [100 * len(x & y) >= 75 * len(x | y) for x, y in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(near) >= 150
    out = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [i for i, n in enumerate(near) if n and out[2 * i + 1] != 2 * i]
    assert not missed and all(out[2 * i + 1] == 2 * i + 1 for i, n in enumerate(near) if not n)


@pytest.mark.parametrize("few", [graph.FEW, 4])
def test_components_of_hubs_and_chains(spark, few, monkeypatch):
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(6)
    links = [(0, i) for i in range(1, 300)] + [(5000, i) for i in range(1000, 1300)] + [(2000 + i, 2001 + i) for i in range(60)] + [(rng.randrange(3000, 3500), rng.randrange(3000, 3500)) for _ in range(300)] + [(9, 9)]
    want = roots({x for e in links for x in e}, links)
    want.pop(9) if all(9 not in e or e == (9, 9) for e in links) else None
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: c for n, c in want.items() if n in found} and set(found) == {x for a, b in links if a != b for x in (a, b)}


def test_remove_repeats(docs, rows):
    order = {}
    keyed = [(2**63 - 1 if i is None else i, words(t)) for i, t, *_ in rows]
    for i, w in keyed:
        for k in range(len(w) - 19):
            order[tuple(w[k : k + 20])] = min(order.get(tuple(w[k : k + 20]), (2**63, 0)), (i, k))
    want = []
    for i, w in keyed:
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if order[tuple(w[k : k + 20])] < (i, k):
                gone[k : k + 20] = [True] * 20
        want.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    out = substring_dedup.remove_repeats(docs).collect()
    assert sorted((2**63 - 1 if r.row.doc_id is None else r.row.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out) == sorted(want)
    assert all(r.row.row == "row" and r.row.start == 5 for r in out)
    whole = substring_dedup.remove_repeats(docs, keep_whole=True).where("n_removed = 0").select("kept_text").collect()
    assert {r.kept_text for r in whole} <= {t for _, t, *_ in rows}


def test_remove_repeats_of_a_bucket_not_kept_whole(docs, monkeypatch):
    want = sorted(map(tuple, substring_dedup.remove_repeats(docs).select("n_words", "n_removed", "kept_text").collect()))
    monkeypatch.setattr(substring_dedup, "SORTED", 300)
    monkeypatch.setattr(substring_dedup, "KEPT", 500)
    codec, payloads = pa.Codec("zstd"), []
    batch = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("t"), "text").toArrow().combine_chunks().to_batches()[0]
    for low in range(0, batch.num_rows, 5):
        for out in substring_dedup._split(1)(iter([batch.slice(low, 5)])):
            payloads += [p for p, packed in zip(out.column(2).to_pylist(), out.column(1).to_pylist(), strict=True) if packed]
    found = [r for b in substring_dedup._bucket(iter(payloads), codec) for r in b.to_pylist()]
    handed = [r for r in found if r["size"] == 0]
    first = {}
    for r in handed:
        k = (r["k1"], r["k2"])
        first[k] = min(first.get(k, (2**63, 0)), (r["order_id"], r["start"]))
    late = [(r["order_id"], r["tag"], r["start"]) for r in handed if first[r["k1"], r["k2"]] != (r["order_id"], r["start"])]
    late += [(r["order_id"], r["tag"], r["start"] + j) for r in found for j in range(r["size"])]
    monkeypatch.setattr(substring_dedup, "SORTED", 1 << 40)
    once = [(r["order_id"], r["tag"], r["start"] + j) for b in substring_dedup._bucket(iter(payloads), codec) for r in b.to_pylist() for j in range(r["size"])]
    assert handed and sorted(set(late)) == sorted(set(once)) and once
    assert want == sorted(map(tuple, substring_dedup.remove_repeats(docs).select("n_words", "n_removed", "kept_text").collect()))


def test_shards(docs, rows):
    out = sharding.assign_shards(docs, 4).collect()
    assert len(out) == len(rows)
    assert sorted(r["size"] for r in out) == sorted(len((t or "").encode()) + 1 for _, t, *_ in rows)
    assert {(r["size"], r.text_crc32) for r in out} == {(len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for _, t, *_ in rows}
    groups, slots = {}, {}
    for r in out:
        groups.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(len(s) == 1 for s in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("fan", [sharding.FAN, 4])
def test_shards_have_near_equal_bytes(spark, fan, monkeypatch):
    monkeypatch.setattr(sharding, "FAN", fan)
    monkeypatch.setattr(sharding, "CELLS", 20)
    rng = random.Random(3)
    texts = ["z" * 9000] * 3 + ["y" * 40_000] + ["x" * int(rng.paretovariate(1.2) * 50) + str(i) for i in range(3000)] + ["w" * 300] * 200
    out = sharding.assign_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 8).collect()
    total, groups = [0] * 8, {}
    for r in out:
        total[r.shard] += r["size"]
        groups[texts[r.doc_id]] = groups.get(texts[r.doc_id], 0) + r["size"]
    assert len(out) == len(texts)
    large = max(groups, key=groups.get)
    alone = next(r.shard for r in out if texts[r.doc_id] == large)
    rest = [t for k, t in enumerate(total) if k != alone]
    assert total[alone] == groups[large] > sum(total) / 8  # larger than an even share, so nothing joins it
    assert max(rest) - min(rest) <= 0.03 * sum(rest) / 7


def test_differencing_beats_greedy_order():
    rng = np.random.default_rng(0)
    parts = np.sort(rng.integers(1, 1000, (50, 4)), 1)[:, ::-1]
    sums, where = sharding.difference(parts)
    total = np.zeros(4, np.int64)
    for p, w in zip(parts, where, strict=True):
        assert sorted(w) == [0, 1, 2, 3]
        np.add.at(total, w, p)
    assert sorted(total) == sorted(sums) and sums.max() - sums.min() <= 50
    one, place = sharding.difference(np.array([[3, 9, 1]]))
    assert one[place[0]].tolist() == [3, 9, 1]


def brute_sainte_lague(wanted, seats):
    out = [0] * len(wanted)
    for _ in range(seats):
        k = max(range(len(wanted)), key=lambda i: (wanted[i] / (2 * out[i] + 1), -i))
        out[k] += 1
    return out


def test_apportionment():
    rng = random.Random(1)
    for _ in range(50):
        wanted = [rng.randrange(0, 1000) + 0.25 for _ in range(rng.randrange(1, 9))]
        for seats in (0, 1, 7, 100):
            assert mixing.apportion(wanted, seats) == brute_sainte_lague(wanted, seats)


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    out = mixing.targets([10, 1000, 1000, 0], [5, 2, 1, 5])
    assert out[0] == 30 and out[3] == 0 and abs(sum(out) - 2010) < 1e-9 and abs(out[1] - 2 * out[2]) < 1e-9
    assert mixing.targets([], []) == []


def test_mix(docs, rows):
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        assert r.taken == sum(t.n for t in r.takes) <= 3 * r["size"]
        by.setdefault(r.source, []).append(r)
    for s, rs in by.items():
        assert rs[0].source_size == sum(r["size"] for r in rs) == sum(len(words(t)) for _, t, _, x in rows if x == s)
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 2 * mixing.BLOCK
    again = mixing.mix_sources(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["size"], r.taken, str(r.takes))
    assert sorted(map(key, out)) == sorted(map(key, again))
    made = mixing.mixed(docs)
    assert made.columns == docs.columns
    assert sum(len(words(r.text)) for r in made.collect()) == sum(r.taken for r in out)


def test_toxicity(spark, docs):
    rng = random.Random(2)
    texts = [(i, prose(rng, 60) + (" vile rotten fool " * 3 if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    table = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts] + [(5, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.train(table, labels, ~toxicity.held_out())
    out = toxicity.score(table, model).select("row.doc_id", "score", toxicity.held_out("row.doc_id").alias("held")).collect()
    assert all((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in out if r.held)
    assert {r.held for r in out} == {True, False} and all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    odd = toxicity.score(docs, model, keep_text=True)
    assert odd.count() == docs.count() and odd.select("row.*").columns == docs.columns
    few = {r.row.text: r.score for r in odd.collect()}
    assert few[None] == few[""] == few["a"] < 0.7
    none = toxicity.train(table, labels.where("toxic = 0"), F.lit(True))
    assert toxicity.score(table, none).agg(F.max("score")).first()[0] < 0.01


def test_toxicity_against_a_plain_fit(spark):
    """The same n-grams, ratios, scores and minimum as counted and computed text by text."""
    rng = random.Random(4)
    texts = [prose(rng, 12) + (" Vile fool" if i % 3 == 0 else "") for i in range(60)] + ["", "ab", "éÉ漢字𝄞x"]
    toxic = [int(i % 3 == 0) for i in range(len(texts))]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.train(table, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"), F.lit(True))

    def features(text):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        found = {}
        for n in toxicity.GRAMS:
            for i in range(len(text) - n + 1):
                points = np.array([ord(c) for c in text[i : i + n]], np.uint32)
                bucket = int(dict(toxicity._grams(points))[n][0])
                found[bucket] = found.get(bucket, 0) + 1
        return {b: c / max(1, len(text)) ** 0.5 for b, c in found.items()}

    x = [features(t) for t in texts]
    counts = [{}, {}]
    for y, f in zip(toxic, x, strict=True):
        for b in f:
            counts[y][b] = counts[y].get(b, 0) + 1
    total = [sum(c.values()) + toxicity.BUCKETS for c in counts]
    ratio = {b: np.log((counts[1].get(b, 0) + 1) / total[1]) - np.log((counts[0].get(b, 0) + 1) / total[0]) for f in x for b in f}
    scaled = [{b: v * ratio[b] for b, v in f.items()} for f in x]
    weights = {b: model.weights[b] / r for b, r in ratio.items() if r}

    def loss(w, bias):
        z = np.array([bias + sum(w.get(b, 0) * v for b, v in f.items()) for f in scaled])
        y = np.array(toxic)
        return np.mean(np.logaddexp(0, z) - y * z) + toxicity.PENALTY / 2 * sum(v * v for v in w.values()), 1 / (1 + np.exp(-z))

    least, chance = loss(weights, model.bias)
    found = {r.doc_id: r.score for r in toxicity.score(table, model).select("row.doc_id", "score").collect()}
    assert all(abs(found[i] - chance[i]) < 1e-5 for i in found)
    step = max(weights.values(), key=abs)
    assert least < 0.05 and all(loss({b: v + d * step * rng.random() for b, v in weights.items()}, model.bias + e)[0] >= least - 1e-6 for d, e in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5)))


def test_bytes_that_are_no_utf8(spark):
    """Such bytes change no other row, and are restored."""
    raw = spark.createDataFrame([(1, bytearray(b"text \xff\xc3 here")), (2, bytearray("next text h\u00e9re".encode())), (3, bytearray(b"\xa9\xe9")), (4, bytearray(b"\xc3")), (5, bytearray(b"\xa9"))], "doc_id long, raw binary")
    table = raw.selectExpr("doc_id", "cast(raw as string) text").coalesce(1)
    out = pieces.encode_texts(table, check=True).select("row.doc_id", "lossless", "decoded_sha256").collect()
    assert all(r.lossless for r in out)
    assert {r.doc_id: r.decoded_sha256 for r in out} == {r.doc_id: hashlib.sha256(bytes(r.raw)).hexdigest() for r in raw.collect()}
    model = toxicity.Model(np.arange(toxicity.BUCKETS, dtype=np.float32) / toxicity.BUCKETS - 0.5, 0.0)
    every = {r.doc_id: r.score for r in toxicity.score(table, model).select("row.doc_id", "score").collect()}
    alone = toxicity.score(table.where("doc_id = 2"), model).first()
    assert every[2] == alone.score and every[3] == every[4] == every[5] == 0.5
    assert near_dedup.near_duplicates(table).count() == 5 and substring_dedup.remove_repeats(table).count() == 5


def test_pieces(docs, rows):
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for r in pieces.encode_texts(docs, dropout=0.0).join(docs.select("doc_id", "text").dropDuplicates(), F.col("row.doc_id") == F.col("doc_id")).collect():
        if r.text and "▁" not in r.text and r.row.doc_id not in (3, 8):
            assert r.ids == plain.encode(r.text)
    out = pieces.encode_texts(docs, check=True)
    assert out.count() == len(rows) and out.where("NOT lossless").count() == 0
    assert sorted(r.decoded_sha256 for r in out.collect()) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in rows)
    back = pieces.decode_texts(pieces.encode_texts(docs)).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, *_ in rows)
    first = sorted(map(str, pieces.encode_texts(docs).select("ids").collect()))
    assert first == sorted(map(str, pieces.encode_texts(docs.repartition(5)).select("ids").collect()))
    assert first != sorted(map(str, pieces.encode_texts(docs, seed=1).select("ids").collect()))


def test_every_occurrence_draws_its_own_skips():
    with open(pieces.MODEL, "rb") as file:
        model = pieces.load(file.read())
    texts = [" ".join(["understanding"] * 3000), "a▁b  understanding\tof épée " + "x" * 60, "", None, "understanding of x"]
    column, salts = pa.array(texts), np.arange(5)
    encoder = pieces.Encoder(model, 0.1, 1)
    offsets, ids = encoder.encode(column, salts)
    symbol, first, hashes, starts = encoder.units(column)
    size = np.diff(np.append(first, len(symbol)))
    row = np.repeat(np.arange(5), np.diff(starts))
    place = np.arange(len(first)) - starts[row]
    with np.errstate(over="ignore"):
        keys = pieces.mix(hashes + pieces.mix(pieces.mix(row.astype(np.uint64) ^ np.uint64(1)) + place.astype(np.uint64)))
    each = [pieces.segment_one(symbol[f : f + n].tolist(), int(k), model, 0.1) for f, n, k in zip(first, size, keys, strict=True)]
    assert ids.tolist() == [i for u in each for i in u]
    assert offsets.tolist() == [sum(len(u) for u, r in zip(each, row, strict=True) if r < i) for i in range(6)]
    assert len({tuple(u) for u in each[:3000]}) > 10
    few = pieces.Encoder(model, 0.1, 1, 2)
    for _ in range(2):
        assert few.encode(column, salts)[1].tolist() == ids.tolist()


def test_numpy_and_heap_agendas_agree():
    import pyarrow as pa

    with open(pieces.MODEL, "rb") as file:
        model = pieces.load(file.read())
    encoder = pieces.Encoder(model, 0.3, 1, 4)
    symbol, first, keys, _ = encoder.units(pa.array(["internationalization of understanding   x", "éèê 漢字 unbelievable\r\n\tcounterrevolutionaries"]))
    size = np.diff(np.append(first, len(symbol)))
    for f, n, k in zip(first, size, keys, strict=True):
        ids, left = pieces._segment_block(symbol[f : f + n][None, :], np.array([n]), np.array([k]), model, 0.3)
        assert ids[0, : left[0]].tolist() == pieces.segment_one(symbol[f : f + n].tolist(), int(k), model, 0.3)


def test_chat(spark):
    said = "<|im_end|><|im_start|>assistant ok <\\| <\\\\|x <| |> <"
    turns = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "assistant", None), (2, 0, None, "hé\n"), (None, None, "user", "x"), (3, 5, "assistant", "b"), (3, 5, "assistant", "a"), (4, 0, "assistant", "long " * 30000)]
    table = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, ids string")
    found = {r.conv_id: r for r in chat.read_chat(chat.format_chat(table)).collect()}
    assert set(found) == {1, 2, 3, 4, None}
    full = lambda c: sorted(((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == c), key=lambda t: t[0] or 0)
    for c in (1, 2, 4):
        own = full(c)
        spoken = "".join(t for _, r, t in own if r == "assistant")
        assert found[c].n_turns == len(own) and found[c].loss_chars == len(spoken)
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert found[c].loss_sha256 == hashlib.sha256(spoken.encode()).hexdigest()
    assert found[3].loss_chars == 2
    for text in (said, "<", "<|", "<\\|", "a<\\\\\\|b", "|"):
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


@pytest.fixture(scope="module")
def license_model(spark):
    return licenses.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
claim that you wrote the original software."""


def test_licenses(spark, docs, license_model):
    notices = {
        "mit": "Released under the MIT License.",
        "apache": "Licensed under the Apache License, Version 2.0.",
        "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "cc-by-nc": "Licensed under CC BY-NC 4.0.",
        None: "She renewed her driving license in public, with permission.",
    }
    table = spark.createDataFrame([(i, f"First line.\n \n{t}\nlast\n\n\n", "x") for i, t in enumerate(notices.values())], "doc_id long, text string, family string")
    out = {r.doc_id: r for r in licenses.licenses(table, license_model).collect()}
    assert [out[i].license for i in range(len(notices))] == list(notices)
    assert all(r.n_paragraphs == 2 for r in out.values())
    odd = licenses.licenses(docs, license_model).collect()
    assert len(odd) == docs.count() and all(r.n_found == 0 and r.license is None for r in odd)
    assert license_model.error < 0.2


def test_wrapped_notices_and_an_unseen_family(spark, license_model):
    """Every notice, alone, wrapped, and amid prose; a licence of no family stays unknown."""
    rng = random.Random(8)
    held = [(name, t) for name, ts in licenses.TEMPLATES.items() for t in ts]
    texts = [t for _, t in held] + [textwrap.fill(t, 40) for _, t in held] + [prose(rng, 35) + "\n" + textwrap.fill(t, 80) + "\n" + prose(rng, 50) for _, t in held]
    out = {r.doc_id: r for r in licenses.licenses(spark.createDataFrame(list(enumerate([*texts, ZLIB])), "doc_id long, text string"), license_model).collect()}
    right = [out[i].license == held[i % len(held)][0] for i in range(len(texts))]
    assert all(right[: 2 * len(held)]) and sum(right) >= 0.95 * len(texts)
    assert all(out[i].families == out[i].license for i in range(len(texts)))
    assert out[len(texts)].license is None and out[len(texts)].n_paragraphs == 3


def brute_scan(text, model):
    """(paragraph, window) -> (family, probability, similarity) of the windows that are not unknown."""
    weights = dict(zip(model.grams, model.weights, strict=True))
    out = {}
    for p, part in enumerate(re.split(r"\n\s*\n", text)):
        words = licenses.words_of(part)
        for w in range(-(-len(words) // licenses.STRIDE)):
            low = w * licenses.STRIDE
            singles, pairs = words[low : low + licenses.WINDOW], licenses.pairs_of(words[low : low + licenses.WINDOW + 1])
            grams = [g for g in singles + pairs if g in weights]
            if not any(g in weights for g in words + licenses.pairs_of(words)) or not singles:
                continue
            z = (model.bias + sum((weights[g] for g in grams), 0 * model.bias)) / model.temperature
            chance = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            name = model.names[chance.argmax()]
            if name != licenses.UNKNOWN and chance.max() >= licenses.CERTAIN:
                own = max(1, min(licenses.WINDOW, len(words) - low) - 1)
                alike = [len(set(pairs) & set(n)) / min(own, len(set(n))) for n in map(licenses.pairs_of, map(licenses.words_of, licenses.TEMPLATES[name]))]
                out[p, w] = (name, float(chance.max()), min(1.0, max(alike)))
    return out


def test_scan_against_brute_force(spark, license_model):
    rng = random.Random(9)
    notices = [t for ts in licenses.TEMPLATES.values() for t in ts]
    texts = ["Text: CC-BY-SA 4.0", "(c) 2020 X, MIT", "", "...", ZLIB, "\n\n".join(license_model.grams), " ".join(rng.sample(license_model.grams, 300))]
    texts += ["\n".join(textwrap.fill(rng.choice(notices), 50) + rng.choice(["\n\n", "\n \n\n", " "]) + prose(rng, rng.randrange(90)) for _ in range(4)) for _ in range(30)]
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), license_model).collect()
    got = {(r.doc_id, r.paragraph, r.first_word // licenses.STRIDE): r for r in found}
    want = {}
    for i, text in enumerate(texts):
        windows = brute_scan(text, license_model)
        for p, w in sorted(windows):
            if (p, w - 1) not in windows:
                run = []
                while (p, w + len(run)) in windows:
                    run.append(windows[p, w + len(run)])
                want[i, p, w] = min(run, key=lambda x: (x[2] < licenses.ALIKE, -round(x[1], 6), -x[2]))
    assert set(got) == set(want) and len(want) > 60
    for k, (name, chance, alike) in want.items():
        assert got[k].family == name and abs(got[k].probability - chance) < 1e-5 and abs(got[k].similarity - alike) < 1e-5


def test_empty_tables(empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert sharding.assign_shards(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert pieces.encode_texts(empty).count() == 0
    assert chat.read_chat(chat.format_chat(empty.selectExpr("doc_id conv_id", "n_chars turn", "lang role", "text"))).count() == 0
    model = licenses.train(empty)
    assert licenses.licenses(empty, model).count() == 0
    labels = empty.selectExpr("doc_id", "cast(n_chars as int) toxic")
    assert toxicity.score(empty, toxicity.train(empty, labels, F.lit(True))).count() == 0
