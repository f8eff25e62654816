"""Licence scans: sparse logistic regression, a calibrated unknown class, and templates.

A paragraph is what stands between blank lines; wrapped lines within it are joined. It is
classified in windows of ``WINDOW`` words, one at every ``STRIDE`` words, so that neither a
long paragraph hides a short notice nor a wrap cuts one. A window's features are how often
it has each single word and word pair, lower-cased, of the notices' vocabulary; function
words alone are no feature. A paragraph without a word that some feature holds has no
features and is unknown: it is not taken apart.

Multinomial logistic regression with an L1 penalty is trained on windows of the families'
notices, half of them within other prose, against the unknown class: notices of licences
outside the families, other sentences, and at most ``SAMPLE_WINDOWS`` windows from at most
``SAMPLE`` documents of the corpus, the first by hash, less those that name licences or
copyright. A temperature calibrates the probabilities; it is fit on windows of notices, and
on other windows, that models of ``FOLDS`` folds have not seen, a notice being in one fold
with all its windows. A family counts from ``CERTAIN`` on, else the window is unknown. Adjacent
windows that are not unknown are one finding, of the family of the most probable among them
(confirmed ones first). It is confirmed if the word pairs, in their order, that a window
shares with a notice of the family are at least ``ALIKE`` of the smaller of the two.

Scanning uses DataFrame functions alone; only training, on these few rows, is numpy.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .license_texts import FOREIGN, OTHERS, TEMPLATES
from .scratch import saved

WINDOW, STRIDE = 40, 20
SAMPLE, SAMPLE_WINDOWS, CERTAIN, ALIKE = 400, 1500, 0.6, 0.6
STEPS, RATE, SPARSE, ROUNDS, FOLDS = 400, 0.2, 1e-4, 6, 3
UNKNOWN = "unknown"
_WORD = re.compile(r"[a-z0-9]+")
_TOKENS, _BLANK = r"[^a-z0-9]+", r"\n\s*\n"
#: Function words; single digits, which versions end in, go with them.
PLAIN = frozenset("0 1 2 3 4 5 6 7 8 9 a all an and any are as at be but by can either for from has if in into is it its no nor not of on one only or other shall so such than that the their they this to v was were which who will with you your".split())


@dataclass
class Model:
    """Family names (the last: unknown), the weights of each gram, biases, a temperature.

    error is the calibration error on unseen notices: the mean difference, over ten ranges
    of the highest probability, between that and the share of right answers.
    """

    names: list[str]
    grams: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    error: float


def words_of(text: str) -> list[str]:
    """The words of a text, lower-cased."""
    return _WORD.findall(text.lower())


def pairs_of(words: list[str]) -> list[str]:
    """The word pairs, in order."""
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def grams_of(words: list[str]) -> list[str]:
    """The single words and word pairs that can be features."""
    return [w for w in words if w not in PLAIN] + [p for p in pairs_of(words) if not PLAIN.issuperset(p.split())]


def _windows(rng: np.random.Generator, words: list[str], prose: list[list[str]]) -> list[list[str]]:
    """A notice's own windows and ROUNDS random ones, each also within other prose."""
    out = [words[low : low + WINDOW] for low in range(0, max(1, len(words) - STRIDE), STRIDE)]
    for _ in range(ROUNDS if len(words) > 6 else 0):
        size = int(rng.integers(6, min(WINDOW, len(words)) + 1))
        at = int(rng.integers(0, len(words) - size + 1))
        out.append(words[at : at + size])
    return out + [_within(rng, w, prose) for w in out]


def _within(rng: np.random.Generator, words: list[str], prose: list[list[str]]) -> list[str]:
    """``words`` with other prose on both sides, a window in all."""
    left = WINDOW - len(words)
    if left <= 0 or not prose:
        return words
    before = int(rng.integers(0, left + 1))
    a, b = (prose[int(rng.integers(len(prose)))] for _ in range(2))
    return a[len(a) - min(before, len(a)) :] + words + b[: left - before]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _descend(x: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by proximal gradient with momentum; classes weigh alike, the last twice."""
    want = np.eye(classes, dtype=np.float32)[y]
    share = np.bincount(y, minlength=classes).astype(np.float32)
    weight = (1 / np.maximum(share, 1))[y]
    weight[y == classes - 1] *= 2
    weight /= weight.sum()
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    w_fast, b_fast, pace = w, b, 1.0
    for _ in range(STEPS):
        error = weight[:, None] * (_softmax(x @ w_fast + b_fast) - want)
        after = w_fast - RATE * (x.T @ error)
        after = np.sign(after) * np.maximum(np.abs(after) - RATE * SPARSE, 0)
        after_b = b_fast - RATE * error.sum(0)
        step = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        w_fast, b_fast = after + (pace - 1) / step * (after - w), after_b + (pace - 1) / step * (after_b - b)
        w, b, pace = after, after_b, step
    return w, b


def calibration_error(chance: np.ndarray, right: np.ndarray) -> float:
    """The mean difference between the probabilities given and the shares that were right, in ten ranges."""
    part = np.minimum((chance * 10).astype(int), 9)
    return float(sum(abs(chance[part == k].sum() - right[part == k].sum()) for k in range(10)) / max(1, len(chance)))


def fit(samples: list[list[str]]) -> Model:
    """Train on the notices against FOREIGN, OTHERS and ``samples``, windows of words of a corpus."""
    rng = np.random.default_rng(3)
    names = [*sorted(TEMPLATES), UNKNOWN]
    prose = [s for s in samples if len(s) > 8] + [words_of(t) for t in OTHERS]
    rows: list[tuple[list[str], int, int]] = []  # words, class, fold
    for k, name in enumerate(names[:-1]):
        rows += [(w, k, i % FOLDS) for i, t in enumerate(TEMPLATES[name]) for w in _windows(rng, words_of(t), prose)]
    vocabulary = sorted({g for words, _, _ in rows for g in grams_of(words)} & {g for ts in TEMPLATES.values() for t in ts for g in grams_of(words_of(t))})
    rows += [(w, len(names) - 1, i % FOLDS) for i, t in enumerate([*OTHERS, *FOREIGN]) for w in _windows(rng, words_of(t), prose)]
    rows += [(s, len(names) - 1, i % FOLDS) for i, s in enumerate(samples)]
    index = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, (words, _, _) in enumerate(rows):
        np.add.at(x[i], [index[g] for g in grams_of(words) if g in index], 1)
    y, fold = np.array([k for _, k, _ in rows]), np.array([f for _, _, f in rows])
    logits = np.zeros((len(rows), len(names)), np.float32)
    for f in range(FOLDS):
        w, b = _descend(x[fold != f], y[fold != f], len(names))
        logits[fold == f] = x[fold == f] @ w + b
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
    temperature = min(np.geomspace(0.05, 20, 80), key=loss)
    chance = _softmax(logits / temperature)
    w, b = _descend(x, y, len(names))
    used = np.abs(w).sum(1) > 0
    return Model(names, [g for g, u in zip(vocabulary, used, strict=True) if u], w[used].astype(np.float64), b.astype(np.float64), float(temperature), calibration_error(chance.max(1), chance.argmax(1) == y))


def key_words(grams: list[str]) -> list[str]:
    """Words of which every gram has at least one: the single ones, and the longest of each other pair."""
    out = {g for g in grams if " " not in g}
    for g in grams:
        if not out.intersection(g.split()):
            out.add(max((w for w in g.split() if w not in PLAIN), key=len))
    return sorted(out)


def _words(text) -> Column:
    return F.array_remove(F.split(F.lower(text), _TOKENS), "")


def train(docs: DataFrame, text_column: str = "text") -> Model:
    """``fit`` with windows from the first SAMPLE documents of ``docs`` by hash of their text."""
    few = docs.select(F.col(f"`{text_column}`").cast("string").alias("t")).where("t IS NOT NULL").orderBy(F.xxhash64("t"), "t").limit(SAMPLE)
    lists = few.select(_words("t").alias("words")).select("words", F.explode(F.expr(f"sequence(1, greatest(1, size(words)), {WINDOW})")).alias("at"))
    windows = lists.select(F.slice("words", F.col("at"), WINDOW).alias("words")).where("size(words) > 0")
    plain = windows.where(~F.array_join("words", " ").rlike("licen[cs]|copyright|gnu|creative commons"))
    return fit(sorted(r.words for r in plain.orderBy(F.xxhash64("words"), "words").limit(SAMPLE_WINDOWS).collect()))


def scan(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """What is not unknown: doc_id, text_hash, paragraph, first_word, n_words, family, probability, similarity, confirmed.

    paragraph counts from 0, first_word from 0 within it. Null, empty and wordless texts
    have none. Rows that repeat a doc_id are told apart by text_hash; rows equal in both
    are scanned each, and found once.
    """
    spark = docs.sparkSession
    k = len(model.names)
    notices = [(name, pairs_of(words_of(t))) for name, ts in TEMPLATES.items() for t in ts]
    weight = dict(zip(model.grams, model.weights.tolist(), strict=True))
    grams = sorted(weight.keys() | {p for _, ps in notices for p in ps})
    table = spark.createDataFrame([(g, i, weight.get(g, [0.0] * k)) for i, g in enumerate(grams)], "gram string, no int, w array<double>")
    number = {g: i for i, g in enumerate(grams)}
    compared = spark.createDataFrame([(name, i, len(set(ps)), number[p]) for i, (name, ps) in enumerate(notices) for p in sorted(set(ps))], "family string, notice int, n_pairs int, no int")

    text = F.col(f"`{text_column}`").cast("string")
    needed = F.array(*[F.lit(w) for w in key_words(model.grams)]).cast("array<string>")
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), text.alias("t"))
    paragraphs = texts.select("doc_id", F.xxhash64("t").alias("text_hash"), F.posexplode(F.split("t", _BLANK)).alias("paragraph", "part"))
    known = paragraphs.withColumn("words", _words("part")).where(F.arrays_overlap("words", needed))
    # the last word pairs with null and stays alone; an index in the lambda would split the text for each word
    pairs = F.zip_with("words", F.slice("words", 2, F.size("words")), lambda a, b: F.concat_ws(" ", a, b))
    keys = ["doc_id", "text_hash", "paragraph", "total"]
    placed = known.select("doc_id", "text_hash", "paragraph", F.size("words").alias("total"), F.posexplode(pairs).alias("place", "pair"))
    each = placed.select(*keys, "place", F.explode(F.array_distinct(F.array(F.substring_index("pair", " ", 1), "pair"))).alias("gram"))
    hits = each.join(F.broadcast(table), "gram").select(*keys, "no", "w", F.explode(F.expr(f"sequence(greatest(0, place div {STRIDE} - {WINDOW // STRIDE - 1}), place div {STRIDE})")).alias("window"))
    sums = hits.groupBy(*keys, "window").agg(*[F.sum(F.col("w")[j]).alias(f"s{j}") for j in range(k)], F.collect_set("no").alias("found"))
    logits = F.array(*[(F.col(f"s{j}") + float(model.bias[j])) / model.temperature for j in range(k)])
    scored = sums.select(*keys, "window", "found", logits.alias("z")).withColumn("top", F.array_max("z"))
    total: Column = F.aggregate(F.transform("z", lambda z: F.exp(z - F.col("top"))), F.lit(0.0), lambda a, e: a + e)
    best = scored.withColumn("probability", F.round(1 / total, 6)).withColumn("family", F.element_at(F.array(*[F.lit(n) for n in model.names]), F.array_position("z", F.col("top")).cast("int")))
    families = best.where((F.col("family") != UNKNOWN) & (F.col("probability") >= CERTAIN)).drop("z", "top")

    own_pairs = F.least(F.lit(WINDOW), F.col("total") - F.col("window") * STRIDE) - 1
    row = [*keys, "window", "family"]
    shared = families.select(*row, own_pairs.alias("own_pairs"), F.explode("found").alias("no")).join(F.broadcast(compared), ["family", "no"])
    alike = shared.groupBy(*row, "notice").agg((F.count("*") / F.greatest(F.lit(1), F.least(F.first("n_pairs"), F.first("own_pairs")))).alias("alike"))
    similar = alike.groupBy(*row).agg(F.least(F.lit(1.0), F.max("alike")).alias("similarity"))
    judged = families.select(*row, "probability").join(similar, row, "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    order = Window.partitionBy("doc_id", "text_hash", "paragraph").orderBy("window")
    runs = judged.withColumn("new", F.coalesce(F.col("window") - F.lag("window").over(order) > 1, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = F.struct((F.col("similarity") < ALIKE).cast("int"), -F.col("probability"), -F.col("similarity"), "window")
    found = runs.groupBy("doc_id", "text_hash", "paragraph", "run").agg(
        F.min_by(F.struct("family", "probability", F.round("similarity", 6).alias("similarity"), (F.col("similarity") >= ALIKE).alias("confirmed")), first).alias("best"),
        (F.min("window") * STRIDE).cast("int").alias("first_word"), F.least(F.max("window") * STRIDE + WINDOW, F.first("total")).cast("int").alias("end"),
    )
    return found.select("doc_id", "text_hash", "paragraph", "first_word", (F.col("end") - F.col("first_word")).alias("n_words"), "best.*")


def licenses(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_paragraphs, n_found, license, probability, families.

    n_paragraphs counts paragraphs that are not blank, n_found confirmed findings. license is
    the family of the most probable of these (ties: the earliest), families all of them,
    sorted and joined by commas; both are null where there is none.
    """
    model = model or train(docs)
    found = saved(scan(docs, model).where("confirmed"))
    by_text = found.groupBy("doc_id", "text_hash").agg(
        F.count("*").alias("n_found"), F.min_by(F.struct("family", "probability"), F.struct(-F.col("probability"), F.col("paragraph"), F.col("first_word"))).alias("best"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families")
    )
    text = F.col("text").cast("string")
    parts = F.size(F.filter(F.split(text, _BLANK), lambda x: x.rlike(r"\S")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.when(text.isNull(), 0).otherwise(parts).cast("long").alias("n_paragraphs"))
    joined = rows.alias("r").join(by_text.alias("f"), F.expr("r.doc_id <=> f.doc_id AND r.text_hash = f.text_hash"), "left")
    return joined.select("r.doc_id", "n_paragraphs", F.coalesce("n_found", F.lit(0)).alias("n_found"), F.col("best.family").alias("license"), F.col("best.probability").alias("probability"), "families")


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """The licences that paragraphs of the whole ``documents`` table name."""
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
