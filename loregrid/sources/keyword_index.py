"""A stored inverted index: postings in blocks with bounds, kept by appends and tombstones.

Documents get numbers in order of their ids, ``BLOCK`` of them to a block; all blocks are cut
at the same numbers, whatever the term. A posting row holds one term's documents of one
block (of a very long or divided block, of a part of it): their places, lengths, counts and
positions (Parquet keeps these as deltas), with the number of documents, the highest count and
the smallest length, from which a bound of what the block can score follows for any statistics.
The tasks that hold the documents make the rows and write them, so no word is shuffled. Rows are dealt to buckets by their term and
sorted by it, so a query lists and reads the folders of its own terms.

Four tables of a ``Store``: postings, docs (where a document's numbers lead), dead (numbers
that are deleted) and lost (how many documents of a term are). Each write has a tag in all
four. It counts from the moment that the postings are committed, last of all: their commit
file holds the number of documents and words that each write brought and took, so a search
needs no job to learn the statistics, and a write that broke off is never seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..plans.session import ship
from .store import Store, bucket_of

BLOCK, FEW_BLOCKS, SEEDS, MOST_WRITES = 1024, 256, 16, 32
#: Words of which a task makes posting rows at once.
WORDS = 1 << 20


def tf_weight(f: Column, length: Column, mean: float) -> Column:
    """What a count in a document of some length weighs: more with the count, less with the length."""
    k1, b = fixed.BM25_K1, fixed.BM25_B
    return f * (k1 + 1) / (f + k1 * (1 - b + b * length / mean))


def idf(n: Column, total: float) -> Column:
    """The weight of a phrase that n of all documents hold, with a floor."""
    raw = F.log((F.lit(float(total)) - n + 0.5) / (n + 0.5))
    return F.when(raw <= 0, F.lit(fixed.IDF_FLOOR)).otherwise(raw)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The posting rows of numbered documents (block, slot, len, words), of ``WORDS`` words at a time.

    Blocks stay whole, but for those that have more words or are read by several tasks: they
    come in several rows of different slots. ``packed`` has n slots, their lengths, counts and the
    ends of their positions, and then these.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(pc.sum(b.column(2)).as_py() or 0 for b in held) >= WORDS:
            blocks = np.concatenate([b.column(0).to_numpy() for b in held])
            begun = len(blocks) - int(np.argmax(blocks[::-1] != blocks[-1])) if blocks[0] != blocks[-1] else len(blocks)
            table = pa.Table.from_batches(held)
            yield from _grouped(table.slice(0, begun))
            held = table.slice(begun).to_batches()
    if held:
        yield from _grouped(pa.Table.from_batches(held))


def _grouped(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """One sort of all words by block and term, in which documents and positions stay in order."""
    lens = table.column(2).to_numpy()
    if not lens.sum():
        return
    spelled = pa.chunked_array([c.flatten() for c in table.column(3).chunks], pa.string()).combine_chunks().dictionary_encode()
    blocks, of_row = np.unique(table.column(0).to_numpy(), return_inverse=True)
    row = np.repeat(np.arange(len(lens)), lens)
    at = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
    key = of_row[row] * len(spelled.dictionary) + spelled.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key, row, at = key[order], row[order], at[order]
    low = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])))  # a term in a document
    tf, key, row = np.diff(np.append(low, len(at))), key[low], row[low]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))  # a term in a block
    n, begins = np.diff(np.append(first, len(key))), low[first]
    words = np.diff(np.append(begins, len(at)))
    bounds = np.append(0, np.cumsum(4 * n + words))
    packed = np.empty(bounds[-1], np.int32)
    place = np.repeat(bounds[:-1] - first, n) + np.arange(len(key))
    for i, values in enumerate((table.column(1).to_numpy()[row], lens[row], tf, np.cumsum(tf) - np.repeat(begins, n))):
        packed[place + i * np.repeat(n, n)] = values
    packed[np.repeat(bounds[:-1] + 4 * n - begins, words) + np.arange(len(at))] = at
    block, term = np.divmod(key[first], len(spelled.dictionary))
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(packed))
    yield pa.RecordBatch.from_arrays([spelled.dictionary.take(pa.array(term)), pa.array(blocks[block]), pa.array(n, pa.int32()), lists], ["term", "block", "n", "packed"])


def _posted(cut: DataFrame) -> DataFrame:
    """(term, block, n, packed) of numbered documents, made where these are: nothing is shuffled."""
    ship(cut.sparkSession)
    return cut.select("block", "slot", "len", "words").mapInArrow(_cut, "term string, block long, n int, packed array<int>")


def _unpacked(posted: DataFrame, op: str) -> DataFrame:
    """The posting rows; those of the sort before it are small, with all numbers in one array."""
    part = lambda i: F.slice("packed", F.col("n") * i + 1, F.col("n"))
    lists = posted.select("*", F.lit(op).alias("op"), part(0).alias("slots"), part(1).alias("lens"), part(2).alias("tfs"), part(3).alias("ends"))
    own = F.transform("tfs", lambda f, i: F.slice("packed", F.col("n") * 4 + F.get("ends", i) - f + 1, f))
    return lists.select("*", F.array_max("tfs").alias("max_tf"), F.array_min("lens").alias("min_len"), own.alias("positions")).drop("packed", "ends")


class KeywordIndex:
    """The words of (collection, chunk_id, content); ids are of the type ``id_type``."""

    def __init__(self, store: Store, name: str = "keywords", id_type: str = "string", block: int = BLOCK):
        self.store, self.name, self.id_type, self.block = store, name, id_type, block
        schemas = {
            "docs": ("block", f"op string, block long, slot int, collection string, chunk_id {id_type}, len int"),
            "dead": ("op", "op string, block long, slot int"),
            "lost": ("term", "term string, n long"),
            "postings": ("term", "op string, term string, block long, n int, max_tf int, min_len int, slots array<int>, lens array<int>, tfs array<int>, positions array<array<int>>"),
        }
        for part, (key, schema) in schemas.items():
            store.create(self._at(part), schema, key)

    def _at(self, part: str) -> str:
        return f"{self.name}_{part}"

    # statistics
    def _writes(self) -> dict[str, dict]:
        """What each write that counts says: n and words that it brought, less those it took; dead."""
        return self.store.version(self._at("postings")).info

    def _read(self, part: str, writes: dict[str, dict], terms: list[str] | None = None) -> DataFrame:
        name = self._at(part)
        self.store._seen.pop(name, None)
        now = self.store.version(name)
        rows = self.store._rows(name, now, None if terms is None else [bucket_of(t, now.buckets) for t in terms], writes)
        return rows if terms is None else rows.where(F.col("term").isin(*terms))

    def docs(self) -> DataFrame:
        """(op, block, slot, collection, chunk_id, len) of the documents that are not deleted."""
        writes = self._writes()
        rows = self._read("docs", writes)
        return self._alive(rows, writes)

    def _alive(self, rows: DataFrame, writes: dict[str, dict]) -> DataFrame:
        if not any(w["dead"] for w in writes.values()):
            return rows
        return rows.join(self._read("dead", writes), ["op", "block", "slot"], "left_anti")

    def counts(self) -> DataFrame:
        """(collection, n): the documents of each collection."""
        return self.docs().groupBy("collection").agg(F.count("*").alias("n"))

    # writing
    def put(self, rows: DataFrame, gone: DataFrame | None = None, forget: tuple[str, ...] = ()) -> None:
        """Add (collection, chunk_id, content), and delete the rows of ``gone``, which has the same columns.

        Rows of ``gone`` that the index does not have are ignored. Writes named in ``forget`` go.
        """
        store, op = self.store, uuid.uuid4().hex
        says = {"n": 0, "words": 0, "dead": 0}
        if gone is not None and not gone.isEmpty():
            known = self.docs().join(gone.select("collection", F.col("chunk_id").cast(self.id_type).alias("chunk_id"), "content").dropDuplicates(["collection", "chunk_id"]), ["collection", "chunk_id"])
            hit = store.held(known.select("op", "block", "slot", "len", F.array_distinct(text.terms(F.coalesce("content", F.lit("")))).alias("terms")), op)
            n, words = hit.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
            if n:
                says = {"n": -n, "words": -words, "dead": n}
                store.append(self._at("dead"), hit.select("op", "block", "slot"), op)
                store.append(self._at("lost"), hit.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")), op)
        n = total = 0
        posted = None
        if not rows.isEmpty():
            cut = self._numbered(rows, op)
            n, total = cut.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
            store.append(self._at("docs"), cut.drop("words"), op, ("block", "slot"))
            posted = _posted(cut)
        elif not says["dead"] and not forget:
            store.release(op)
            return
        store.append(self._at("postings"), posted, op, ("term", "block"), forget, lambda posted: _unpacked(posted, op), n=says["n"] + n, words=says["words"] + total, dead=says["dead"])
        for part in ("docs", "dead", "lost") if forget else ():
            store.append(self._at(part), None, forget=forget)
        store.release(op)

    def _numbered(self, rows: DataFrame, op: str) -> DataFrame:
        """(op, block, slot, collection, chunk_id, len, words), numbered in order of ids; held, as numbers depend on the run.

        Texts are shuffled, which are smaller than their words.
        """
        whole = rows.select("collection", F.col("chunk_id").cast(self.id_type).alias("chunk_id"), "content")
        number = whole.repartitionByRange("chunk_id", "collection").sortWithinPartitions("chunk_id", "collection").withColumn("no", F.monotonically_increasing_id())
        words = number.withColumn("words", text.terms(F.coalesce("content", F.lit(""))))
        return self.store.held(words.select(F.lit(op).alias("op"), F.floor(F.col("no") / self.block).alias("block"), (F.col("no") % self.block).cast("int").alias("slot"), "collection", "chunk_id", F.size("words").alias("len"), "words"), op)

    def replace_all(self, rows: DataFrame) -> None:
        """The index of ``rows`` alone, as one write: what was deleted takes no room any more."""
        self.put(rows, forget=tuple(self._writes()))

    def bootstrap(self, chunks: DataFrame) -> list[str]:
        """Index the collections of which the index has no document; returns their names."""
        missing = chunks.select("collection").distinct().join(self.counts(), "collection", "left_anti")
        names = [r.collection for r in missing.orderBy("collection").collect()]  # collections are few, as in a catalogue
        if names:
            self.put(chunks.where(F.col("collection").isin(*names)))
        return names

    # searching
    def _found(self, posted: DataFrame, phrases: list[list[str]], writes: dict[str, dict]) -> DataFrame:
        """(op, block, slot, len, phrase, f): how often each document has each phrase."""
        parts = [(i, len(p), k, w) for i, p in enumerate(phrases) for k, w in enumerate(p)]
        wanted = F.broadcast(self.store.spark.createDataFrame(parts, "phrase int, words int, offset int, term string"))
        key = ["op", "block", "slot", "len", "phrase"]
        zipped = lambda *columns: F.inline(F.arrays_zip(*columns))
        met = posted.join(wanted, "term")
        single = met.where("words = 1").select("op", "block", "phrase", zipped("slots", "lens", "tfs")).select("op", "block", F.col("slots").alias("slot"), F.col("lens").alias("len"), "phrase", F.col("tfs").alias("f"))
        out = single
        if any(len(p) > 1 for p in phrases):
            many = met.where("words > 1").select("op", "block", "phrase", "words", "offset", zipped("slots", "lens", "positions"))
            at = many.select("op", "block", F.col("slots").alias("slot"), F.col("lens").alias("len"), "phrase", "words", "offset", F.explode("positions").alias("pos"))
            starts = at.groupBy(*key, "words", (F.col("pos") - F.col("offset")).alias("at")).count().where("count = words")
            out = single.unionByName(starts.groupBy(*key).agg(F.count("*").cast("int").alias("f")))
        return self._alive(out, writes)

    def _means(self, writes: dict[str, dict]) -> tuple[int, float]:
        total = sum(w["n"] for w in writes.values())
        return total, sum(w["words"] for w in writes.values()) / max(1, total) or 1.0

    def _scored(self, found: DataFrame, writes: dict[str, dict], counts: dict[int, int] | None = None) -> DataFrame:
        """(op, block, slot, bm25), the more negative the better; ``counts``: the documents of each phrase."""
        total, mean = self._means(writes)
        if counts is None:
            known = F.broadcast(found.groupBy("phrase").agg(F.count("*").alias("n")))  # a row a phrase
        else:
            known = F.broadcast(self.store.spark.createDataFrame(list(counts.items()), "phrase int, n long"))
        weight = idf(F.col("n"), total) * tf_weight(F.col("f"), F.col("len"), mean)
        return found.join(known, "phrase").groupBy("op", "block", "slot").agg(F.round(-F.sum(weight), 6).alias("bm25"))

    def matches(self, phrases: list[list[str]]) -> DataFrame:
        """(collection, chunk_id, bm25) of every document with any of the phrases."""
        writes = self._writes()
        scores = self._scored(self._found(self._posted(phrases, writes), phrases, writes), writes)
        return self._read("docs", writes).join(scores, ["op", "block", "slot"]).select("collection", "chunk_id", "bm25")

    def phrase_counts(self, phrase: list[str]) -> DataFrame:
        """(collection, chunk_id, f): how often each document that has the phrase has it."""
        writes = self._writes()
        found = self._found(self._posted([phrase], writes), [phrase], writes)
        return self._read("docs", writes).join(found, ["op", "block", "slot"]).select("collection", "chunk_id", F.col("f").cast("long").alias("f"))

    def _posted(self, phrases: list[list[str]], writes: dict[str, dict]) -> DataFrame:
        return self._read("postings", writes, sorted({w for p in phrases for w in p}))

    def top(self, phrases: list[list[str]], k: int, where: Column | None = None) -> DataFrame:
        """(collection, chunk_id, bm25) of the k best documents, of those that pass ``where`` on ``docs``.

        Ties go to the smaller chunk_id. If the terms stand in more than ``FEW_BLOCKS`` blocks
        and no phrase has several words, blocks are pruned: the bounds of all blocks follow
        from the numbers beside the postings, the most promising ``SEEDS`` are scored, and of
        the others only those whose bound reaches the k-th best score so far.
        """
        writes = self._writes()
        posted = self._posted(phrases, writes)
        docs = None if where is None else self._read("docs", writes).where(where)
        may_be_many = sum(w["n"] for w in writes.values()) // self.block * len(phrases) > FEW_BLOCKS
        if may_be_many and all(len(p) == 1 for p in phrases):
            counts, blocks = self._term_counts(posted, phrases, writes)
            if blocks > FEW_BLOCKS:
                posted = self._promising(posted, phrases, counts, writes, k, docs)
            scores = self._scored(self._found(posted, phrases, writes), writes, counts)
        else:
            scores = self._scored(self._found(posted, phrases, writes), writes)
        if docs is not None:
            return docs.join(scores, ["op", "block", "slot"]).orderBy("bm25", "chunk_id", "collection").limit(k).select("collection", "chunk_id", "bm25")
        # numbers are in order of ids within a write: at most k rows of each write go on
        order = Window.partitionBy("op").orderBy("bm25", "block", "slot")
        best = scores.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("op", "block", "slot", "bm25").collect()
        blocks = sorted({r.block for r in best})
        hits = self.store.spark.createDataFrame([tuple(r) for r in best], "op string, block long, slot int, bm25 double")
        name = self._at("docs")
        now = self.store.version(name)
        named = self.store._rows(name, now, [bucket_of(str(b), now.buckets) for b in blocks], writes).where(F.col("block").isin(*blocks) if blocks else F.lit(False))
        return named.join(F.broadcast(hits), ["op", "block", "slot"]).orderBy("bm25", "chunk_id", "collection").limit(k).select("collection", "chunk_id", "bm25")

    def _term_counts(self, posted: DataFrame, phrases: list[list[str]], writes: dict[str, dict]) -> tuple[dict[int, int], int]:
        """The documents of each phrase of one word, and the blocks that hold any: from the numbers alone."""
        found = {r.term: (r.n, r.blocks) for r in posted.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).collect()}
        lost: dict[str, int] = {}
        if any(w["dead"] for w in writes.values()):
            lost = {r.term: r.n for r in self._read("lost", writes, sorted(found) or [""]).groupBy("term").agg(F.sum("n").alias("n")).collect()}
        return {i: found.get(p[0], (0, 0))[0] - lost.get(p[0], 0) for i, p in enumerate(phrases)}, sum(b for _, b in found.values())

    def bounds(self, posted: DataFrame, phrases: list[list[str]], counts: dict[int, int], writes: dict[str, dict]) -> DataFrame:
        """(op, block, bound): the most that a document of a block can score."""
        total, mean = self._means(writes)
        known = F.broadcast(self.store.spark.createDataFrame([(p[0], n) for (i, n), p in zip(counts.items(), phrases, strict=True)], "term string, df long"))
        most = idf(F.col("df"), total) * tf_weight(F.col("max_tf"), F.col("min_len"), mean)
        return posted.select("op", "block", "term", "max_tf", "min_len").join(known, "term").groupBy("op", "block").agg(F.sum(most).alias("bound"))

    def _promising(self, posted: DataFrame, phrases: list[list[str]], counts: dict[int, int], writes: dict[str, dict], k: int, docs: DataFrame | None) -> DataFrame:
        """The postings of the blocks that can hold one of the k best."""
        bounds = self.bounds(posted, phrases, counts, writes)
        first = posted.join(F.broadcast(bounds.orderBy(F.desc("bound"), "op", "block").limit(SEEDS).select("op", "block")), ["op", "block"], "left_semi")
        scores = self._scored(self._found(first, phrases, writes), writes, counts)
        if docs is not None:
            scores = scores.join(docs.select("op", "block", "slot"), ["op", "block", "slot"], "left_semi")
        known = [-r.bm25 for r in scores.orderBy("bm25").limit(k).collect()]
        if len(known) < k:
            return posted
        return posted.join(bounds.where(F.col("bound") >= known[-1] - 1e-5), ["op", "block"], "left_semi")
