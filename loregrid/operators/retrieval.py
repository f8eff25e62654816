"""Retrieval: cosine nearest neighbours, BM25 over postings, and their hybrid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors in double precision, within -1 and 1; null if either is zero or not finite."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((norm > 0) & (norm < float("inf")), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def nearest(chunks: DataFrame, query: list[float], n: int, by: str | None = None, where: Column | None = None) -> DataFrame:
    """The n rows closest to ``query`` by cosine distance (with ``by``: of each group), with distance and rank.

    ``chunks`` has chunk_id and embedding. The filter runs before the distances; ties go to
    the smaller chunk_id. One partial top-n per task, so only n rows a task are shuffled.
    """
    rows = chunks if where is None else chunks.where(where)
    scored = rows.where("embedding IS NOT NULL").withColumn("distance", F.round(1 - cosine(F.col("embedding"), vector(query)), 9)).where("distance IS NOT NULL")
    if by is None:
        top = scored.orderBy("distance", "chunk_id").limit(n)
        return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", "chunk_id")))
    order = Window.partitionBy(by).orderBy("distance", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def postings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, term, tf, positions, len): the inverted index of the column content."""
    words = chunks.select("chunk_id", text.terms(F.col("content")).alias("words"))
    each = words.select("chunk_id", F.size("words").alias("len"), F.posexplode("words").alias("pos", "term"))
    return each.groupBy("chunk_id", "term").agg(F.count("*").cast("int").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"), F.first("len").alias("len"))


def query_phrases(query: str, synonyms: bool = False) -> list[list[str]]:
    """A query's tokens, each a phrase of one or more folded words; with synonyms, theirs too."""
    import re

    tokens = re.findall(r"[A-Za-z0-9_#./:-]+", query)
    if synonyms:
        tokens += [s for t in tokens for s in fixed.SYNONYMS.get(t.lower(), [])]
    fold = str.maketrans(text.ACCENTED, text.PLAIN)
    phrases = [re.findall(r"[^\W_]+", t.lower().translate(fold)) for t in dict.fromkeys(tokens)]
    return [p for p in phrases if p]


def bm25(index: DataFrame, lengths: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """(chunk_id, bm25): the more negative the better, for chunks with any of the phrases.

    ``lengths`` has (chunk_id, len) of every chunk. Only postings of the query's terms are
    read; the number of chunks and the mean length are those of the whole table.
    """
    spark = index.sparkSession
    parts = [(i, len(p), k, w) for i, p in enumerate(phrases) for k, w in enumerate(p)]
    wanted = spark.createDataFrame(parts, "phrase int, words int, offset int, term string")
    terms = sorted({p[3] for p in parts})
    near = index.where(F.col("term").isin(terms)).join(F.broadcast(wanted), "term")
    starts = near.select("chunk_id", "phrase", "words", "len", "offset", F.explode("positions").alias("pos")).groupBy("chunk_id", "phrase", "words", "len", (F.col("pos") - F.col("offset")).alias("at")).count().where("count = words")
    found = starts.groupBy("chunk_id", "phrase", "len").agg(F.count("*").alias("f"))
    counts = found.groupBy("phrase").agg(F.count("*").alias("n"))
    stats = lengths.agg(F.count("*").alias("total"), F.avg("len").alias("mean"))
    k1, b = fixed.BM25_K1, fixed.BM25_B
    idf = F.log((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf <= 0, F.lit(fixed.IDF_FLOOR)).otherwise(idf)
    weight = F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    joined = found.join(F.broadcast(counts), "phrase").crossJoin(F.broadcast(stats))  # one row
    return joined.groupBy("chunk_id").agg(F.round(-F.sum(idf * weight), 6).alias("bm25"))


def lengths(chunks: DataFrame) -> DataFrame:
    """(chunk_id, len): words counted, not made, as folding letters moves no word's bounds."""
    return chunks.select("chunk_id", F.coalesce(F.regexp_count(F.lower("content"), F.lit(r"[\p{L}\p{N}]+")), F.lit(0)).alias("len"))


def keyword_search(chunks: DataFrame, phrases: list[list[str]], n: int, by: str | None = None, where: Column | None = None, scores: DataFrame | None = None) -> DataFrame:
    """The n best rows by BM25 (with ``by``: of each group): the columns of ``chunks``, bm25 and rank from 0.

    The number of chunks, their mean length and the terms' counts are those of all ``chunks``,
    whatever ``where`` lets through. Ids alone are ranked. ``scores`` are the matches of a
    stored index, (chunk_id, bm25); without them the contents are taken apart here.
    """
    if scores is None:
        scores = bm25(postings(chunks), lengths(chunks), phrases)
    passing = chunks if where is None else chunks.where(where)
    hits = passing.select("chunk_id", *[by] * bool(by)).join(scores, "chunk_id")
    order = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy("bm25", "chunk_id")
    if by is None:
        hits = hits.orderBy("bm25", "chunk_id").limit(n)
    best = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).withColumn("rank0", F.col("place") - 1).drop("place")
    return chunks.join(best.drop(*[by] * bool(by)), "chunk_id")


def collection_filter(rows: DataFrame, keyword: bool, project: str | None = None, tags: list[str] | None = None, language: str | None = None, category: str | None = None, confirmed: bool = False) -> Column:
    """Which rows pass a search's filters, by the rules of their collection.

    The vector side drops what is not active, but for cards, and knows documents by the
    project of their front matter; the keyword side knows these by their project and leaves
    states to the end. Of several tags the first counts, as a pattern anywhere in the tags.
    Filters on columns that ``rows`` lacks match nothing.
    """
    has = lambda name: F.coalesce(F.col(name), F.lit("")) if name in rows.columns else F.lit("")
    kind = F.col("collection")
    semantic, cards, code = kind.isin("facts", "runbooks", "project_overviews"), kind == "memory_cards", kind == "codebase"
    out = F.lit(True) if keyword else cards | (F.coalesce(F.col("status"), F.lit("active")) == "active")
    if project is not None:
        own = F.when(code, has("project_name")).when(kind == "documents", has("project" if keyword else "frontmatter_project")).otherwise(has("project"))
        out = out & (own == project)
    if tags:
        out = out & (~(semantic | cards | (kind == "documents")) | has("tags").ilike(f"%{tags[0]}%"))
    if language is not None:
        out = out & (~code | (has("language") == language))
    if category is not None:
        out = out & (~(cards | kind.isin("discoveries", "conversations")) | (has("category") == category))
    if confirmed:
        out = out & ((kind != "discoveries") | (F.coalesce(F.col("confirmed"), F.lit(False)) if "confirmed" in rows.columns else F.lit(False)))
    return out


def visible(collection: Column, status: Column) -> Column:
    """Cards hide superseded states, all else hides what is not active; no status is active."""
    state = F.coalesce(status, F.lit("active"))
    return F.when(collection == "memory_cards", ~state.isin(fixed.HIDDEN_CARD_STATUSES)).otherwise(state == "active")


def hybrid_search(chunks: DataFrame, query: list[float], phrases: list[list[str]], k: int = fixed.TOP_K, threshold: float = fixed.SCORE_THRESHOLD, collections: list[str] | None = None, where: Column | None = None, scores: DataFrame | None = None, **filters) -> DataFrame:
    """The best k chunks by trust-weighted vector and keyword scores, over all collections.

    ``chunks`` has chunk_id, collection, content, embedding, trust_level, status,
    card_status and current_truth; ``filters`` are those of ``collection_filter``. Each leg
    keeps 4 k candidates a collection, counted over what passes its filter; keyword
    statistics are those of all chunks. Legs meet in a full outer join, and a chunk that one
    misses scores 0 there. Scores are rounded to 4 places after the threshold; ties go by
    collection and chunk_id. ``scores`` are the matches of a stored index; with them no content
    is read but that of the k hits.
    """
    asked = F.lit(True) if collections is None else F.col("collection").isin(collections)
    asked = asked if where is None else asked & where
    n = max(fixed.CANDIDATE_FACTOR * k, k)
    close = nearest(chunks, query, n, by="collection", where=asked & collection_filter(chunks, False, **filters))
    close = close.select("collection", "chunk_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("distance") / 2)).alias("vector_score"))
    narrow = chunks.drop("content", "embedding")
    words = keyword_search(chunks if scores is None else narrow, phrases, n, by="collection", where=asked & collection_filter(chunks, True, **filters), scores=scores).select("collection", "chunk_id", (1 / (1 + F.col("rank0"))).alias("keyword_score"))
    both = close.join(words, ["collection", "chunk_id"], "full_outer").na.fill(0.0, ["vector_score", "keyword_score"])
    known = both.join(narrow, ["collection", "chunk_id"]).where(visible(F.col("collection"), F.col("status")))
    trust = text.trust_weight(F.col("trust_level")) * F.when(F.col("collection") == "memory_cards", text.card_status_weight(F.col("status"), F.coalesce(F.col("current_truth"), F.lit(False)))).otherwise(1.0)
    raw = (fixed.VECTOR_SHARE * F.col("vector_score") + fixed.KEYWORD_SHARE * F.col("keyword_score")) * trust
    final = known.withColumn("raw", raw).where(F.col("raw") >= threshold).withColumn("score", F.round("raw", 4)).drop("raw")
    best = final.orderBy(F.desc("score"), "collection", "chunk_id").limit(k)
    if "content" not in chunks.columns:
        return best
    full = F.broadcast(best).join(chunks.select("collection", "chunk_id", "content"), ["collection", "chunk_id"])  # k rows
    return full.orderBy(F.desc("score"), "collection", "chunk_id")


def snippets(hits: DataFrame, most: int = 700) -> DataFrame:
    """What a search shows of its hits: the beginning of the content, and where it is."""
    return hits.withColumn("preview", F.substring("content", 1, most)).drop("content")
