"""URL filters: lists of hosts and paths, and association rules mined from labelled URLs.

A URL's tokens are its scheme, its host's suffixes of up to ``SUFFIXES`` labels, the words of its host and path, its
path's ending, its query's keys and pairs, and its fragment; numbers are none. A combination of
tokens becomes a rule if at least ``LEAST`` URLs, and ``SUPPORT`` of all, hold it with the label
"block", if ``CONFIDENCE`` of those that hold it have the label, and if no part of it does as
well. All such rules are found, of any number of tokens, and all are used. Rules are matched by
an inverted index: each is filed under its rarest token, so a URL meets only rules of which it
holds one token already.

Combinations grow by one token a step, as in Apriori. One that as many URLs hold as one of its
parts has that part's confidence, and so have all that contain both, with what they contain less
the difference: no rule is among them. Nor is one beyond a combination that is always to block.
Neither is grown, which loses no rule. A URL holds each combination once, so at most 1 / SUPPORT
times those of a URL are frequent, however many URLs there are: that much comes to the driver.

Equal URLs are one in training; of a URL that is labelled both ways, the majority counts,
a tie being "allow". Null URLs have no tokens. Without labels there are no rules, and
everything not listed is allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import prepare, saved

BLOCK, ALLOW = "block", "allow"
SUPPORT, LEAST, CONFIDENCE, SUFFIXES = 0.001, 20, 0.5, 8
#: (verdict, host, start of the path)
LISTED = [(BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ://, A-Z lower-cased, and the path after it; both empty without one."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]] = LISTED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    rule = verdict = F.lit(None).cast("string")
    for word, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):  # the longest is asked first
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        rule, verdict = F.when(fits, at + start).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL."""
    host, path = host_and_path(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - SUFFIXES + 1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    marked = lambda kind, words: F.transform(words, lambda w: F.concat(F.lit(kind), w))
    pairs = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    every = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, "^([^:/?#]*)://", 1)))),
        suffixes,
        marked("word:", F.split(host, r"[^\p{L}]+")),
        marked("path:", F.split(F.lower(path), r"[^\p{L}]+")),
        F.array(F.concat(F.lit("ends:"), F.lower(F.regexp_extract(path, r"(\.\p{L}+|/)$", 1)))),
        marked("key:", F.transform(pairs, lambda p: F.regexp_extract(p, "^[^=]*", 0))),
        marked("pair:", F.filter(pairs, lambda p: F.contains(p, F.lit("=")))),
        F.array(F.concat(F.lit("part:"), F.regexp_extract(url, "#(.*)$", 1))),
    )
    return F.coalesce(F.array_distinct(F.filter(every, lambda t: ~t.rlike(r"^[a-z]+:[\d.]*$") | t.rlike(r"^ends:[/.]"))), F.array().cast("array<string>"))


@dataclass
class Rules:
    """Combinations of tokens with the share of labelled URLs that hold them and are to block."""

    found: list[tuple[frozenset[str], float]]
    rarity: dict[str, int]
    index: dict[str, list[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for i, (combination, _) in enumerate(self.found):
            self.index.setdefault(min(combination, key=lambda t: (self.rarity.get(t, 0), t)), []).append(i)

    def best(self, held: set[str]) -> int:
        """The most confident rule whose tokens are all ``held``, or -1."""
        return min((i for t in held if t in self.index for i in self.index[t] if self.found[i][0] <= held), default=-1)


def _minimal(sets: dict[tuple[int, ...], tuple[int, int]], names: list[str]) -> list[tuple[frozenset[str], float]]:
    """The sets that are rules: sure enough, and surer than any part; the most confident, most frequent, smallest first."""
    best: dict[tuple[int, ...], float] = {}
    out = []
    for found, (held, bad) in sorted(sets.items(), key=lambda x: len(x[0])):
        parts = max((best.get(p, 0.0) for p in _parts(found)), default=0.0)
        best[found] = max(parts, bad / held)
        if bad / held >= CONFIDENCE and bad / held > parts:
            out.append((frozenset(names[i] for i in found), bad / held, bad))
    out.sort(key=lambda r: (-r[1], -r[2], len(r[0]), sorted(r[0])))
    return [r[:2] for r in out]


def _parts(found: tuple[int, ...]) -> list[tuple[int, ...]]:
    """A set without each of its members."""
    return [found[:i] + found[i + 1 :] for i in range(len(found))]


def mine(labelled: DataFrame) -> Rules:
    """Rules from (url, blocked), of which each is null-free or ignored."""
    votes = labelled.where("url IS NOT NULL AND blocked IS NOT NULL").groupBy("url").agg(F.sum(F.when(F.col("blocked"), 1).otherwise(-1)).alias("votes"))
    rows = saved(votes.select(F.monotonically_increasing_id().alias("row"), tokens(F.col("url")).alias("tokens"), (F.col("votes") > 0).alias("blocked")))
    n, bad = rows.agg(F.count("*"), F.count_if("blocked")).first()
    least = max(LEAST, SUPPORT * n)
    if bad < least:
        return Rules([], {})
    tally = [F.count("*").alias("held"), F.count_if("blocked").alias("bad")]
    each = rows.select("row", "blocked", F.explode("tokens").alias("token"))
    frequent = sorted(each.groupBy("token").agg(*tally).where(F.col("bad") >= least).collect(), key=lambda r: (r.held, r.token))
    sets = {(i,): (r.held, r.bad) for i, r in enumerate(frequent)}
    grow = [s for s, (held, bad) in sets.items() if bad < held < n]
    numbers = rows.sparkSession.createDataFrame([(r.token, i) for i, r in enumerate(frequent)], "token string, item int")
    items = each.join(F.broadcast(numbers), "token").groupBy("row").agg(F.first("blocked").alias("blocked"), F.array_sort(F.collect_list("item")).alias("items"))
    step = items.select("blocked", "items", F.explode(F.transform("items", lambda i: F.array(i))).alias("found"))
    while grow:
        open_ = rows.sparkSession.createDataFrame([(list(s),) for s in grow], "found array<int>")
        later = F.filter("items", lambda i: i > F.element_at("found", -1))
        wider = F.transform(later, lambda i: F.concat("found", F.array(i)))
        step = saved(step.join(F.broadcast(open_), "found").select("blocked", "items", F.explode(wider).alias("found")))
        known, grown = set(grow), {}
        for r in step.groupBy("found").agg(*tally).where(F.col("bad") >= least).toLocalIterator():
            found = tuple(r.found)
            if all(p in known and sets[p][0] > r.held for p in _parts(found)):
                grown[found] = (r.held, r.bad)
        sets |= grown
        grow = [s for s, (held, bad) in grown.items() if bad < held]
    return Rules(_minimal(sets, [r.token for r in frequent]), {r.token: r.held for r in frequent})


def matched(urls: Column, rules: Rules) -> Column:
    """The confidence of the most confident rule that a URL meets, or null."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            best = [rules.best(set(held)) for held in part]
            yield pd.Series([rules.found[i][1] if i >= 0 else None for i in best], dtype="float64")

    return run(tokens(urls))


def judged(pages: DataFrame, rules: Rules, lists: list[tuple[str, str, str]] = LISTED) -> DataFrame:
    """``pages`` with host, path, rule, verdict and confidence: a list's verdict, else the mined rules'.

    rule is the listed rule, or null; confidence is that of the mined rule that decided.
    """
    prepare(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    rule, verdict = listed(F.col("host"), F.col("path"), lists)
    rows = pages.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "_listed": verdict})
    if not rules.found:
        return rows.withColumns({"verdict": F.coalesce("_listed", F.lit(ALLOW)), "confidence": F.lit(None).cast("double")}).drop("_listed")
    rows = rows.withColumn("_mined", matched(F.when(F.col("_listed").isNull(), F.col("url")), rules))
    confidence = F.when(F.col("_listed").isNull(), F.col("_mined"))
    mined = F.when(confidence.isNotNull(), BLOCK).otherwise(ALLOW)
    return rows.withColumns({"verdict": F.coalesce(F.col("_listed"), mined), "confidence": confidence}).drop("_listed", "_mined")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, blocked): a page has the labels of the document that its path ends in the number of.

    It is to block if that document is toxic or of low quality.
    """
    path = host_and_path(F.col("url"))[1]
    known = pages.select("url", F.regexp_extract(path, r"(\d{1,18})[^\d/]*/?$", 1).try_cast("long").alias("doc_id"))
    said = labels.groupBy("doc_id").agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked"))
    return known.join(said, "doc_id").select("url", "blocked")


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by the lists, and where none speaks by rules mined from all labelled pages."""
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    rules = mine(labelled_pages(pages, labels))
    return judged(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict", "confidence")
