"""Lexical search, the filter audit and URL filters against brute force, and on odd rows."""

import math
import itertools
import random
import re
from collections import Counter
from itertools import permutations

import pytest

from loregrid.llm import filter_audit, lexical_search, url_rules

SCHEMA = "doc_id long, text string, lang string, source string, mask int, words string, part string, terms string, length long, rank int, score long, n long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["the", "of", "Épée", "año", "x1", "UPPER", "a-b", "tail", "#tag", "MORE", *[f"w{i}" for i in range(60)]]
    texts = [None, "", " \t\n", "-- !!", "the", "The the THE", "w1" * 900]
    texts += [" ".join(rng.choices(vocabulary, weights=[40, 30, *[3] * 68], k=rng.choice([5, 40, 190, 230, 400]))) for _ in range(60)]
    texts += [texts[20]] * 30 + [texts[30] + " tail"] * 3
    texts.append(" ".join(rng.choices(vocabulary, k=300_000)))
    out = [(i, t, rng.choice(["en", "de", "", None]), "s") for i, t in enumerate(texts)]
    return [*out, (None, texts[21], "en", "s"), (5, texts[5], "en", "s"), (25, texts[25], "de", "s"), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "w", "p", "t", 2, 3, 4, 5) for r in rows], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


ITEMS = [(0, "the of Épée"), (1, "THE w1 w2 w3 the"), (2, None), (3, "nowhere"), (4, "tail UPPER"), (1, "w4 w1"), (None, "the"), (5, ""), (6, "w5 w6 w7 w8 more")]


def ranked_by_hand(rows, k, once):
    found = [(i, Counter(TERM.findall(lower(t or "")))) for i, t, *_ in rows]
    n_docs, total = sum(1 for _, c in found if c), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    items = {}
    for item, text in ITEMS:
        if item is not None:
            items.setdefault(item, Counter()).update(TERM.findall(lower(text or "")))
    out = set()
    for item, asked in items.items():
        scores = []
        for doc, c in found:
            m = 50 + (50 * c.total() * n_docs) // total
            score = sum((1 if once else times) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t, times in asked.items() if c[t])
            if score > 0 and doc is not None:
                scores.append((-score, doc))
        out |= {(item, i + 1, doc, -s) for i, (s, doc) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize(("k", "once", "entries", "postings"), [(50, True, 1 << 20, 1 << 21), (3, True, 4, 50), (200, False, 1 << 20, 7)])
def test_lexical_search(spark, docs, rows, k, once, entries, postings, monkeypatch):
    monkeypatch.setattr(lexical_search, "ENTRIES", entries)
    monkeypatch.setattr(lexical_search, "POSTINGS", postings)
    items = spark.createDataFrame([(i, t, 1.0) for i, t in ITEMS], "item_id long, text string, score double")
    found = [tuple(r) for r in lexical_search.ranked(docs, items, k, once).collect()]
    assert len(found) == len(set(found))
    assert set(found) == ranked_by_hand(rows, k, once)


def test_lexical_search_of_empty_tables(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.ranked(empty, items).isEmpty()
    assert lexical_search.ranked(docs, items.limit(0)).isEmpty()
    assert lexical_search.ranked(docs.where("text IS NULL"), items).isEmpty()


LABELS = [(i, (None, 0, 1)[i % 3], (1, 0, None)[i % 3]) for i in range(0, 60, 2)] + [(20, 1, 1), (20, 0, 0), (None, 1, 1), (10_000, 1, 1)]


def audit_by_hand(rows):
    least = {}
    for doc, text, *_ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    good, toxic = ({d for d, *v in LABELS if v[at] == 1 and d is not None} for at in (0, 1))
    found = []
    for doc, text, lang, _ in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = "".join(f for f, bad in zip("ABCDE", [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), bool(set(text) & set("#$%&*|")), doc is not None and doc > least[text]], strict=True) if bad)
        found.append((lang or "", fails, doc in good, doc in toxic))
    out, removed_by = {}, Counter()
    for part in {f[0] for f in found}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in found if f[0] == part]
            whole = left
            for step, name in enumerate(order, 1):
                gone, left = [f for f in left if name in f[1]], [f for f in left if name not in f[1]]
                removed_by[part, name] += len(gone)
                failing = [f for f in whole if name in f[1]]
                out[part, order, step] = (len(left), len(gone), len(failing) - len(gone), sum(f[1] == name for f in failing), sum(f[2] for f in gone), sum(f[3] for f in gone))
    return {(*key, *value, removed_by[key[0], key[1][key[2] - 1]]) for key, value in out.items()}


def test_filter_audit(spark, docs, rows):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = [tuple(r) for r in filter_audit.audit(filter_audit.histogram(docs, labels)).collect()]
    assert len(found) == 600 * 3
    assert set(found) == audit_by_hand(rows)


def test_filter_audit_of_empty_tables(spark, docs, empty):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.histogram(empty, labels)).isEmpty()
    none = filter_audit.audit(filter_audit.histogram(docs, labels.limit(0)))
    assert none.count() == 1800
    assert none.selectExpr("sum(good_lost + toxic_lost)").first()[0] == 0


URLS = [
    None, "", "no scheme", "http://", "HTTP://Example.NET/en/1", "http://example.net", "http://a.example.net/en", "http://example.net?x=/en/", "x://EXAMPLE.com/de/9?u=http://b.net/",
    "http://notexample.com/de/1", "http://sub.org/fr/", "http://org/fr/#/de", "http://net/", "http://NET#a/b", "http://a.net:80/", "http://http://net/", "://net/x", "https://example.net/EN/", "http://é.net/\n/ü?q", "http://" + "a." * 3000 + "net/" + "p/" * 9000,
]


def judged_by_hand(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(len(h + p), h + p, v) for v, h, p in url_rules.LISTED if (lower(host) == h or lower(host).endswith("." + h)) and path.startswith(p)]
    return (lower(host), path, *(max(fits)[1:] if fits else (None, "allow")))


def test_listed_hosts_and_paths(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judged(pages, url_rules.Rules([], {})).collect()}
    assert found == {i: judged_by_hand(u) for i, u in enumerate(URLS)}


def planted(rng, n):
    """Pages of which those of one host under one path, and those with one query pair, are bad."""
    for i in range(n):
        host, kind, tail = rng.choice(["news", "casino", "shop", "wiki"]), rng.choice(["win", "info", "about", "jobs", "faq"]), rng.choice(["", "?ref=spam", "?ref=ok", "?ref=ok", "?ref=news", "#top"])
        yield i, f"https://{host}.site.com/{kind}/{i}{tail}", (host == "casino" and kind == "win") or tail == "?ref=spam"


def test_mined_rules_find_what_was_planted(spark):
    rng = random.Random(3)
    known = spark.createDataFrame([(u, b) for _, u, b in planted(rng, 3000)] + [("https://news.site.com/info/7", True)] * 1500 + [(None, True), ("https://shop.site.com", None)], "url string, blocked boolean")
    rules = url_rules.mine(known)
    assert all(confidence >= url_rules.CONFIDENCE for _, confidence in rules.found)
    assert frozenset({"pair:ref=spam"}) in dict(rules.found)
    assert any("path:win" in c and len(c) == 2 for c, confidence in rules.found if confidence == 1)
    fresh = [(i, u, b) for i, u, b in planted(random.Random(4), 500)]
    out = url_rules.judged(spark.createDataFrame(fresh, "page_id long, url string, host boolean"), rules)
    assert {(r.page_id, r.verdict) for r in out.collect()} == {(i, "block" if b else "allow") for i, _, b in fresh}


def test_index_equals_a_scan_of_all_rules():
    rng = random.Random(9)
    names = [f"t{i}" for i in range(12)]
    found = [(frozenset(rng.sample(names, rng.randint(1, 4))), rng.random()) for _ in range(200)]
    rules = url_rules.Rules(found, {t: rng.randrange(50) for t in names})
    for _ in range(300):
        held = set(rng.sample(names, rng.randint(0, 8)))
        assert rules.best(held) == next((i for i, (c, _) in enumerate(found) if c <= held), -1)


def test_rules_without_labels_or_pages(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(0, "http://x.com/1")], "page_id long, url string")
    rules = url_rules.mine(url_rules.labelled_pages(pages, labels))
    assert rules.found == []
    assert url_rules.judged(pages.limit(0), rules).isEmpty()
    assert [r.verdict for r in url_rules.judged(pages, rules).collect()] == ["allow"]


def test_pages_take_the_labels_of_their_document(spark):
    pages = spark.createDataFrame([(1, "http://x.com/en/12.html?p=3"), (2, "http://x.com/13/"), (3, "http://x.com/en/"), (4, None), (5, "http://x.com/14#9"), (6, "http://x.com/" + "9" * 30)], "page_id long, url string")
    labels = spark.createDataFrame([(12, 1, 1), (13, 0, 0), (13, 1, 0), (14, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    found = {(r.url[:20], r.blocked) for r in url_rules.labelled_pages(pages, labels).collect()}
    assert found == {("http://x.com/en/12.h", True), ("http://x.com/13/", True), ("http://x.com/14#9", False)}


def test_rules_of_any_number_of_tokens_are_all_found(spark):
    """Against all combinations by hand, of URLs of 14 tokens."""
    rng = random.Random(11)
    urls = {}
    for i in range(700):
        held = sorted(rng.sample(range(14), 8))
        urls[f"http://h.x/{i}?" + "&".join(f"k={'abcdefghijklmn'[j]}" for j in held)] = set(held) >= {3, 9} or set(held) >= {1, 5, 12} or rng.random() < 0.02
    known = spark.createDataFrame(list(urls.items()), "url string, blocked boolean")
    rules = url_rules.mine(known)
    rows = [({"pair:k=" + x for x in u.partition("?")[2].replace("k=", "").split("&")}, b) for u, b in urls.items()]
    names = sorted(set().union(*(t for t, _ in rows)))
    sure = {}
    for size in range(1, 6):
        for c in itertools.combinations(names, size):
            labels = [b for t, b in rows if t >= set(c)]
            if sum(labels) >= url_rules.LEAST:
                sure[frozenset(c)] = sum(labels) / len(labels)
    below = lambda c: max((v for p, v in sure.items() if p < c), default=0.0)
    wanted = {c: v for c, v in sure.items() if v >= url_rules.CONFIDENCE and v > below(c)}
    assert {c: v for c, v in rules.found if len(c) < 6} == pytest.approx(wanted) and len(wanted) > 2


def test_more_than_a_thousand_rules(spark):
    known = spark.range(1100 * 20).selectExpr("concat('http://', lpad(translate(cast(id div 20 as string), '0123456789', 'abcdefghij'), 4, 'z'), '.s.org/', id) AS url", "true AS blocked").unionByName(spark.range(30000).selectExpr("concat('http://s.org/', id) AS url", "false AS blocked"))
    rules = None
    try:
        old, url_rules.SUPPORT = url_rules.SUPPORT, 0.0001
        rules = url_rules.mine(known)
    finally:
        url_rules.SUPPORT = old
    assert sum(any(t.startswith("host:") and t.endswith(".s.org") for t in c) for c, _ in rules.found) == 1100
    judged = url_rules.judged(spark.createDataFrame([(1, "http://zaaj.s.net"), (2, "http://www.bjj.s.org/")], "page_id long, url string"), rules)
    assert judged.count() == 2
