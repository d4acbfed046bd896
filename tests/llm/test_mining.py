"""Collocations, periodic runs and exact top-k search against plain definitions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as contract
from rolecall.llm import collocations, covertree, periodic
from rolecall.llm.storage import Staging
from tests.llm import brute
from tests.llm.test_queries import FOLDER, pytestmark, rows  # noqa: F401
from tests.llm.texts import ODD, prose


# collocations


def plain_collocations(docs, least, longest=5, cover=100, limit=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        for w in brute.phrase_pieces(text):
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        many = {p: c for p, c in count.items() if len(p) > 1 and c >= least}
        inside = defaultdict(int)
        for p, c in many.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], c)
        best = []
        for p, a in many.items():
            if 100 * inside[p] >= cover * a:
                continue
            score, _, l, r = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(best)[:limit], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def phrase_docs(seed, n=80):
    r = random.Random(seed)
    words = ["the", "of", "Data", "data", "lake", "ñandú", "漢字", "x" * 50, "a\x00b"]
    out = [(r.choice(["en", "de", None]), "".join(r.choice(words) + r.choice([" ", " ", "\t", "  ", ", ", ".\n", "!"]) for _ in range(r.randrange(60)))) for _ in range(n)]
    return out + [("en", t) for t in ODD] + [("en", "new york city hall " * 30)] * 4


def phrase_table(spark, docs):
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("text", T.StringType())])
    return spark.createDataFrame(docs, schema).withColumn("phrase", F.lit("clash")).withColumn("_text", F.lit(1)).repartition(5)


@pytest.mark.parametrize(("least", "cover", "limit"), [(3, 100, 2000), (12, 100, 5), (5, 80, 2000)])
def test_collocations_equal_plain_counts(spark, staging, least, cover, limit):
    docs = phrase_docs(least)
    found = collocations.collocations(phrase_table(spark, docs), staging, least, cover=cover, limit=limit)
    got = sorted(tuple(r)[:8] for r in found.collect())
    assert got == plain_collocations(docs, least, cover=cover, limit=limit) and len(got) > 5


def test_collocations_two_hops_and_empty(spark, staging):
    docs = phrase_docs(9)
    table = phrase_table(spark, docs)
    one = sorted(map(tuple, collocations.frequent_phrases(table, staging, 4).collect()))
    two = sorted(map(tuple, collocations.frequent_phrases(table, Staging(spark, "two"), 4, fan=5).collect()))
    assert one == two
    assert collocations.collocations(table.limit(0), Staging(spark, "none"), 4).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_summaries_keep_every_frequent_key(seed):
    r = random.Random(seed)
    least = 20
    keys = [r.randrange(30) if r.random() < 0.4 else r.randrange(10**6) for _ in range(4000)]
    summary = collocations.MisraGries(len(keys) // least + 1)
    at = 0
    while at < len(keys):
        n = r.choice([1, 50, 700])
        k, c = np.unique(np.array(keys[at : at + n], np.uint64), return_counts=True)
        summary.add(k, c)
        if r.random() < 0.5:
            summary.settle()
        at += n
    kept = set(summary.at_least(least).tolist())
    true = Counter(keys)
    assert {k for k, c in true.items() if c >= least} <= kept
    assert summary.error < least and len(summary.keys) <= summary.capacity
    assert all(true[k] - summary.error <= c <= true[k] for k, c in zip(summary.keys.tolist(), summary.counts.tolist(), strict=True))


def test_scores_beyond_64_bits(spark):
    """The score's products are exact beyond 64 bits."""
    big = 3 * 10**13
    got = spark.sql(f"SELECT CAST(1000 AS decimal(4,0)) * (CAST({big} AS decimal(19,0)) * CAST({big + 1} AS decimal(19,0))) DIV (CAST({big} AS decimal(19,0)) * CAST(7 AS decimal(19,0))) AS s").first()["s"]
    assert got == 1000 * big * (big + 1) // (big * 7)


# periodic runs


def plain_runs(w):
    whole = {}
    for q in range(1, len(w) // 3 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j > i and j - (i - q) >= max(24, 3 * q):
                whole.setdefault((i - q, j), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in whole.items())


def plain_op12(doc_id, text):
    w = brute.WHITE.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], brute.sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def looped_words(seed):
    r = random.Random(seed)
    n, k = r.randrange(400), r.choice([1, 2, 3, 5, 20, 1000])
    w = [r.randrange(k) for _ in range(n)]
    for _ in range(r.randrange(4) if n > 10 else 0):
        a = r.randrange(n)
        p = r.randrange(1, max(2, (n - a) // 3))
        for i in range(a + p, min(n, a + p * r.randrange(2, 6) + r.randrange(p))):
            w[i] = w[i - p]
    return w


def test_runs_equal_plain_search():
    some = 0
    for seed in range(800):
        w = looped_words(seed)
        want = plain_runs(w)
        assert periodic.runs(np.array(w, np.int64)) == want, seed
        some += len(want)
    assert some > 200


def test_runs_of_long_texts_stay_linear():
    assert periodic.runs(np.zeros(400_000, np.int64)) == [(0, 400_000, 1)]
    assert periodic.runs(np.arange(300_000) % 7) == [(0, 300_000, 7)]
    inner = periodic.runs(np.array(([1] * 50 + [2, 3]) * 2000))
    assert len(inner) == 2001 and (0, 104_000, 52) in inner


def test_periodic_rows(spark):
    texts = [*ODD, "a b c " * 50, " ".join(f"w{x}" for x in looped_words(7)), "x " * 23, "x " * 24, "é f " * 30, prose(3, 500)]
    data = [(i if i % 4 else None, t) for i, t in enumerate(texts)] * 2
    table = spark.createDataFrame(data, "doc_id long, text string").withColumn("runs", F.lit(0))
    got = table.select("doc_id", "text", "runs", periodic.periodic_runs("text").alias("p")).collect()
    assert len(got) == len(data)
    for r in got:
        w = brute.WHITE.findall(r["text"] or "")
        assert r["p"]["n_words"] == len(w) and [tuple(x) for x in r["p"]["runs"]] == plain_runs(w)
    assert table.limit(0).select(periodic.periodic_runs("text")).count() == 0
    assert [r[0] for r in table.where("doc_id IS NULL").select(periodic.looped("text", "doc_id")).limit(1).collect()] == [" ".join(brute.WHITE.findall(texts[0] or ""))]


def test_op12(spark, rows):  # noqa: F811
    got = {r["doc_id"]: tuple(r)[1:] for r in contract.queries()["op12_periodic_runs"](spark, FOLDER).collect()}
    assert got == {i: plain_op12(i, t) for i, t in rows}
    assert any(x[0] for x in got.values())


# exact top-k search


def plain_top(data, k, asks, scale=256):
    out = []
    whole = {}
    for i, v in data:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            whole[i, tuple(v)] = [int(np.floor(scale * float(x))) for x in v]
    for (q, _), x in whole.items():
        if asks(q):
            score = [(-sum(a * b for a, b in zip(x, y, strict=False)), i) for (i, _), y in whole.items() if i != q]
            out += [(q, rank, i, max(min(-s, 2**63 - 1), -(2**63))) for rank, (s, i) in enumerate(sorted(score)[:k], 1)]
    return sorted(out)


def points(seed, n, dim, ties=False):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    out = []
    for i in range(n):
        c = centres[0 if r.random() < 0.4 else r.randrange(6)]
        out.append((i * 2, [round(x + r.gauss(0, 0.05), 0 if ties else 6) for x in c]))
    return out


SCHEMA = "vec_id long, embedding array<double>"


@pytest.mark.parametrize(("seed", "dim", "ties", "block"), [(1, 8, False, 40), (2, 3, True, 25), (3, 16, False, 1 << 17)])
def test_top_k_equals_all_products(spark, staging, seed, dim, ties, block):
    data = points(seed, 400, dim, ties)
    table = spark.createDataFrame(data, SCHEMA).withColumn("block", F.lit("x")).withColumn("score", F.lit(0))
    found = covertree.top_k(table, staging, F.col("vec_id") % 10 == 0, block=block, group=7)
    assert sorted(map(tuple, found.collect())) == plain_top(data, 5, lambda q: q % 10 == 0)


def test_top_k_odd_rows(spark, staging):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (50, [0.5]), (50, [0.5]), (100, None), (150, []), (200, [nan, 1.0]), (250, [None, 1.0]), (300, [inf, 0.0]), (None, [1.0, 1.0]), (7, [0.0, 0.0]), (8, [0.0, 0.0]), (8, [3.0, -1.0]), (9, [1e5, 2e7]), (350, [1e12, 3e12]), (11, [-0.001, 0.001])]
    found = covertree.top_k(spark.createDataFrame(data, SCHEMA), staging, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, found.collect())) == plain_top(data, 5, lambda q: q % 50 == 0)
    one = covertree.top_k(spark.createDataFrame([(0, [1.0])], SCHEMA), Staging(spark, "one"), F.lit(True))
    assert one.collect() == []
    assert covertree.top_k(spark.createDataFrame([], SCHEMA), Staging(spark, "none"), F.lit(True)).count() == 0


def test_clusters_are_pruned():
    """Far clusters are not multiplied out."""
    r = np.random.default_rng(5)
    centres = r.normal(0, 1000, (40, 8))
    m = np.floor(np.repeat(centres, 200, axis=0) + r.normal(0, 3, (8000, 8)))
    tree, ids, seen = covertree.build(m), np.arange(8000), 0
    offer = covertree.Best.offer

    class Counting(covertree.Best):
        def offer(self, rows, score, who):
            nonlocal seen
            seen += score.size
            offer(self, rows, score, who)

    q = np.arange(0, 8000, 50)
    best = Counting(ids[q], np.full(len(q), -np.inf), 5)
    covertree.dual_search(m[q], m, tree, ids, best)
    want = m[q] @ m.T
    want[np.arange(len(q)), q] = -np.inf
    assert np.array_equal(best.score, -np.sort(-want, axis=1)[:, :5])
    assert seen < 0.2 * len(q) * len(m)


def test_products_beyond_doubles():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**40, 1.0], [1.0, 5.0]])
    assert covertree.products(a, b).tolist() == [[2**80 + 3, 2**40 + 15]]
