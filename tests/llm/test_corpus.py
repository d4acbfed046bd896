"""Operators that compare documents, against brute force on small corpora."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rolecall.llm import common, decontaminate, exchange, graph, jaccard, line_dedup, mixing, substring, toxicity
from rolecall.llm.storage import Staging
from tests.llm import brute
from tests.llm.texts import corpus, near, prose


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2)])
def test_line_dedup(docs, staging, batches, fanout):
    rows = corpus(3)
    df = docs(rows, n_lines=F.lit("clash"), owner=F.lit(1))
    out = line_dedup.drop_repeated_lines(df, staging, batches=batches, fanout=fanout)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], brute.sha(r["text"] or "")) for r in out.collect()}
    assert got == brute.op5(rows) and set(out.columns) == {*df.columns, "n_dropped"}
    assert out.where("text IS NULL").count() == df.where("text IS NULL").count()


def test_line_runs_are_compacted(spark, staging):
    runs = line_dedup.LineRuns(staging, 4, fanout=2)
    lines = spark.range(40).select(F.col("id").alias("_id"), (F.col("id") % 25).alias("_h1"), F.lit(0).cast("long").alias("_h2"))
    gone = [runs.absorb(lines.where(f"_id >= {i * 10} AND _id < {i * 10 + 10}")).count() for i in range(4)]
    assert gone == [0, 0, 5, 10] and [len(x) for x in runs.levels] == [0, 0, 1]
    assert runs.runs()[0].count() == 25 and runs.runs()[0].agg(F.max("owner")).first()[0] == 24


def test_line_dedup_of_odd_tables(docs, staging):
    assert line_dedup.drop_repeated_lines(docs([]), staging).count() == 0
    line = "a line of more than ten characters"
    out = line_dedup.drop_repeated_lines(docs([(None, line), (2, line), (2, line), (1, line.upper() + " ")]), staging)
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in out.collect()) == [(0, 0), (1, 0), (2, 1), (2, 1)]


@pytest.mark.parametrize("piece", [300, 4 << 20])
def test_substring_dedup(docs, staging, monkeypatch, piece):
    monkeypatch.setattr(common.pieces, "__defaults__", (piece,))
    rows = corpus(4)
    out = substring.drop_repeats(docs(rows, kept=F.lit(0), owner=F.lit(1)), staging)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], brute.sha(r["kept"])) for r in out.collect()}
    assert got == brute.op9(rows)


def test_substring_dedup_of_odd_tables(docs, staging):
    assert substring.drop_repeats(docs([]), staging).count() == 0
    text = " ".join(f"w{i}" for i in range(13))
    out = substring.drop_repeats(docs([(None, text), (7, text), (7, text), (8, "x " + text), (9, text[:-1])]), staging)
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in out.collect()) == [(0, 0), (7, 0), (7, 0), (8, 13), (9, 0)]


@pytest.mark.parametrize("fan", [4, 2048])
def test_exchange_in_one_or_two_hops(spark, monkeypatch, fan):
    r = random.Random(fan)
    rows = [(i, " ".join(str(r.randrange(200)) for _ in range(20))) for i in range(300)]
    monkeypatch.setattr(common.pieces, "__defaults__", (200,))

    def make(piece):
        import numpy as np

        w = common.words(*common.utf8(piece.column("t")))
        return exchange.Entries(w.hash, piece.column("i").to_numpy()[w.row], (np.arange(len(w.hash)) - w.first[w.row]).astype(np.int32))

    df = spark.createDataFrame(rows, "i long, t string").repartition(5)
    found = exchange.shared_keys(df, "t", make, 20, with_leader=False, fan=fan).collect()
    first = {}
    for i, t in rows:
        for w in t.split():
            first[w] = min(i, first.get(w, i))
    want = {i: [k for k, w in enumerate(t.split()) if first[w] < i] for i, t in rows}
    got = {x["owner"]: exchange.unpack(pa.array([bytes(x["places"])]), "int32")[0].tolist() for x in found}
    assert len(found) == len(got) and got == {i: p for i, p in want.items() if p}


def test_components(spark, staging):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(200, i) for i in range(201, 260)] + [(5, 5)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[max(top(a), top(b))] = min(top(a), top(b))
    got = graph.components(spark.createDataFrame(links, "a long, b long"), staging, "g").collect()
    assert len(got) == len({x["node"] for x in got}) and {x["node"]: x["root"] for x in got} == {x: top(x) for x in parent}


def family(seed, n, words):
    """Copies of one text with ever more edits: neighbours are linked, the ends are not."""
    out = [prose(seed, words, line=words)]
    for i in range(n - 1):
        out.append(near(out[-1], seed * 100 + i, max(1, words // 60)))
    return out


def test_jaccard_join(docs, staging, block=3):
    texts = [t for _, t in corpus(6)] + family(1, 14, 120) + family(2, 10, 260) + [near(prose(9, 150, 150), i, i % 9) for i in range(30)]
    random.Random(1).shuffle(texts)
    rows = [(i * 2 + 1, t) for i, t in enumerate(texts)]
    out = jaccard.similar_components(docs(rows, component_id=F.lit("clash"), sig=F.lit(1)), staging, block=block)
    assert by_id(out, "n_shingles", "component_id") == brute.op10(rows)


def test_jaccard_join_of_odd_tables(docs, staging):
    assert jaccard.similar_components(docs([]), staging).count() == 0
    out = jaccard.similar_components(docs([(3, "a b"), (3, "a b"), (1, "A  B"), (2, ""), (4, None), (None, "c d e f g")]), staging)
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in out.collect()) == [(0, 2, 0), (1, 1, 1), (2, 0, 2), (3, 1, 1), (3, 1, 1), (4, 0, 4)]


def test_similar_sets_share_a_signature():
    import numpy as np

    r = np.random.default_rng(3)
    for size, num in ((7, 85), (12, 85), (20, 80), (45, 85), (90, 80), (300, 85), (700, 80)):
        for _ in range(12):
            a = r.integers(0, 2**64, size, dtype=np.uint64)
            b = a.copy()
            while True:  # take features away and add others until one more would break the link
                c = np.append(b[1:], r.integers(0, 2**64, 1, dtype=np.uint64)) if r.random() < 0.6 else b[1:]
                if not jaccard.similar(np.sort(a), np.sort(c), num):
                    break
                b = c
            sets = [np.unique(a), np.unique(b)]
            row, sig, _ = jaccard.signatures(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]), num)
            assert len(row) < 3 * size + 60
            equal = len(sets[0]) == len(sets[1]) and (sets[0] == sets[1]).all()
            assert equal or set(sig[row == 0]) & set(sig[row == 1])


ITEM = "when Anna walks along the river for 12 km and then rests a while before Anna walks another 5 km home, how far does she get on that day?"


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, ITEM), (2, "short item here"), (3, ""), (4, None), (5, "12 13 14 15 16 17 18 19 20 21"), (6, ITEM)], "item_id long, text string")
    other = ITEM.replace("Anna", "Boris").replace("12", "40").replace("5 km", "9 km")
    mixed = ITEM.replace("Anna walks another", "Boris walks another")
    rows = [
        (1, prose(1, 50) + " " + ITEM + " " + prose(2, 50)),
        (2, prose(3, 30) + "\n" + other),
        (3, prose(4, 30) + " " + mixed),  # one name stands for two
        (4, prose(5, 90)),
        (5, "a short item, here"),
        (6, " ".join(ITEM.split()[:10]) + " " + prose(6, 40)),  # less than half
        (7, ""),
        (8, None),
        (9, "1 2 3 4 5 6 7 8 9 10 11 12"),
        (10, " ".join(w + "%%%" for w in ITEM.upper().lower().split())),
        (None, ITEM),
    ]
    df = docs(rows, item_id=F.lit(9), hash=F.lit("clash"))
    leaks = decontaminate.find_leaks(df, items)
    found = {(r["doc_id"], r["item_id"]) for r in leaks.collect()}
    assert {(1, 1), (1, 6), (2, 1), (2, 6), (5, 2)} <= found
    assert {d for d, _ in found} - {None} <= {1, 2, 5, 10} and 3 not in {d for d, _ in found}
    where = {r["doc_id"]: r["word"] for r in leaks.where("item_id = 1").collect()}
    assert where[1] == 50
    left = decontaminate.drop_leaks(df, items)
    assert {r["doc_id"] for r in left.collect()} == {r[0] for r in rows} - {d for d, _ in found if d} and left.columns == df.columns
    assert decontaminate.find_leaks(df.limit(0), items).count() == 0 and decontaminate.find_leaks(df, items.limit(0)).count() == 0


def leaks(spark, docs, items, texts):
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["share"] for r in decontaminate.find_leaks(docs(list(enumerate(texts))), items, veto=False).collect()}


def test_one_changed_filler_does_not_hide_an_item(spark, docs):
    mixed = ITEM.replace("Anna walks another", "Boris walks another")
    other = ITEM.replace("Anna", "Boris").replace("before Boris", "before Clara").replace("12", "40")
    found = leaks(spark, docs, [ITEM], [prose(4, 30) + " " + mixed, prose(5, 30), prose(6, 30) + " " + other])
    assert set(found) == {(0, 0), (2, 0)}


def test_copies_are_found_whatever_their_placeholders_and_case(spark, docs):
    names = "Anna Boris Clara 12 Denis Elena 15 Franz Greta 7 Hanna Élodie Ivan"
    short = "The river was cold. Anna Bell went home. What did Boris Hill say? Nobody Else Knew."
    numbers = "12 13 14 15 16 17 18 19 20 21"
    texts = [prose(4, 30) + " " + t + " " + prose(5, 30) for t in (names, names.lower(), names.upper(), short.lower(), short.upper(), numbers, "Anna Boris Clara 13 Denis Elena 16 Franz Greta 8 Hanna Zoe Ivan")]
    found = leaks(spark, docs, [names, short, numbers], texts)
    assert found == {(0, 0): 1.0, (1, 0): 1.0, (2, 0): 1.0, (3, 1): 1.0, (4, 1): 1.0, (5, 2): 1.0}


def test_number_words_glued_units_and_capitals_of_any_script(spark, docs):
    item = "When the market closed Tom had sold 3 of his 12 heavy baskets and Mary carried two more home, each of 5 kg, along the old river road."
    changed = [
        item.replace("3 of his 12", "four of his twelve").replace("two more", "five more"),
        item.replace("Tom", "Иван").replace("Mary", "Ольга"),
        item.replace("5 kg", "9kg"),
        item.replace("5 kg", "seven kg").replace("Mary", "Élodie"),
    ]
    texts = [prose(4, 30) + " " + t + " " + prose(5, 30) for t in changed] + [prose(6, 80)]
    assert set(leaks(spark, docs, [item], texts)) == {(i, 0) for i in range(4)}


def test_a_long_passage_of_a_longer_item_is_found(spark, docs):
    item = prose(8, 200).split()
    texts = [prose(4, 30) + " " + " ".join(item[a:b]) + " " + prose(5, 30) for a, b in ((60, 150), (60, 73), (60, 70))]
    found = leaks(spark, docs, [" ".join(item)], texts)
    assert set(found) == {(0, 0), (1, 0)} and 0.4 < found[0, 0] < 0.5


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 1, "b": 1000, "c": 3, "d": 7, "e": 11.5}])
def test_pattern_keeps_less_than_a_block(weights):
    share = mixing.shares(weights, 997)
    assert sum(share.values()) == 997
    seen = Counter()
    for slot, s in enumerate(mixing.pattern(share), 1):
        seen[s] += 1
        assert all(abs(seen[x] - share[x] * slot / 997) < 1 for x in share)


def test_phases_use_every_block_once():
    blocks, weights = {"a": 500, "b": 37, "c": 120, "d": 1}, {"a": 1.0, "b": 1.0, "c": 2.0, "d": 5.0}
    slots = {}
    for s, first, end, start, period, places in mixing.phases(blocks, weights, 50):
        for j in range(first, end):
            k = j - first
            at = start + k // len(places) * period + places[k % len(places)]
            assert at not in slots
            slots[at] = (s, j)
    assert sorted(slots) == list(range(sum(blocks.values())))
    order = defaultdict(list)
    for at in sorted(slots):
        order[slots[at][0]].append(slots[at][1])
    assert {s: list(range(n)) for s, n in blocks.items()} == order


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 0.9, **{f"s{i}": 0.1 / 600 for i in range(600)}}, {"a": 0.7, "b": 0.2, "c": 0.1, "d": 2**0.5}])
def test_schedule_keeps_less_than_a_block_of_the_exact_weights(weights):
    total = sum(weights.values())
    blocks = {s: int(w / total * 20_000) + 40 for s, w in weights.items()}
    slots = mixing.schedule(blocks, weights)
    assert sorted(x for s in slots.values() for x in s.tolist()) == list(range(sum(blocks.values())))
    first = int(min(blocks[s] * total / w for s, w in weights.items()))  # until then no source has run out
    for s, x in slots.items():
        x, share = x[x < first].tolist(), weights[s] / total
        assert x == sorted(x) and len(x) > 2
        assert all(abs(j - share * t) < 1 + 1e-6 and abs(j + 1 - share * (t + 1)) < 1 + 1e-6 for j, t in enumerate(x))


def test_schedule_goes_on_when_sources_run_out():
    blocks = {"a": 500, "b": 37, "c": 120, "d": 1, "e": 0, "f": 3, "g": 2}
    slots = mixing.schedule(blocks, {"a": 1.0, "b": 1.0, "c": 2.0, "d": 5.0, "e": 1.0, "f": 0.0, "g": 0.0})
    assert sorted(x for s in slots.values() for x in s.tolist()) == list(range(663))
    assert all((x[1:] > x[:-1]).all() for x in slots.values()) and min(*slots["f"], *slots["g"]) == 658
    with pytest.raises(ValueError):
        mixing.schedule({"a": 1}, {"a": -1.0})


def test_mixing_by_exact_weights(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    rows = [(i, "x" * 400, "abc"[i % 3]) for i in range(600)]
    got = mixing.mix_sources(docs(rows), dict.fromkeys("abc", 1.0), block_chars=400).collect()
    want = mixing.schedule(dict.fromkeys("abc", 201), dict.fromkeys("abc", 1.0))
    assert len(got) == 600 and all(x["mix_slot"] == want[x["source"]][x["mix_block"]] for x in got)
    assert mixing.mix_sources(docs(rows).limit(0)).count() == 0


def test_mixing(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    r = random.Random(4)
    rows = [(i, "x" * r.choice([0, 30, 200, 900]), r.choice(["hot"] * 6 + ["b", "c", None])) for i in range(400)] + [(1000, None, "b"), (1001, "y" * 9000, "c"), (None, "zz", "b"), (3, "x", "hot"), (3, "x", "hot")]
    df = docs(rows, mix_slot=F.lit("clash"), _len=F.lit(1))
    got = mixing.mix_sources(df, {"hot": 3.0, "b": 2.0}, block_chars=500, period=20).collect()
    assert Counter((x["doc_id"], x["source"]) for x in got) == Counter((x[0], x[2]) for x in rows)
    by = defaultdict(list)
    for x in got:
        assert x["mix_block"] == x["mix_at"] // 500
        by[x["source"] or ""].append(x)
    for s in by.values():  # prefix sums: the documents of a source tile its characters
        at = 0
        for x in sorted(s, key=lambda x: (x["mix_at"], len(x["text"] or ""))):
            assert x["mix_at"] == at
            at += len(x["text"] or "")
    place = {(x["source"] or "", x["mix_block"]): x["mix_slot"] for x in got}
    assert len(set(place.values())) == len(place)
    assert all(place[s, j] < place[s, k] for s, j in place for t, k in place if s == t and j < k)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def toxic_corpus(seed, n, share=0.2):
    r = random.Random(seed)
    bad = ["scoundrel", "vermin", "halfwit", "blockhead"]
    out = []
    for i in range(n):
        w, y = prose(seed * 10_000 + i, 80 + r.randrange(300)).split(" "), int(r.random() < share)
        for _ in range(6 * y):
            w.insert(r.randrange(len(w)), r.choice(bad))
        out.append((i, " ".join(w), y))
    return out


def test_toxicity(spark, docs):
    rows = toxic_corpus(1, 500)
    extra = [(900, ""), (901, None), (902, "?? !!"), (903, "SCOUNDREL vermin! halfwit " * 400)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1), (77_777, 1)], "doc_id long, toxic int")
    df = docs([(i, t) for i, t, _ in rows] + extra, score=F.lit("clash"), _key=F.lit(1))
    model = toxicity.fit_model(df, labels, ~toxicity.held_out("doc_id"))
    out = df.withColumn("score", toxicity.toxicity("text", model)).withColumn("held", toxicity.held_out("doc_id")).collect()
    assert len(out) == len(rows) + 4 and all(0 <= x["score"] <= 1 for x in out)
    label = {i: y for i, _, y in rows}
    held = [(x["score"] >= toxicity.THRESHOLD, label[x["doc_id"]]) for x in out if x["held"] and x["doc_id"] in label]
    hit = sum(p and y for p, y in held)
    assert len(held) > 100 and 2 * hit / (sum(p for p, _ in held) + sum(y for _, y in held)) > 0.9
    score = {x["doc_id"]: x["score"] for x in out}
    assert score[900] == score[901] == score[902] < 0.5 < score[903]
    again = toxicity.fit_model(df, labels, ~toxicity.held_out("doc_id"))
    assert again == model


def test_toxicity_without_examples(spark, docs):
    df, none = docs([(1, "a b c")]), spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit_model(df, none, ~toxicity.held_out("doc_id"))
    assert model is None and df.select(toxicity.toxicity("text", model).alias("s")).first()["s"] == 0.0
    import zlib

    ids = list(range(-50, 200))
    got = docs([(i, "") for i in ids]).select("doc_id", toxicity.held_out("doc_id").alias("h")).collect()
    assert {r["doc_id"]: r["h"] for r in got} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in ids}


def test_jaccard_candidates_in_two_hops(docs):
    rows = corpus(6)
    base = docs(rows).selectExpr("doc_id AS _id", "text AS _text")
    one, two = (jaccard.candidates(base, 4, 85, 64, fan) for fan in (2048, 5))
    stars = lambda df: {tuple(sorted(r)) for r in df.collect()}
    one, two = stars(one), stars(two)
    assert one and {x for p in one for x in p} == {x for p in two for x in p}


@pytest.mark.parametrize("n", [300, 1200])
def test_pairs_of_near_copies_grow_with_their_number(spark, docs, n):
    """One group of near copies: every round tests at most one pair a class, and few are left at the end."""
    counts = {}

    class Counting(Staging):
        def write(self, df, name, by=None):
            out = super().write(df, name, by)
            if name.startswith(("tried", "best", "rest")):
                counts[name] = out.count()
            return out

    base = prose(5, 200, 200)
    rows = [(i, near(base, i, 1 + i % 7)) for i in range(n)]
    out = jaccard.component_ids(docs(rows), Counting(spark, "pairs"))
    got = {r["_id"]: r["component_id"] for r in out.collect()}
    if n < 500:
        assert got == {i: c for i, (_, c) in brute.op10(rows).items()}
    assert all(c <= n for name, c in counts.items() if name.startswith("best"))
    assert counts["tried_first"] <= 20 * n and counts["rest"] <= 4 * n


def test_stages_drop_what_they_staged(spark, staging, docs):
    staging.write(docs([(1, "a")]), "one")
    kept = staging.write(docs([(2, "b")]), "two")
    staging.write_sorted(docs([(3, "c")]), "sorted", ["doc_id"], 2)
    staging.drop("one")
    assert kept.count() == 1 and spark.table(f"{staging.id}_sorted").count() == 1
    staging.close()
    assert not spark.catalog.tableExists(f"{staging.id}_sorted") and not os.path.exists(staging.path)


def test_sets_meet_only_pairs_that_sketches_leave(spark, staging):
    """Of the pairs of a round, those of unlike sketches or sizes move no set."""
    rng = np.random.default_rng(5)
    base = rng.integers(1, 1 << 63, 300, dtype=np.uint64)
    sets = {1: base, 2: np.concatenate([base[:290], rng.integers(1, 1 << 63, 10, dtype=np.uint64)]), 3: rng.integers(1, 1 << 63, 300, dtype=np.uint64), 4: base[:200], 5: rng.integers(1, 1 << 63, 290, dtype=np.uint64)}
    table = spark.createDataFrame([(c, bytearray(np.sort(h).tobytes())) for c, h in sets.items()], "_class long, _set binary")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 3), (3, 5), (1, 5)], "a long, b long")
    assert [tuple(r) for r in jaccard._tested(pairs, table, jaccard._sketched(table, 85), staging, 85).collect()] == [(1, 2)]
    read = lambda name: spark.read.parquet(*[f"{staging.path}/{p}" for p in staging._paths[name]])
    assert sorted((r.a, r.b) for r in read("fitting").collect()) == [(1, 2), (1, 3), (1, 5), (2, 3), (3, 5)]
    assert [(r.a, r.b) for r in read("close").collect()] == [(1, 2)]


def test_bitmap_keeps_every_wanted_hash(spark):
    h = np.array([-1, -(1 << 62), 0, 5, 1 << 40, (1 << 63) - 1], np.int64)
    bitmap = common.marks(spark.createDataFrame([(int(x),) for x in h], "sig long"))
    assert common.is_marked(bitmap, h).all() and not common.is_marked(bitmap, h + 1000).any()
