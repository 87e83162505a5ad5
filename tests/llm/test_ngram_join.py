import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, awkward_rows, empty
from vigil.llm import ngram_join as J
from vigil.llm.common import Stored
from vigil.llm.shingles import shingle_sets

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute_set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """component by id, from all pairs; rows without an id are left out"""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(brute_set(t))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    flat = [(i, s) for i in ids for s in sets[i] if s]
    column = {x: k for k, x in enumerate(sorted(set().union(*[s for _, s in flat])))} if flat else {}
    held = np.zeros((len(flat), len(column)), np.float32)
    for k, (_, s) in enumerate(flat):
        held[k, [column[x] for x in s]] = 1
    size = held.sum(axis=1)
    for k in range(len(flat)):
        both = held[k + 1:] @ held[k]
        for m in np.flatnonzero(100 * both >= 80 * (size[k] + size[k + 1:] - both)).tolist():
            x, y = sorted((find(flat[k][0]), find(flat[k + 1 + m][0])))
            root[y] = x
    return {i: find(i) for i in ids}


def check(spark, rows, df):
    got = J.link_documents(df).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(want.items())
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert sorted((r.doc_id or -1, r.n_shingles) for r in got) == sorted((i or -1, len(brute_set(t))) for i, t in rows)


def test_awkward_rows(spark):
    check(spark, [(r[0], r[1]) for r in awkward_rows()], awkward(spark))


def test_empty_table(spark):
    assert J.link_documents(empty(spark)).collect() == []


def test_groups_at_the_threshold_and_an_id_with_two_texts(spark):
    rng = random.Random(5)
    stock = [f"w{i}" for i in range(300)]
    passage = [rng.choice(stock) for _ in range(40)]
    rows = [(0, "p q r s t u v"), (0, " ".join(passage))]  # one id, two texts
    for g in range(6):
        base = [rng.choice(stock) for _ in range(rng.randint(20, 120))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(stock)
            rows.append((len(rows), " ".join((passage if g % 2 else []) + copy)))
    rows.append((500, "p q r s t u v"))
    rng.shuffle(rows)
    check(spark, rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def spread(rng, n, words=300, most=8):
    """near copies of one text, 1 to ``most`` of its words changed: some pairs link, some do not"""
    stock = [f"w{i}" for i in range(4000)]
    base = [rng.choice(stock) for _ in range(words)]
    rows = []
    for i in range(n):
        copy = list(base)
        for at in rng.sample(range(words), rng.randint(1, most)):
            copy[at] = rng.choice(stock)
        rows.append((i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("n,run", [(400, 1 << 14), (400, 60), (2000, 700)])
def test_a_spread_group_verifies_few_pairs(spark, monkeypatch, n, run):
    monkeypatch.setattr(J, "RUN", run)
    rng = random.Random(n)
    rows = spread(rng, n) + [(10_000 + i, t) for i, t in spread(rng, 30, most=40)]
    offered, checked = [], []
    best, exact = J.best_offers, J.exact_check
    monkeypatch.setattr(J, "best_offers", lambda o, m: offered.append((m, o.select("x", "y").distinct().count())) or best(o, m))
    monkeypatch.setattr(J, "exact_check", lambda p, *a: checked.append(p.count()) or exact(p, *a))
    check(spark, rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert offered[0][0] == J.OFFERS and sum(checked[1:]) <= 5 * max(offered[0][1], 1)


@pytest.mark.parametrize("partners", [1, 3])
def test_components_are_offered_to_their_nearest_first(spark, monkeypatch, partners):
    """without stars every text is a component; the offers grow with the texts, not with their square"""
    monkeypatch.setattr(J, "PARTNERS", partners)
    monkeypatch.setattr(J, "star_pairs", lambda sigs, num, den: sigs.where("false").select(F.col("class").alias("a"), F.col("class").alias("b")))
    rows = spread(random.Random(7), 300) + [(1000 + i, t) for i, t in spread(random.Random(8), 20, most=30)]
    offered = []
    tiles = J.tile_offers
    monkeypatch.setattr(J, "tile_offers", lambda *a: offered.append(tiles(*a).count()) or tiles(*a))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(spark, rows, df)
    tasks = 4  # shuffle partitions of the tests
    assert len(offered) >= 2 and max(offered) <= tasks * (partners + 1) * len(rows)


def test_a_component_that_loses_a_pair_shows_it():
    rng = np.random.default_rng(4)
    for _ in range(30):
        x = rng.integers(0, 30, 400)
        made = (x, x + rng.integers(1, 20, 400), rng.integers(0, 9, 400), np.arange(400), np.arange(400) + 400)
        every, kept = (set(zip(o[0].tolist(), o[1].tolist())) for o in (J._best_offers([made], 5), J._best_offers([made], 5, 3)))
        k = {c: sum(c in p for p in kept) for p in every for c in p}
        assert kept < every and all(k[a] >= 3 and k[b] >= 3 for a, b in every - kept)


def test_where_the_offers_do_not_link_all_pairs_are_tried(spark, monkeypatch):
    """two components that are offered one pair, which is taken as not linking: the second pass offers all"""
    rng = random.Random(12)
    base = spread(rng, 1, words=300, most=1)[0][1].split()
    other = [f"other{k}" if k in (40, 120, 200, 280) else w for k, w in enumerate(base)]
    texts = []
    for group in (base, other):
        for k in range(6):
            copy = list(group)
            copy[7 + 20 * k] = f"own{len(texts)}"
            texts.append(" ".join(copy))
    sets = list(shingle_sets(texts))
    ids = [J.class_id(s) for s in sets]
    parts = spark.createDataFrame([(c, min(ids[k // 6 * 6:k // 6 * 6 + 6])) for k, c in enumerate(ids)], "node long, component long")
    stored = spark.createDataFrame([(c, s.tobytes()) for c, s in zip(ids, sets)], "class long, shingles binary")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sigs = Stored(J.signatures(docs, np.zeros(1 << J.COUNT_BITS, np.uint8), 80, 100), "test-signatures").df
    monkeypatch.setattr(J, "OFFERS", 1)
    seen, calls = [], []
    best, exact = J.best_offers, J.exact_check
    monkeypatch.setattr(J, "best_offers", lambda o, m: seen.append(m) or best(o, m))
    monkeypatch.setattr(J, "exact_check", lambda p, *a: calls.append(p.count()) or exact(p.where("false") if len(calls) == 1 else p, *a))
    out = J.tile_components(sigs, parts, lambda pairs: Stored(stored, "test-sets"), 80, 100).collect()
    assert seen == [1, None] and calls == [1, 0, 36]
    assert {r.node for r in out} == set(ids) and {r.component for r in out} == {min(ids)}


@pytest.mark.parametrize("run", [3, 10])
def test_long_runs_cut_into_blocks_lose_no_link(spark, monkeypatch, run):
    monkeypatch.setattr(J, "RUN", run)
    rng = random.Random(run)
    rows = spread(rng, 60, words=80, most=6)
    other = [(1000 + i, t + " " + " ".join(f"x{i}y{j}" for j in range(rng.randint(0, 30)))) for i, (_, t) in enumerate(spread(rng, 40, words=70, most=3))]
    rows += other
    check(spark, rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_pairs_of_tiles_equal_all_pairs():
    import pyarrow as pa
    rng = np.random.default_rng(3)
    for turn in range(60):
        parts, want, at = [], [], 0
        for number in range(int(rng.integers(1, 5))):
            m = int(rng.integers(1, 90))
            n = np.sort(rng.integers(1, 60, m))
            place = (rng.random(m) * np.array([J.prefix_lengths(int(x), 80, 100)[0] for x in n])).astype(np.int32)
            part = rng.integers(0, 3 if turn % 2 else 40, m)
            side = np.full(m, -1) if turn % 3 else rng.integers(0, 2, m)
            parts.append((np.full(m, number // 2), np.full(m, number), side, n, place, part))
            for i in range(m):
                for j in range(i + 1, m):
                    most = 1 + min(n[i] - place[i] - 1, n[j] - place[j] - 1)
                    if part[i] != part[j] and (side[i] == -1 or side[i] != side[j]) and 100 * n[i] >= 80 * n[j] and place[i] < J.prefix_lengths(int(n[i]), 80, 100)[1] \
                            and most >= J.least_overlap(n[i], n[j], 80, 100):
                        want.append((at + i, at + j))
            at += m
        shingle, tile, side, n, place, part = (np.concatenate([x[k] for x in parts]) for k in range(6))
        table = pa.table({"shingle": shingle, "tile": tile, "side": side.astype(np.int32), "n": n, "place": place, "class": np.arange(at), "part": part})
        got = sorted(p for i, j in J._pairs(table, 80, 100) for p in zip(i.tolist(), j.tolist()))
        assert got == sorted(want)


def test_bounds_of_many_pairs_equal_those_of_each():
    import pyarrow as pa
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 3000, int(rng.integers(1, 700))).astype(np.uint64)) for _ in range(40)]
    maps = [J.bitmap(s) for s in sets]
    size = np.array([len(s) for s in sets])
    i, j = rng.integers(0, 40, 500), rng.integers(0, 40, 500)
    got = J.Bitmaps(pa.chunked_array([pa.array(maps[:15], pa.binary()), pa.array(maps[15:], pa.binary())])).overlap_bounds(i, j, size)
    assert got.tolist() == [J.overlap_bound(maps[a], len(sets[a]), maps[b], len(sets[b])) for a, b in zip(i, j)]


def test_the_bitmap_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, rng.integers(0, len(a) + 1)), rng.integers(0, 1 << 62, rng.integers(1, 900)).astype(np.uint64)]))
        o = len(np.intersect1d(a, b))
        assert J.sorted_overlap(a, b) == o
        assert J.overlap_bound(J.bitmap(a), len(a), J.bitmap(b), len(b)) >= o


@pytest.mark.parametrize("n", [1, 2, 9, 10, 100, 1234])
def test_prefixes_hold_a_common_shingle(n):
    full, shorter = J.prefix_lengths(n, 80, 100)
    assert full == n - J.least_overlap(n, n * 80 // 100 + (n * 80 % 100 > 0), 80, 100) + 1 or full >= n - -(-80 * n // 100) + 1
    assert 1 <= shorter <= full <= n


def test_shingles_equal_plain_python():
    texts = [r[1] for r in awkward_rows()]
    got, want = list(shingle_sets(texts)), [brute_set(t) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    for a, x in zip(got, want):
        for b, y in zip(got, want):
            assert len(np.intersect1d(a, b)) == len(x & y)
