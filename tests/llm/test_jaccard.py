import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from netgrid.llm import jaccard
from netgrid.llm import signature_tree as tree
from netgrid.llm.jaccard import Prefix, id_filter, jaccard_join, least_rare, one_of_each


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            union = len(sets[a] | sets[b])
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * union:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(2, 60))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((i, " ".join(w).title() if i % 7 == 0 else " ".join(w)))
    return out


def test_equals_brute_force(spark):
    for k, num, den in ((3, 9, 10), (5, 8, 10), (2, 5, 10)):
        rows = texts(160, k)
        got, _ = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), k=k, num=num, den=den)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, k, num, den)


def test_dense_group(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got, _ = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=9, den=10)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, 3, 9, 10)


def test_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(odd, k=3, num=9, den=10)[0].collect()}
    assert {(2, 0, 2), (3, 0, 3), (4, 0, 4), (1, 12, 1), (6, 12, 1)} <= got
    assert jaccard_join(none)[0].count() == 0
    left = one_of_each(odd)
    assert left.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2, 3, 4, 5, 7, 8]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=2, max_size=60), st.integers(5, 9))
def test_tree_misses_nothing(sets, num):
    tokens = [np.unique(np.array([x * 0x9E3779B97F4A7C15 % 2**64 for x in s], dtype=np.uint64)) for s in sets]
    sizes = np.array([len(t) for t in tokens])
    maps = [np.frombuffer(tree.bitmap(t), dtype=np.uint64) for t in tokens]
    a, b, _ = tree.candidates(sizes, maps, num, 10)
    found = {frozenset(x) for x in zip(a.tolist(), b.tolist())}
    for i in range(len(sets)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                assert frozenset((i, j)) in found


def hashes(rng, n):
    return np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))


def test_prefixes_of_linked_sets_meet():
    """Whichever hashes are common: none of the pair's, the shared ones, the unshared ones, or a random part."""
    rng = np.random.default_rng(2)
    for num in (8, 9):
        for n in (3, 12, 40, 150, 400, 3000):
            for case in range(24):
                off = max(0, n - -(-num * 2 * n // (num + 10)))  # unshared hashes of each, at most
                base, x, y = hashes(rng, n - off), hashes(rng, off), hashes(rng, off)
                a, b = np.union1d(base, x), np.union1d(base, y)
                shared = len(np.intersect1d(a, b))
                assert 10 * shared >= num * (len(a) + len(b) - shared)
                common = [a[:0], base, np.union1d(x, y), np.union1d(a, b)[rng.random(len(np.union1d(a, b))) < rng.random()]][case % 4]
                choose = Prefix(np.union1d(common, hashes(rng, 50)), num, 10)
                assert len(np.intersect1d(choose(a), choose(b)))


def test_least_rare():
    need = least_rare(9, 10)
    assert need[16] == 17 and need[15] > 16 and (np.diff(need[16:]) >= 0).all() and need[99] < 60
    assert least_rare(8, 10)[24] == 25


def test_pair_among_many_that_share_a_text(spark):
    """400 texts share 80 words, which are common then; the pair differs from them and hardly from one another."""
    rng = random.Random(8)
    shared = [f"c{i}" for i in range(80)]
    rows = [(i, " ".join([*shared, *(f"r{i}x{j}" for j in range(40))])) for i in range(400)]
    own = [f"p{j}" for j in range(60)]
    rows += [(900, " ".join([*shared, *own])), (901, " ".join([*shared, *own[:-4], "q1", "q2"]))]
    rng.shuffle(rows)
    got, links = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=9, den=10)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, 3, 9, 10)
    assert [(r.a, r.b) for r in links.collect()] == [(900, 901)]


def test_filter_holds_every_id(spark):
    got = id_filter(spark.range(0, 5000, 7), "id")
    from pyspark.sql import functions as F

    from netgrid.llm.jaccard import FILTER

    slots = np.array([r[0] for r in spark.range(0, 5000, 7).select(F.pmod(F.xxhash64("id"), F.lit(FILTER))).collect()])
    assert (got[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1)).all()
    assert int(np.bitwise_count(got).sum()) == len(np.unique(slots))


def test_repeated_ids(spark):
    """A repeated id is one node: its texts join what each of them links to."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (5, b), (2, a + " z"), (9, b), (7, "other words here")]
    got = {(r.doc_id, r.component_id) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=9, den=10)[0].collect()}
    assert got == {(5, 2), (2, 2), (9, 2), (7, 7)}


def test_one_of_each_with_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, a), (5, b), (7, b + " z"), (9, "alone here with words"), (None, a), (6, None), (6, None)]
    got = sorted((r.doc_id or 0, r.text or "") for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(5, a), (5, b), (9, "alone here with words"), (0, a), (6, "")])


def test_large_groups_are_dealt_once(spark, monkeypatch):
    """Groups of many blocks give the links of brute force, and no more rows than the groups have members."""
    monkeypatch.setattr(jaccard, "BLOCK", 24)
    monkeypatch.setattr(jaccard, "SMALL", 16)
    monkeypatch.setattr(jaccard, "HELD", 2)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(70)]
    rows = []
    for i in range(260):
        w = list(base[: 70 - i % 9])
        for _ in range(rng.choice((0, 2, 4, 5, 6))):
            w[rng.randrange(len(w))] = f"x{i}-{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    tables, dealt = [], []
    keep, walk = jaccard.materialise, jaccard._walk
    monkeypatch.setattr(jaccard, "materialise", lambda df, label: tables.append((label, t := keep(df, label))) or t)
    monkeypatch.setattr(jaccard, "_walk", lambda cells, *a: dealt.append(cells) or walk(cells, *a))
    got, _ = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=8, den=10)
    want = brute(rows, 3, 8, 10)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want and len({c for _, c in want.values()}) > 20
    groups, blocks = ([t for label, t in tables if label == name] for name in ("groups", "blocks"))
    assert len(groups) == len(dealt) == 3 and all(c.count() <= g.count() for c, g in zip(dealt, groups))
    assert blocks and all(b.groupBy("token").count().selectExpr("max(count)").first()[0] > 8 for b in blocks)
    assert all(b.selectExpr("sum(size(members))").first()[0] <= g.count() for b, g in zip(blocks, groups[1:]))


def test_groups_of_a_round_are_picked_once(spark, monkeypatch):
    """What a round reads more than once is a table: no join that picks its groups is made again."""
    monkeypatch.setattr(jaccard, "BLOCK", 24)
    monkeypatch.setattr(jaccard, "SMALL", 16)
    rng = random.Random(4)
    rows = []
    for i in range(120):
        w = [f"b{j}" for j in range(60 - i % 7)]
        for _ in range(rng.choice((0, 2, 4, 6))):
            w[rng.randrange(len(w))] = f"x{i}-{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    read = []
    for name in ("_bits_of", "_whole", "_placed"):
        own = getattr(jaccard, name)
        monkeypatch.setattr(jaccard, name, lambda df, *a, own=own, name=name: read.append((name, df)) or own(df, *a))
    got, _ = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=8, den=10)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, 3, 8, 10)
    assert {name for name, _ in read} == {"_bits_of", "_whole", "_placed"}
    assert not [name for name, df in read if "Join" in df._jdf.queryExecution().optimizedPlan().toString()]
