import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from netgrid.llm import merkle
from netgrid.llm.merkle import ARRAY, SPAN, Ranks, merkle_manifest, pack, unpack

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, tamper=False):
    out = ""
    for k, v in enumerate(row):
        if k == 4 and tamper and v is not None:
            v = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in v)
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(out)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    for nodes in levels[:-1]:
        lo = i - i % 16
        yield "".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + 16])
        i //= 16


def expected(rows):
    """Plain recursion over lists, straight from the definition."""
    by = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        by[r[1]].append(((r[0] is not None, r[0] or 0), leaf(r), leaf(r, hit), r[0]))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(by[s], key=lambda x: x[:2])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, own, start, doc_id) in enumerate(sorted(by[s], key=lambda x: x[:2])):
            steps = [*siblings(trees[s], i), *siblings(top, k)]
            node = start
            for left, right in steps:
                node = sha(left + node + right)
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), node, node == top[-1][0]))
    return sorted(out, key=str)


def check(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    assert sorted((tuple(r) for r in merkle_manifest(docs).collect()), key=str) == expected(rows)


def test_ranks_count_the_rows_below():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.001, 0.04, 0.5, 1.0):
        counts = (rng.random(SPAN) < share).astype(np.int64)
        counts[rng.integers(0, SPAN, 5)] += rng.integers(0, 3, 5)
        bits, extra = pack(counts)
        low = np.flatnonzero(counts)
        assert unpack(bits).tolist() == low.tolist() and (len(bits) == SPAN // 8) == (len(low) >= ARRAY)
        below, tied = Ranks(bits, extra)(low)
        assert below.tolist() == (np.cumsum(counts) - counts)[low].tolist()
        repeated = np.where(counts > 1, counts, 0)
        assert tied.tolist() == np.where(counts > 1, np.cumsum(repeated) - repeated, -1)[low].tolist()


def test_trees_of_many_sizes(spark):
    """Sources of 1, 16, 17, 256, 257 and more leaves, ids far apart and negative, more than 16 sources."""
    rng = random.Random(5)
    rows = []
    for k, n in enumerate([1, 2, 15, 16, 17, 255, 256, 257, 700, *[1] * 12]):
        for i in range(n):
            rows.append(((i - 50) * rng.choice([1, 7, 5000]) * 1000 + k + i, f"s{k}" if k else None, "en", i, rng.choice(["Some TEXT", "text", "Ä é", ""])))
    rng.shuffle(rows)
    check(spark, list({r[0]: r for r in rows}.values()))


@pytest.mark.parametrize("many", [merkle.MANY, 4])
def test_nulls_repeated_ids_and_repeated_rows(spark, monkeypatch, many):
    monkeypatch.setattr(merkle, "MANY", many)  # rows of one id over several tasks
    rows = [(i, "a", "en", 3, f"T{i}") for i in range(40)]
    rows += [(7, "a", "en", 3, f"other {i}") for i in range(30)] + [(7, "a", "en", 3, "same")] * 20
    rows += [(None, "a", None, None, None), (None, "a", "de", 1, "X"), (None, "b", "de", 1, "X"), (3, None, None, None, ""), (3, None, None, None, None)]
    check(spark, rows)


def test_odd_rows_and_empty_table(spark, odd, none):
    rows = [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in odd.collect()]
    assert sorted((tuple(r) for r in merkle_manifest(odd).collect()), key=str) == expected(rows)
    got = merkle_manifest(none)
    assert got.count() == 0 and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_one_row(spark):
    (r,) = merkle_manifest(spark.createDataFrame([(4, "s", "en", 1, "a")], SCHEMA)).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == sha("") and r.verified
