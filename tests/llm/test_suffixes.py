import hashlib
import random
import re

import numpy as np
import pytest

from netgrid.llm import suffix_dedup
from netgrid.llm.suffix_dedup import LENGTH, layout, remove_repeats, segments, whole_groups
from netgrid.llm.suffix_sort import common, equal_suffixes, words


def expected(rows):
    """Every string of every text in order, in a set."""
    seen, out = set(), []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - LENGTH + 1):
            if b[k : k + LENGTH] in seen:
                gone[k : k + LENGTH] = b"\1" * LENGTH
            seen.add(b[k : k + LENGTH])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def removed(docs):
    return sorted((tuple(r) for r in remove_repeats(docs).drop("kept").collect()), key=str)


def texts(seed, n=60):
    rng = random.Random(seed)
    word = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(word) for _ in range(k))
    shared = [say(60) for _ in range(3)]
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            t = say(rng.randint(0, 80))
        elif kind == 1:
            t = say(20) + " " + rng.choice(shared) + " " + say(20)  # a passage
        elif kind == 2:
            t = rng.choice(out)[1] if out else ""  # a copy
        elif kind == 3:
            w = (out[-1][1] if out else say(50)).split(" ")
            w[rng.randrange(len(w))] = "new"
            t = " ".join(w)  # a near copy
        elif kind == 4:
            t = "ab" * rng.randint(0, 400)  # repeats itself
        else:
            t = say(5) + shared[0][:150] + say(3) + shared[0][40:170]
        out.append((i, t))
    return out


@pytest.mark.parametrize("large", [suffix_dedup.LARGE, 3])
def test_every_string(spark, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)  # 3: anchors and strings as those of large groups
    rows = texts(1)
    assert removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == expected(rows)


def test_odd_rows(spark, odd, none):
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert removed(odd) == expected(rows)
    assert remove_repeats(none).count() == 0


def test_repeated_ids(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(None, text), (5, text), (5, text), (5, "x" + text), (6, None), (6, text[:99]), (6, text[:100])]
    got = removed(spark.createDataFrame(rows, "doc_id long, text string"))
    sizes = sorted((r[1], r[2]) for r in got)
    # the row without an id comes first and stays whole; of the longer one only its first byte is new
    assert sizes == [(0, 0), (99, 0), (100, 100), (400, 0), (400, 400), (400, 400), (401, 400)]


def test_long_text_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    rng = random.Random(9)
    part = "".join(rng.choice("abcdefghij ") for _ in range(5000))
    rows = [(1, part * 3), (2, part[100:4000] + "z" + part[:2500]), (3, "".join(rng.choice("kl") for _ in range(3000)))]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_segments_hold_every_string_once():
    import pyarrow as pa

    joined, offsets = layout(pa.array([t for _, t in texts(2)]))
    got = set()
    for text, start, count, *_ in segments(joined, offsets):
        for t, s, c in zip(text.tolist(), start.tolist(), count.tolist()):
            for k in range(s, s + c):
                assert (t, k) not in got
                got.add((t, k))
    size = np.diff(offsets)
    assert got == {(t, k) for t in range(len(size)) for k in range(size[t] - LENGTH + 1)}


@pytest.mark.parametrize("length,shallow", [(100, 16), (20, 8), (8, 8), (13, 16)])
def test_sorting_finds_what_is_equal(length, shallow):
    rng = np.random.default_rng(length)
    for _ in range(20):
        n = int(rng.integers(length, 3000))
        data = rng.integers(97, 97 + int(rng.integers(1, 4)), n).astype(np.uint8)
        data[: n // 2] = np.resize(data[: int(rng.integers(1, 200))], n // 2)  # long repeats
        starts = np.arange(n - length + 1)
        group = np.sort(rng.integers(0, 3, len(starts)))
        which, leaf = equal_suffixes(data, starts, group, length, shallow)
        want = {}
        for k in starts.tolist():
            want.setdefault((int(group[k]), data[k : k + length].tobytes()), []).append(k)
        want = sorted(sorted(v) for v in want.values() if len(v) > 1)
        found = {}
        for k, x in zip(which.tolist(), leaf.tolist()):
            found.setdefault(x, []).append(k)
        assert sorted(sorted(v) for v in found.values()) == want


def test_common_bytes():
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(0, 2, 400), np.zeros(8)]).astype(np.uint8)
    at = words(data)
    a, b = rng.integers(0, 300, 500), rng.integers(0, 300, 500)
    got = common(at, a, b, 0, 60)
    for x, y, g in zip(a, b, got):
        d = np.flatnonzero(data[x : x + 60] != data[y : y + 60])
        assert g == (d[0] if len(d) else 60)


def test_groups_are_cut_between_keys():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    key = np.sort(rng.integers(0, 30, 400))
    table = pa.table({"h": key, "x": np.arange(400)})
    got = list(whole_groups(table.to_batches(max_chunksize=7), "h"))
    assert pa.Table.from_batches(got).equals(table)
    ends = [(b.column(0)[0].as_py(), b.column(0)[-1].as_py()) for b in got]
    assert all(x[1] != y[0] for x, y in zip(ends, ends[1:]))
