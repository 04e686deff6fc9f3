import bisect
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netgrid.llm.elias_fano import EliasFano, token_id_files, write_ids
from netgrid.llm.packing import best_fit, pack_documents, solve
from netgrid.llm.shards import range_bounds, shard_of
from netgrid.llm.tokens import Encoder
from netgrid.plans.storage import fresh_path

KINDS = (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False))
CODERS = {f: Encoder(f, lead) for f, lead in KINDS}


LIBRARY = {f: Tokenizer.from_file(public_tokenizers.path(f)) for f, _ in KINDS}  # untouched


@pytest.mark.parametrize("file", [f for f, _ in KINDS])
@settings(max_examples=150, deadline=None)
@given(t=st.text(alphabet=st.sampled_from("abEé ß,.!'\n\t\r   \x00\x1c1日́İΣs"), max_size=40))
def test_equals_library(file, t):
    got = np.frombuffer(CODERS[file].encode([t])[0], "<u4").tolist()
    assert got == LIBRARY[file].encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("file", [f for f, _ in KINDS])
def test_equals_library_on_random_strings(file):
    rng = random.Random(12)
    parts = ["a", "B", "é", "İ", "Σ", "ß", "ŉ", "ǅ", "ﬁ", "́", "日", "1", " ", " ", "  ", "\n", "\t", "\r", "\x00", "\x1c", "\u00a0", "\u3000", ".", ",", "!", "'", "'s", "-", "_", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "word", "don't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(20_000)]
    want = [e.ids for e in LIBRARY[file].encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for x in CODERS[file].encode(texts)]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


@pytest.mark.parametrize("case", ["even", "clustered", "repeated", "wide"])
def test_shard_bounds_in_few_jobs(spark, case):
    sc = spark.sparkContext
    ids = {
        "even": spark.range(20_000).selectExpr("id as k"),
        "clustered": spark.range(20_000).selectExpr("if(id % 2 = 0, id, 4000000000000000000 + id * 3) as k"),
        "repeated": spark.range(20_000).selectExpr("if(id % 3 = 0, 77, id * 5) as k"),
        "wide": spark.range(20_000).selectExpr("if(id % 2 = 0, 9223372036854775807 - id, -9223372036854775808 + id) as k"),
    }[case].cache()
    ids.count()
    sc.setJobGroup("bounds-" + case, "bounds")
    bounds, sums = range_bounds(ids, "k", F.lit(1), 10.0)
    jobs = len(sc.statusTracker().getJobIdsForGroup("bounds-" + case))
    sc.setJobGroup("other", "other")
    assert jobs < 40 and bounds == sorted(bounds) and len(sums) == len(bounds) + 1
    rows = ids.select("k", shard_of(F.col("k"), bounds).alias("s")).collect()
    assert all(r.s == bisect.bisect_right(bounds, r.k) for r in rows)
    size = Counter(r.s for r in rows)
    assert [size[i] for i in range(len(sums))] == sums
    assert len(sums) > 1000 and max(n for i, n in size.items() if i != bisect.bisect_right(bounds, 77) or case != "repeated") <= 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano(values):
    v = sorted(values)
    e = EliasFano.encode(np.array(v, dtype=np.uint64))
    head, data = e.dump()
    e = EliasFano.load(head, data)
    assert e.select(0, len(v)).tolist() == v
    for i in range(0, len(v), 97):
        assert e.select(i).tolist() == [v[i]]
    assert len(data) <= len(v) * 3 + 64


def test_files_round_trip(spark, odd, none):
    got, manifest = token_id_files(odd, "word_bpe_49k.json", 2, shard_chars=200)
    rows = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect())
    want, at = [], 0
    for r in sorted((r for r in odd.collect() if r.doc_id is not None), key=lambda r: (r.doc_id, r.text or "")):
        ids = LIBRARY["word_bpe_49k.json"].encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert rows == want
    assert manifest.count() > 1
    assert token_id_files(none, "word_bpe_49k.json", 2)[0].count() == 0


def test_files_are_equal_again(spark, odd):
    from netgrid.llm.files import opened

    def whole():
        m = write_ids(odd, fresh_path(spark, "ids"), "byte_bpe_50k.json", 2, shard_chars=300)
        return [opened(r.uri).read() for r in m.orderBy("shard").collect()]

    assert whole() == whole()


def test_packing(spark, odd, none):
    got = pack_documents(odd, "byte_bpe_50k.json", 2, capacity=64, token_ids=True).collect()
    want = Counter(tuple(LIBRARY["byte_bpe_50k.json"].encode(r.text or "", add_special_tokens=False).ids + [2]) for r in odd.collect())
    docs, places = {}, {}
    for r in got:
        assert len(r.ids) == r.length <= 64 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        docs.setdefault((r.doc_id, r.piece), []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(k) * n for k, n in want.items())
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 64
    assert all(r.length == 64 for r in got if r.piece)
    assert pack_documents(none, "byte_bpe_50k.json", 2).count() == 0


def test_solver_places_all():
    rng = np.random.default_rng(1)
    h = Counter(int(x) for x in rng.integers(1, 1025, 20000))
    for groups in (solve(h, 1024, rounds=40), best_fit(h, 1024)):
        placed = Counter()
        for n, held in groups:
            assert sum(held) <= 1024
            for x in held:
                placed[x] += n
        assert placed == h
        assert sum(n for n, _ in groups) <= 1.02 * sum(k * n for k, n in h.items()) / 1024 + 1


def least_sequences(lengths, capacity):
    """The exact optimum of a few pieces, by placing one after another in every way."""
    best = [len(lengths)]

    def place(i, free):
        if len(free) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(free)
            return
        for k in sorted(set(free)):
            if k >= lengths[i]:
                at = free.index(k)
                place(i + 1, [*free[:at], k - lengths[i], *free[at + 1 :]])
        place(i + 1, [*free, capacity - lengths[i]])

    place(0, [])
    return best[0]


def test_few_pieces_against_the_optimum():
    rng = np.random.default_rng(4)
    extra = 0
    for _ in range(40):
        lengths = sorted((int(x) for x in rng.integers(2, 25, 9)), reverse=True)
        got = sum(n for n, _ in solve(Counter(lengths), 30, rounds=60))
        extra += got - least_sequences(lengths, 30)
        assert got <= least_sequences(lengths, 30) + 1
    assert extra <= 4
