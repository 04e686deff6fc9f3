import hashlib
import random

import numpy as np

from netgrid.llm import decontamination
from netgrid.llm.decontamination import Space, Vocabulary, bit_masks, common, drop_leaks, find_leaks, latent_terms, term_table
from netgrid.llm.hashing import one_word_hashes, word_hashes
from netgrid.llm.syncmers import compare_with_edits, document_fingerprints, edited, fingerprint, likeness


def test_word_hashes_do_not_depend_on_place():
    h, owner = word_hashes([b"a bb  ccc\n", b"", b"bb a"])
    assert owner.tolist() == [0, 0, 0, 2, 2] and h[0] == h[4] and h[1] == h[3]
    assert one_word_hashes([b"ccc", b"a"]).tolist() == [h[2], h[0]]


def test_fingerprints(spark, odd, none):
    rng = random.Random(2)
    a = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    b = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    assert likeness(fingerprint(a), fingerprint(a)) == 1.0
    assert likeness(fingerprint(a), fingerprint(b)) < 0.1
    assert 0.15 < likeness(fingerprint(a), fingerprint(edited(a, b))) < 0.6
    assert likeness(fingerprint(a), fingerprint(a[:2000] + "X" + a[2000:])) > 0.8
    assert fingerprint("") == "" and fingerprint("ab") != fingerprint("ba") and fingerprint("a" * 500)
    rows = {r.doc_id: r for r in document_fingerprints(odd).collect()}
    assert rows[1].fingerprint == rows[6].fingerprint and rows[2].n_chars == 0
    assert compare_with_edits(none).count() == 0


def test_edits_follow_the_ids(spark, odd):
    for size in (50, 1e9):
        got = sorted(compare_with_edits(odd, shard_chars=size).collect(), key=lambda r: (r.doc_id, r.n_chars))
        src = sorted(((r.doc_id, r.text or "") for r in odd.collect() if r.doc_id is not None), key=lambda r: (r[0], r[1]))
        assert [r.doc_id for r in got] == [i for i, _ in src]
        for k, (r, (_, t)) in enumerate(zip(got, src)):
            e = edited(t, src[(k + 1) % len(src)][1])
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
            assert r.fingerprint == fingerprint(t) and r.edited_fingerprint == fingerprint(e)


def test_single_document(spark):
    (r,) = compare_with_edits(spark.createDataFrame([(4, "abcdef")], "doc_id long, text string")).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = random.Random(8)
    import numpy as np

    for _ in range(200):
        a, b = [[rng.randrange(5) for _ in range(rng.randint(1, 30))] for _ in range(2)]
        assert common(bit_masks(np.array(a)), len(a), b) == lcs(a, b)


def test_leaks(spark, odd, none):
    rng = random.Random(1)
    words = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [say(rng.randint(12, 60)) for _ in range(12)]
    docs, truth = [], set()
    for d in range(120):
        w = say(200)
        if d % 3 == 0:
            k = d // 3 % 12
            own = list(items[k])
            if d % 2:  # a paraphrase: every sixth word is another one
                own = [x if j % 6 else rng.choice(words) for j, x in enumerate(own)]
            at = rng.randrange(200)
            w[at:at] = own
            truth.add((d, k))
        docs.append((d, " ".join(w).capitalize() + "."))
    bench = spark.createDataFrame([(i, " ".join(x).upper() + "?") for i, x in enumerate(items)] + [(90, None), (91, " ")], "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in find_leaks(table, bench).collect()} == truth
    assert drop_leaks(table, bench).count() == 80
    assert find_leaks(odd, bench).count() == 0 and find_leaks(none, bench).count() == 0
    assert find_leaks(table, bench.limit(0)).count() == 0
    assert drop_leaks(odd, bench).columns == odd.columns and drop_leaks(odd, bench).count() == odd.count()


def test_leaks_do_not_depend_on_the_corpus_size(spark):
    item = [f"known{i}" for i in range(18)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for n in (100, 10_000):
        docs = [(0, " ".join([f"x{j}" for j in range(7)] + item + [f"y{j}" for j in range(7)]))]
        # each word of the item is in one passage of twenty, at every size
        docs += [(d, " ".join([*item[d % 20 : d % 20 + 1], *(f"w{d}n{j}" for j in range(30))])) for d in range(1, n)]
        assert [r.doc_id for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()] == [0]


def test_latent_space_keeps_96_dimensions(spark):
    vocabulary = Vocabulary(np.unique(one_word_hashes([f"t{i}".encode() for i in range(120)])))
    docs = spark.createDataFrame([(i, " ".join(f"t{(i * 7 + j * j) % 120}" for j in range(20))) for i in range(400)], "doc_id long, text string")
    terms = latent_terms(term_table(docs, vocabulary), Space(vocabulary, np.ones(120), 7.0))
    assert terms.shape == (120, 96) and np.allclose(terms.T @ terms, np.eye(96), atol=1e-3)


def test_words_are_written_as_terms(spark, odd):
    vocabulary = Vocabulary(np.unique(one_word_hashes([b"cat", b"mat", b"worten"])))
    rows = odd.where("doc_id is not null and text is not null")
    for r, (text,) in zip(term_table(rows, vocabulary).collect(), rows.select("text").collect(), strict=True):
        words = word_hashes([text.lower().replace(".", " ").replace(",", " ").replace("!", " ").encode()])[0]
        got = np.frombuffer(r.terms, "<i4")
        if r.doc_id in (1, 5, 6):
            assert (got == vocabulary.lookup(words)).all() and (got >= 0).any()
        assert r.doc_id in (1, 5, 6) or (got == -1).all()


def test_long_texts_that_share_a_passage():
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n))
    shared = say(60)
    one, two = (f"{say(10_000)} {shared} {say(10_000)}" for _ in range(2))
    assert len(fingerprint(one)) // 16 > 15_000
    assert 20 / 40_000 < likeness(fingerprint(one), fingerprint(two)) < 100 / 40_000
    assert likeness(fingerprint("ab" * 500), fingerprint("ab" * 500 + "c")) > 0.9  # repeated anchors count each


def test_words_of_items_in_regions():
    """Counted for all regions at once as one by one."""
    rng = np.random.default_rng(5)
    owner = np.repeat(np.arange(6), 50)
    term = rng.integers(-1, 30, len(owner))
    has = np.zeros((4, 31), bool)
    has[:, :30] = rng.random((4, 30)) < 0.4
    last = decontamination.before(term, owner)
    for i, (t, o) in enumerate(zip(term, owner)):
        places = [j for j in range(i) if term[j] == t and owner[j] == o]
        assert last[i] == (places[-1] if places else -1)
    a = rng.integers(0, 45, 200) + 50 * rng.integers(0, 6, 200)
    b = np.minimum(a + rng.integers(1, 30, 200), (a // 50 + 1) * 50)
    k = rng.integers(0, 4, 200)
    want = [len({int(t) for t in term[x:z] if t >= 0 and has[i, t]}) for i, x, z in zip(k, a, b)]
    assert decontamination.words_in(has, k, term, last, a, b, size=64).tolist() == want
    assert decontamination.words_in(has, k[:0], term, last, a[:0], b[:0]).tolist() == []
    assert [decontamination.enough(n) for n in (1, 10, 18, 20, 24, 40)] == [1, 6, 11, 12, 12, 20]
