import random

import numpy as np

from netgrid.llm import language, quality, toxicity
from netgrid.llm.labelled import fold, sample_texts


def clean(rng, n=60):
    return [rng.choice(["stone", "river", "window", "garden", "yellow", "number", "travel", "simple", "between", "morning"]) for _ in range(n)]


def toxic_corpus(n, seed=0):
    rng = random.Random(seed)
    texts, y = [], []
    for i in range(n):
        w = clean(rng, rng.randint(5, 120))
        if i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(["blargface", "blargnose", "snorkwit"])
        texts.append(" ".join(w))
        y.append(float(i % 4 == 0))
    return texts, np.array(y)


def test_toxicity_finds_unseen_forms():
    m = toxicity.fit(*toxic_corpus(600))
    texts, y = toxic_corpus(200, 9)
    assert ((m.score(texts, {}) >= 0.3) == (y == 1)).mean() > 0.97
    rng = random.Random(3)
    w = clean(rng)
    low = m.score([" ".join(w)], {})[0]
    for form in ("blargchin", "blargface!", "blrgface"):
        assert m.score([" ".join([*w[:30], form, *w[30:]])], {})[0] > 10 * low


def test_toxicity_rows(spark, odd, none):
    texts, y = toxic_corpus(200)
    docs = spark.createDataFrame([(i + 100, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i + 100, int(v), 1) for i, v in enumerate(y)] + [(None, 1, 1), (100, None, None)], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(docs, labels)
    assert got.count() == 200
    assert got.where(fold("doc_id", 4) == 2).where("not held_out").count() == 0
    rows = toxicity.toxicity(odd.select("doc_id", "text", "score"), labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert toxicity.toxicity(none, labels).count() == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 140 <= kept.count() <= 160
    assert toxicity.drop_toxic(odd, labels.limit(0)).columns == odd.columns


def test_quality(spark, odd, none):
    rng = random.Random(4)
    good = [" ".join(clean(rng, 80)) + "." for _ in range(300)]
    bad = [" ".join(x.upper() + "!!" for x in clean(rng, 80)) for _ in range(100)]
    net, prior = quality.fit(good[:200], good[200:] + bad[:60], bad[60:])
    x = np.array([quality.form(t) for t in good + bad])
    assert ((net.score(x) >= 0.3) == np.r_[np.ones(300), np.zeros(100)]).mean() > 0.97
    assert 0.3 < prior < 0.9
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert np.mean([got[i].predicted == int(i < 300) for i in got]) > 0.97
    rows = quality.quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality(none, labels).count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_language(spark, odd, none):
    rng = random.Random(6)
    word = {"en": ["the", "of", "with", "thing", "which", "that"], "de": ["der", "und", "schön", "nicht", "über", "straße"]}
    rows = [(i, " ".join(rng.choice(word[k]) for _ in range(rng.randint(3, 40))), k) for i, k in enumerate(rng.choice(["en", "de"]) for _ in range(400))]
    got = language.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {i: k for i, _, k in rows}
    held = [r for r in got if r.held_out]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    odd_rows = {r.doc_id: r.lang_pred for r in language.languages(odd).collect()}
    assert odd_rows[2] == odd_rows[3] == odd_rows[4] == odd_rows[7] == "und" and odd_rows[1] == "en"
    assert language.languages(none).count() == 0


def test_recurrent_gradients():
    rng = np.random.default_rng(0)
    old, language.F32 = language.F32, np.float64
    try:
        d = language.Direction(rng.normal(0, 0.3, (257, 24)), rng.normal(0, 0.3, (8, 24)), True)
        rows, _ = language.segments([b"hello world", b"abc" * 30])
        aim = rng.normal(size=(language.SPAN, len(rows), 8))
        loss = lambda: sum((h * aim[t]).sum() for t, h in d.run(rows))
        kept = []
        for _ in d.run(rows, kept):
            pass
        dx, du = d.grads(rows, kept, aim)
        for a, g, at in ((d.u, du, (2, 5)), (d.u, du, (3, 20)), (d.x, dx, (ord("b"), 9)), (d.x, dx, (ord("l"), 17))):
            keep = a[at]
            a[at] = keep + 1e-5
            up = loss()
            a[at] = keep - 1e-5
            down = loss()
            a[at] = keep
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4
    finally:
        language.F32 = old


def test_samples_are_bounded_and_never_empty(spark):
    from netgrid.llm.labelled import fitted, least_hash, sample, sample_texts

    for total in (10**4, 10**9, 10**12, 10**15):  # the share of 64-bit hashes that is kept, however many rows there are
        share = (least_hash(3_000, total) + 2**63) / 2**64
        assert 3_000 < share * total < 6_000
    assert least_hash(3_000, 4_000) is None
    docs = spark.range(4_000).selectExpr("id as doc_id", "concat('text ', id) as text")
    again = spark.range(3_000).selectExpr("cast(7 as long) as doc_id", "concat('copy ', id) as text")
    got = sample(docs.unionByName(again), ["text"], 500, 10**6, 3).collect()
    assert len(got) == 500 == len({r.doc_id for r in got})
    assert {r.doc_id: r.text for r in sample(again, ["text"], 500, 10**6, 3).collect()} == {7: "copy 0"}
    assert 0 < sum(len(r.text) for r in sample(docs, ["text"], 500, 200, 3).collect()) <= 200
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as double) as y").unionByName(spark.sql("select 8L as doc_id, 1D as y"))
    rows = sample_texts(docs.unionByName(again), labels, 300).collect()
    assert len(rows) == 300 and {r.y for r in rows} == {0.0, 1.0} and 8 not in {r.doc_id for r in rows}
    assert fitted(docs.limit(0), lambda t: len(t["text"])) == 0 and fitted(docs.where("doc_id < 50"), lambda t: t["doc_id"]) == list(range(50))


def test_tokens_without_letters_hide_nothing():
    m = toxicity.fit(*toxic_corpus(600))
    rng = random.Random(5)
    for bar in ("|", "--", "*", "| | |", "!?"):
        w = clean(rng, 40)
        w[20] = "blargface"
        assert m.score([f" {bar} ".join(w)], {})[0] >= 0.3
        assert m.score([f" {bar} ".join(clean(rng, 40))], {})[0] < 0.3
    assert m.score(["| | --", "", None], {}).tolist() == [m.score([""], {})[0]] * 3


def test_a_lone_word_in_a_long_text_counts():
    m = toxicity.fit(*toxic_corpus(600))
    rng = random.Random(6)
    for at in (0, 1, 2, 3, 500, 998, 999):
        w = clean(rng, 1000)
        w[at] = "snorkwit"
        assert m.score([" ".join(w)], {})[0] >= 0.3


def test_one_long_text_empties_no_sample(spark):
    """The bound on characters passes over texts that alone are longer, whichever comes first by hash."""
    texts = [(i, ("a clean text of words " if i % 2 else "blargface here ") * 3, float(i % 2 == 0)) for i in range(30)]
    for long in range(30):
        docs = spark.createDataFrame([(i, t * (100 if i == long else 1)) for i, t, _ in texts], "doc_id long, text string")
        labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, y double")
        if long % 10 == 0:
            assert sorted(r.doc_id for r in sample_texts(docs, labels, 100, most_chars=3000).collect()) == [i for i in range(30) if i != long]
