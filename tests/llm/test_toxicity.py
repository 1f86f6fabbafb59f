import re
import zlib

import numpy as np
import pytest

from tidecast.llm import toxicity as T

NAMES = "doc_id long, text string, p_toxic int"


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = list(rng.choice([f"plain{j}" for j in range(200)], int(rng.integers(15, 120))))
        bad, low = rng.random() < 0.2, rng.random() < 0.2
        if bad:
            words[3] = rng.choice(["nasty", "vilething", "vilewords"])
        rows.append((i, " ".join(w + "###" for w in words) if low else " ".join(words), int(not low), int(bad)))
    return rows


def test_held_out(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(r[0], r[1], 5) for r in rows], NAMES)
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows[:500]] + [(None, 1, 1), (7, None, None), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in T.score_toxicity(docs, T.train(docs, labels)).collect()}
    held = rows[500:]
    assert np.mean([got[r[0]].toxic == bool(r[3]) for r in held]) > 0.98
    assert np.mean([(got[r[0]].p_low_quality > 0.5) == (not r[2]) for r in held]) > 0.98


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (2, "", 1), (None, "x " * 50_000, 1)], NAMES)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = T.train(docs, none)
    assert [r.toxic for r in T.score_toxicity(docs, chain).collect()] == [False] * 4
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert all(r.toxic for r in T.score_toxicity(docs, T.train(docs, one)).collect())
    assert T.score_toxicity(docs.limit(0), chain).count() == 0


def test_test_tables(spark):
    """Held-out accuracy on the synthetic tables: train on half of the labels."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    chain = T.train(docs, labels.where("doc_id % 2 = 0"), 2000)
    held = T.score_toxicity(docs.join(labels.where("doc_id % 2 = 1").select("doc_id"), "doc_id"), chain).join(labels.withColumnRenamed("toxic", "truth"), "doc_id")
    n, hit, wrong, bad = held.selectExpr("count(*)", "count_if(toxic and truth = 1)", "count_if(toxic and truth = 0)", "count_if(truth = 1)").first()
    print(n, hit, wrong, bad)
    assert hit > 0.9 * bad and wrong < 0.015 * n


def brute_score(chain, text):
    """Probabilities by the definition: a sum over the distinct hashed features, one category after the other."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    grams = {b"w" + w.encode() for w in words} | {b"s" + w[:n].encode() for w in words for n in (4, 5, 6) if len(w) > n}
    hashed = {zlib.crc32(g) % (1 << T.BITS) for g in grams}
    n = max(1, len(text))
    dense = [sum("A" <= c <= "Z" for c in text) / n * 2, min(1.0, sum(c in "#$%&*!|=<>{}@" for c in text) / n * 10), sum(c in "0123456789" for c in text) / n * 2, min(1.0, text.count("\n") / n * 50), min(1.0, 3 * len(words) / n), 1.0]
    out = []
    for m in chain.models:
        weight = dict(zip(m.kept.tolist(), m.weights.tolist(), strict=True))
        x = sum(weight.get(h, 0.0) for h in hashed) + sum(a * b for a, b in zip(dense, m.dense.tolist(), strict=True))
        out.append(1 / (1 + np.exp(-x)))
        dense.append(out[-1])
    return out


def test_chain_against_brute_force(spark):
    rows = corpus(300, 2)
    docs = spark.createDataFrame([(r[0], r[1], 5) for r in rows] + [(1, "", 0)] * 20, NAMES)
    chain = T.train(docs, spark.createDataFrame([(r[0], r[2], r[3]) for r in rows[:200]], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in T.score_toxicity(docs.where("text <> ''"), chain).collect()}
    for i, text, *_ in rows:
        assert np.allclose([got[i].p_low_quality, got[i].p_toxic], brute_score(chain, text), atol=1e-9)


def test_later_models_see_out_of_fold_probabilities():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 60, 9)).astype(np.int32) for _ in range(120)]
    dense, labels = rng.random((120, 6)), {c: (rng.random(120) < 0.4).astype(float) for c in ("a", "b")}
    chain = T.fit_chain(rows, dense, labels)
    fed = np.zeros(120)
    for k in range(T.FOLDS):
        rest, here = [j for j in range(120) if j % T.FOLDS != k], [j for j in range(120) if j % T.FOLDS == k]
        model = T.fit_linear([rows[j] for j in rest], dense[rest], labels["a"][rest])
        for j in here:
            fed[j] = 1 / (1 + np.exp(-(sum(w for f, w in zip(model.kept, model.weights, strict=True) if f in rows[j]) + dense[j] @ model.dense)))
    want = T.fit_linear(rows, np.c_[dense, fed], labels["b"])
    assert np.allclose(chain.models[1].dense, want.dense, atol=1e-5) and np.allclose(chain.models[1].weights, want.weights, atol=1e-5)


def test_clash(spark):
    chain = T.train(spark.createDataFrame([], NAMES), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    docs = spark.createDataFrame([(1, "a", 1)], NAMES)
    assert T.score_toxicity(docs.withColumn("toxic", docs.doc_id), chain).columns == ["doc_id", "p_low_quality", "p_toxic", "toxic"]
    with pytest.raises(ValueError):
        T.score_toxicity(docs, chain, ["doc_id", "p_toxic"])


def test_a_kept_text_goes_to_python_once(spark):
    rows = corpus(60, 3)
    docs = spark.createDataFrame([(r[0], r[1], 5) for r in rows] + [(77, None, 1), (78, "", 1)], NAMES)
    chain = T.train(docs, spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int"))
    own = T.score_toxicity(docs, chain)
    kept = T.score_toxicity(docs, chain, ["text", "doc_id"])
    assert kept.columns == ["text", "doc_id", "p_low_quality", "p_toxic", "toxic"] and "_scored_text" not in kept._jdf.queryExecution().toString()
    assert sorted(tuple(r)[1:] for r in kept.collect()) == sorted(map(tuple, own.collect()))
    assert {r.doc_id: r.text for r in kept.collect()} == {r.doc_id: r.text for r in docs.collect()}
    number = docs.selectExpr("doc_id", "doc_id * 7 AS text")  # another type is cast for the score and kept as it is
    assert {(r.doc_id, r.text) for r in T.score_toxicity(number, chain, ["doc_id", "text"]).collect()} == {(r.doc_id, r.text) for r in number.collect()}
