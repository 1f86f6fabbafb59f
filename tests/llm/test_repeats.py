import hashlib
from collections import Counter

import numpy as np
import pytest

from tidecast.llm import common
from tidecast.llm import repeats as R


def brute(rows):
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    order = [R.LAST if i is None else i for i, _ in rows]
    for i, ws in zip(order, words, strict=True):
        for s in range(len(ws) - 49):
            key = tuple(ws[s : s + 50])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), o, ws in zip(rows, order, words, strict=True):
        gone = set()
        for s in range(len(ws) - 49):
            if first[tuple(ws[s : s + 50])] < o:
                gone.update(range(s, s + 50))
        kept = b" ".join(w for j, w in enumerate(ws) if j not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, rows):
    return sorted(map(tuple, R.runs_removed(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, did int").repartition(3)).collect()), key=str)


def test_least():
    rng = np.random.default_rng(0)
    for n in (7, 8, 50, 51):
        x = rng.integers(0, 100, n).astype(np.uint64)
        assert R.least_in_windows(x, 7).tolist() == [x[i : i + 7].min() for i in range(n - 6)]


@pytest.mark.parametrize("block, bits", [(1 << 22, 1 << 24), (60, 64)])
def test_against_brute_force(spark, monkeypatch, block, bits):
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(common, "BITMAP", bits)
    rng = np.random.default_rng(7)
    vocab = [f"w{i}" for i in range(400)] + ["É", "x\x1cy"]
    word = lambda n: list(rng.choice(vocab, n))
    passages = [word(n) for n in (49, 50, 51, 60, 90, 130)]
    rows = []
    for i in range(70):
        body = word(int(rng.integers(0, 80)))
        for _ in range(int(rng.integers(0, 4))):
            p = list(passages[int(rng.integers(len(passages)))])
            if rng.random() < 0.4:
                p[int(rng.integers(len(p)))] = "edit"
            a = int(rng.integers(0, 5))
            body += p[a:] + word(int(rng.integers(0, 30)))
        rows.append((int(200 - i), " ".join(body)))
    rows += [(1, "a " * 300), (2, "a " * 60), (3, "b a " * 90), (4, None), (5, ""), (6, " \n\t"), (None, " ".join(passages[4])), (None, " ".join(passages[5])), rows[5], rows[5], (rows[5][0], " ".join(passages[3] + passages[5]))]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    assert any(r[2] for r in brute(rows))


def test_one_passage_in_many(spark):
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(5000)]
    passage = list(rng.choice(vocab, 75))
    rows = [(i, " ".join([*rng.choice(vocab, 20), *passage, *rng.choice(vocab, 60)])) for i in range(300)]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    assert run(spark, []) == []
    assert Counter(r[2] >= 75 for r in run(spark, rows)) == Counter({True: 299, False: 1})


def test_rows_of_one_identifier(spark):
    """Very many rows with a null identifier, and rows that share one."""
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(3000)]
    word = lambda n: list(rng.choice(vocab, n))
    passage = word(60)
    rows = [(1, " ".join(passage)), (2, " ".join(word(90)))]
    rows += [(None, " ".join([*word(int(rng.integers(0, 9))), *(passage[int(rng.integers(0, 9)) :] if i % 9 == 0 else ["x"] * (i % 5))])) for i in range(3000)]
    rows += [(7, " ".join([*word(70), *passage, *word(5 + i)])) for i in range(5)] + [(None, rows[1][1] + " end")] * 3
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_common_run_below_the_threshold(spark):
    """A run of 49 words in every document, each with another context, is an anchor of as many stretches and goes nowhere."""
    rng = np.random.default_rng(10)
    word = lambda n: list(map(str, rng.integers(0, 10**12, n)))
    run_of = word(49)
    rows = [(i, " ".join([*word(30), *run_of, *word(30)])) for i in range(400)]
    got = run(spark, rows)
    assert got == sorted(brute(rows), key=str) and not any(r[2] for r in got)


def test_very_long_text(spark):
    rng = np.random.default_rng(11)
    text = " ".join(map(str, rng.integers(0, 500_000, 200_000)))
    rows = [(1, text[400_000:700_000]), (2, text), (3, "x " * 150_000), (4, "x " * 100_000)]
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_extension_compares_words():
    a, b = [b"w%d" % i for i in range(90)], [b"w%d" % i for i in range(90)]
    a[3], b[70] = b"p", b"q"
    assert R.extended(a, b, 10, 10) == (4, 66)
    assert R.extended(a, b, 30, 30) == (30, 0)


def test_carry(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "z")], "doc_id long, text string, did int, gone string")
    assert R.runs_removed(docs, keep_text=True, carry=["did", "gone"]).columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "did", "gone"]
    with pytest.raises(ValueError):
        R.runs_removed(docs.withColumn("n_words", docs.did), carry=["n_words"])
