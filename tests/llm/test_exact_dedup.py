import hashlib
from collections import Counter

import numpy as np
import pytest

from tidecast.llm.exact_dedup import exact_dedup


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        left = 1
        for i in sorted(ids, key=lambda i: i != best):
            out[i, best, len(ids), i == best and left > 0, hashlib.sha256(text.encode()).hexdigest()] += 1
            left -= i == best
    return out


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_against_brute_force(spark, keep):
    rng = np.random.default_rng(1)
    heads = ["Same HEAD " * 12, "É", ""]
    pool = [heads[int(rng.integers(3))] + f"text {i}" for i in range(120)]
    rows = [(int(i), pool[int(rng.integers(120))]) for i in range(400)]
    rows += [(1000 + i, "One Hot TEXT" if i % 2 else "one hot text") for i in range(1500)]  # beyond a partition's share
    rows += [(3000 + i, None if i % 2 else "") for i in range(600)] + [(None, "x"), (None, "X"), (None, "one hot text"), rows[3], rows[3], (7, "É"), (8, "é"), (9, "q" * 100_000), (10, "Q" * 100_000)]
    got = exact_dedup(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, norm int").repartition(6), keep=keep).collect()
    assert Counter(map(tuple, got)) == brute(rows, keep)


def test_edges(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nulls = exact_dedup(spark.createDataFrame([(None, "a")] * 900 + [(None, None)] * 3, "doc_id long, text string")).collect()
    assert Counter((r.keep_id, r.group_size, r.kept) for r in nulls) == Counter({(None, 900, False): 899, (None, 900, True): 1, (None, 3, False): 2, (None, 3, True): 1})
    with pytest.raises(ValueError):
        exact_dedup(nulls and spark.range(1), keep="first")


def test_carry(spark):
    rows = [(i, f"T{i % 7}" if i % 2 else "hot", i * 10, "z") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, hash string")
    got = exact_dedup(docs, carry=["n", "hash"])
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "text", "n", "hash"]
    assert Counter((r.doc_id, r.text, r.n, r.hash) for r in got.collect()) == Counter(rows)
    assert Counter(tuple(r)[:5] for r in got.collect()) == brute([r[:2] for r in rows], "largest")
    with pytest.raises(ValueError):
        exact_dedup(docs.withColumn("kept", docs.n), carry=["kept"])


def test_texts_of_one_head(spark):
    """Very many different texts behind one common head, and copies without an identifier."""
    rows = [(i, "HEADER " * 20 + str(i % 900)) for i in range(2500)] + [(None, "same")] * 1200 + [(5, "Same")] * 3
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter(map(tuple, got)) == brute(rows, "largest")
