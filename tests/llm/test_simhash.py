from collections import Counter

import numpy as np
import pytest
import xxhash

from tidecast.llm import simhash as S
from tidecast.llm.components import connected_components


def brute_fingerprint(text):
    tokens = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")
    for c in "\t\n\v\f\r":
        tokens = tokens.replace(c, " ")
    tokens = [t for t in tokens.split(" ") if t]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + 4]) for i in range(max(1, len(tokens) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """(id, fp) rows -> id -> smallest id reached."""
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    ids = {}
    for r, (i, _) in zip(root, rows, strict=True):
        if i is not None:
            ids[r] = min(ids.get(r, i), i)
    return [ids.get(r) for r in root]


def test_fingerprint():
    rng = np.random.default_rng(3)
    texts = ["", None, " \n", "one", "One TWO three", "a b c d", "É é a\x1cb c d e", "x " * 700] + [" ".join(rng.choice(["a", "Bé", "c", "dd"], n)) for n in (3, 4, 5, 50, 600)]
    assert [S.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]
    long = " ".join(rng.choice(["a", "b", "c"], 70_000))
    hashes = Counter(" ".join(long.split()[i : i + 4]) for i in range(69_997))
    ones = [sum(n for s, n in hashes.items() if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1) for b in range(64)]
    assert S.fingerprint(long) == sum(1 << b for b, n in enumerate(ones) if 2 * n > 69_997)


def test_ring_loses_nothing():
    rng, masks = np.random.default_rng(4), np.array(S.segments(4), np.uint64)
    assert int(np.bitwise_or.reduce(masks)) == 2**64 - 1 and sum(int(m).bit_count() for m in masks) == 64
    x = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(20_000)], np.uint64)
    assert S.ring(x, masks, 4).all()
    far = rng.integers(0, 2**63, 5000).astype(np.uint64)
    assert not S.ring(far, masks, 4).all()


def test_longer_keys_lose_nothing():
    rng, keys = np.random.default_rng(7), [0]
    x = [sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in range(300)]
    for bits in (16, 20):
        longer = S.longer_keys(keys, 4)
        for v in x:  # whoever agrees on a key agrees on a longer one
            agreed = {i for i, k in enumerate(keys) if not v & k}
            assert agreed and agreed == {i for i, k in longer if not v & k}
        keys = [k for _, k in longer]
        assert min(k.bit_count() for k in keys) > bits


@pytest.mark.parametrize("largest, open_bits", [(8192, 13), (4, 40)])
def test_components(spark, monkeypatch, largest, open_bits):
    monkeypatch.setattr(S, "LARGEST", largest)
    monkeypatch.setattr(S, "OPEN", open_bits)
    monkeypatch.setattr(S, "SMALL", 4)
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 2**63, 60)]
    for _ in range(150):  # chains and crowds
        fps.append(fps[int(rng.integers(len(fps)))] ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)))
    signed = [f - (f >> 63 << 64) for f in fps]
    got = connected_components(S.links(spark.createDataFrame([(f,) for f in set(signed)], "fp long"))).collect()
    root = {r.node: r.root for r in got}
    want = brute_components(list(zip(signed, fps, strict=True)))
    assert [root.get(f, f) for f in signed] == want


def test_groups(spark):
    rng = np.random.default_rng(6)
    base = [" ".join(rng.choice([f"w{i}" for i in range(300)], 120)) for _ in range(15)]
    texts = base + [b.replace(" w7 ", " zz ", 1).upper() for b in base] + [None, "", " ", "short", "Short"] + base[:2]
    rows = [(None if i % 13 == 5 else 500 - i, t, "n") for i, t in enumerate(texts)]
    got = S.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")).collect()
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    want = Counter(zip([r[0] for r in rows], [f"{f:016x}" for f in fps], brute_components([(r[0], f) for r, f in zip(rows, fps, strict=True)]), strict=True))
    assert Counter(map(tuple, got)) == want
    assert S.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
