import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidecast.llm import packing as P

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def check_packing(docs, rows, window=4096):
    """docs: (id, text); rows: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        for s in range(0, len(ids), window):
            piece = ids[s : s + window]
            want[i, s, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)] += 1
    assert Counter(tuple(r[:5]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r[5]].append((r[6], r[2]))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return sum(r[2] for r in rows), len(sequences)


def test_fill_is_closest():
    rng = np.random.default_rng(12)
    for _ in range(60):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.choice(np.arange(1, 40), 4, replace=False)}
        capacity = int(rng.integers(1, 90))
        got = P.fill(counts, capacity)
        assert all(0 < n <= counts[k] for k, n in got.items())
        best = max(s for ns in itertools.product(*(range(n + 1) for n in counts.values())) if (s := sum(k * n for k, n in zip(counts, ns, strict=True))) <= capacity)
        assert sum(k * n for k, n in got.items()) == best


def test_little_padding():
    rng = np.random.default_rng(13)
    lengths = np.minimum(rng.lognormal(6.5, 1, 20_000).astype(int) + 1, 4096)
    rows, sequences = P.plan(dict(Counter(lengths.tolist())), 4096)
    assert lengths.sum() > 0.999 * 4096 * sequences


def test_rows(spark):
    rng = np.random.default_rng(14)
    docs = [(i, " ".join(rng.choice(["alpha", "Beta,", "γ", "don't", "x\ty", "12"], int(rng.integers(0, 4000))))) for i in range(40)]
    docs += [(50, None), (51, ""), (None, "a b"), docs[0], docs[0], (52, "a " * 4095), (53, "a " * 4096), (54, "<|endoftext|> x"), (55, "É́ \x1c\x85 q")]
    got = P.pack(spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, start int").repartition(3), PATH).collect()
    check_packing(docs, [tuple(r) for r in got])
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
