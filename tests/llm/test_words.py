import re

import numpy as np
import pyarrow as pa
import pytest

from tidecast.llm import words as W

TEXTS = ["One two  THREE", None, "", " \t\n", "É\x0bß\x1c x", "a.b,, c! d\ne", "end", "end", "x" * 50, "ZÀ zà", "q\x00r \x7f"]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("step", [1, 3, 16, 1 << 22])
@pytest.mark.parametrize("at", [0, 2])
def test_words(monkeypatch, step, at):
    monkeypatch.setattr(W, "STEP", step)
    texts = pa.array(TEXTS)[at:]
    own = W.Words(texts)
    want = [(i, x) for i, t in enumerate(texts.to_pylist()) for x in re.findall("[^\x20\x09-\x0d]+", lowered(t))]
    assert list(zip(own.row.tolist(), own.column().to_pylist(), strict=True)) == want
    table = W.classes(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")
    own, pieces, n = W.Words(texts, table), [], 0
    for t in texts.to_pylist():
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(t)):
            found = re.findall("[^\x20\x09]+", piece)
            pieces += [(n, x) for x in found]
            n += bool(found)
    assert list(zip(own.piece.tolist(), own.column().to_pylist(), strict=True)) == pieces


@pytest.mark.parametrize("step", [8, 64, 1 << 22])
def test_hashes(monkeypatch, step):
    rng = np.random.default_rng(0)
    texts = [" ".join("".join(rng.choice(list("abé"), rng.integers(1, 30))) for _ in range(40)) for _ in range(20)] + [" ".join("ab" * n for n in range(40))]
    want = W.Words(pa.array(texts)).hashes()
    monkeypatch.setattr(W, "STEP", step)
    own = W.Words(pa.array(texts))
    got = own.hashes()
    names = own.column().to_pylist()
    assert len({*got.tolist()}) == len({*names}) == len({*zip(names, got.tolist(), strict=True)})
    if step > 8:
        assert (got == want).all()


def test_shingle_sets():
    texts = ["a b c d e", "A  b\nc d", "a b c", "", None, "a b c d a b c d a b c d", "c b a", "b c d e"]
    own, at = W.shingle_sets(pa.array(texts), 4)
    sets = [set(own[i:j].tolist()) for i, j in zip(at[:-1], at[1:], strict=True)]
    assert [len(s) for s in sets] == [2, 1, 1, 0, 0, 4, 1, 1]
    assert sets[1] < sets[0] and sets[1] < sets[5] and sets[7] < sets[0] and sets[2] != sets[6]
    assert all((np.diff(own[i:j].astype(object)) > 0).all() for i, j in zip(at[:-1], at[1:], strict=True))
    assert [len(x) for x in W.shingle_sets(pa.array([], pa.string()), 4)] == [0, 1]
