import hashlib
import json
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidecast.llm import bpe as B
from tidecast.llm import packing

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
SPEC = open(PATH, encoding="utf-8").read()
MODEL, LIBRARY = B.ByteBPE(SPEC), Tokenizer.from_file(PATH)
PIECES = ["a", " ", "  ", "\n", "the", " over", "'s", "'LL", "é", "日本", "12", "½", "!?", "<|endoftext|>", "\t", "\0", "aaaa", "xyzzy", "\xa0", " ", "\x1c"]




def encoded(*texts):
    ids, ends = MODEL.encode(pa.array(texts))
    return [x.tolist() for x in np.split(ids, ends[:-1])]


@given(st.lists(st.sampled_from(PIECES) | st.text(max_size=4), max_size=12).map("".join))
@settings(max_examples=400, deadline=None)
def test_as_the_library(text):
    texts = ["", text, " a b", text + " ", text.strip()]
    for got, t in zip(encoded(*texts), texts, strict=True):
        assert got == LIBRARY.encode(t, add_special_tokens=False).ids
        assert MODEL.decode(np.array(got, np.int64)).decode() == LIBRARY.decode(got, skip_special_tokens=False)


def test_long_word():
    text = "ab" * 3000 + "a" * 2000
    assert encoded(text, "a", text) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in (text, "a", text)]


def test_rows(spark):
    docs = [(1, "Hello, the world\nover"), (2, None), (3, ""), (None, "x"), (1, "x"), (1, "x")]
    rows = B.bpe_roundtrip(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, n_tokens int"), PATH, keep_ids=True, keep_text=True).collect()
    want = []
    for i, t in docs:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids, t or ""))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert B.bpe_roundtrip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("low, high", [(1, 0x17F), (0xA0, 0x2FF)])
def test_word_vocabulary(low, high):
    """What packing takes for common text is what the library takes for it."""
    spec = json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    library, own = Tokenizer.from_str(json.dumps(spec)), packing.WordBPE(json.dumps(spec))
    rng = np.random.default_rng(15)
    for _ in range(300):
        text = "".join(chr(int(c)) for c in rng.integers(low, high + 1, 30)) + "It's We'LL 'd " + "".join(rng.choice(list("abc.,-' \n12"), 20))
        text = "".join(c for c in text if not re.match(packing.OTHER, c)).replace("<|", "")
        texts = [text, "", f" {text}", text[::-1], *text.split("'"), *(text[i : i + 3] + " \n"[i % 2] for i in range(30))]
        assert [x.tolist() for x in own.encode(pa.array(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts], text
    assert own.library is None
