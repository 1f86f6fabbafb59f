from collections import Counter

import pytest

from tidecast.llm import chat_views as C

SCHEMA = "conv_id long, turn int, role string, text string, start int"


def brute(rows):
    out = Counter()
    convs = {}
    for c, turn, role, text, _ in rows:
        convs.setdefault(c, []).append((turn, role, text or ""))
    for c, turns in convs.items():
        for p in {r for _, r, _ in turns if r is not None and r != "system"}:
            made = []
            for turn, role, text in turns:
                label = "assistant" if role == p else "system" if role == "system" else "user" if role is None else f"user name={role}"
                made.append(((turn is not None, turn or 0), (role is not None, role or ""), f"<|im_start|>{label}\n{text}<|im_end|>\n", turn, role, len(f"<|im_start|>{label}\n")))
            at = 0
            for *_, rendered, turn, role, head in sorted(made, key=lambda m: m[:3]):
                own = role == p
                out[c, p, turn, role, rendered, at, at + head if own else None, at + len(rendered) if own else None] += 1
                at += len(rendered)
    return out


@pytest.mark.parametrize("block", [256, 2])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rows = [(1, 0, "system", "be kind", 0), (1, 1, "ann", "hi", 0), (1, 2, "bob", "héllo", 0), (1, 3, "ann", None, 0), (1, 4, None, "who", 0), (1, None, "bob", "early", 0), (1, 3, "bob", "tie", 0), (1, 3, "bob", "tie", 0)]
    rows += [(2, 0, "system", "alone", 0), (None, 1, "ann", "a", 0), (None, 2, "zoe", "b", 0), (3, -5, "x", "", 0)]
    rows += [(9, i, ("u", "v", "w")[i % 3], "t" * (i % 7), 0) for i in range(1000)]
    got = C.rotate_perspectives(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(map(tuple, got)) == brute(rows)
    dialogue = "".join(r.rendered for r in sorted((r for r in got if r.conv_id == 9 and r.perspective == "v"), key=lambda r: r.start))
    spans = [dialogue[r.mask_start : r.mask_end] for r in got if r.conv_id == 9 and r.perspective == "v" and r.mask_start is not None]
    assert len(spans) == 333 and all(s.endswith("<|im_end|>\n") and set(s[: -len("<|im_end|>\n")]) <= {"t"} for s in spans)


def test_empty(spark):
    assert C.rotate_perspectives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_text_and_other_columns(spark):
    rows = [(1, 1, "a", "x" * 2_000_000, 0), (1, 2, "b", "y", 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'p' AS perspective", "1 AS block", "2 AS size")
    assert Counter(map(tuple, C.rotate_perspectives(df).collect())) == brute(rows)
