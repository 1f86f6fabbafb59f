import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidecast.llm import collocations as C

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = {(p[0], *p[i:j]) for p in found for i in range(1, len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) - 1 and found.get((p[0], *p[i:j]), 0) == found[p]}
    out = defaultdict(list)
    for p, a in found.items():
        if p not in inside:
            score, _, left, right = min((1000 * a * n[p[0]] // (f[p[:k]] * f[(p[0], *p[k:])]), k, f[p[:k]], f[(p[0], *p[k:])]) for k in range(2, len(p)))
            out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def got(spark, rows, n=3, **more):
    out = C.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(n), **more)
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()))


def random_rows(seed, docs=60, words=60):
    rng = np.random.default_rng(seed)
    vocabulary = ["a", "B", "c", "dé", "é", "New", "york", "x\x0b", "f.", "g!", "\x1c"]
    chance = np.arange(len(vocabulary), 0, -1) ** 2.0
    rows = [(["en", "de", None, "und"][i % 4], " ".join(rng.choice(vocabulary, rng.integers(0, words), p=chance / chance.sum()))) for i in range(docs)]
    return rows + [("en", "one two three four five six, seven"), ("en", "In one two three four FIVE six")] * 12 + [("en", None), (None, ""), ("fr", " \t\n"), ("de", "...")]


def classes_of(ids, pieces, most):
    """Phrases by their sets of end positions."""
    ends = defaultdict(set)
    for e in range(len(ids)):
        for d in range(1, most + 1):
            if e - d + 1 >= 0 and pieces[e - d + 1] == pieces[e]:
                ends[tuple(ids[e - d + 1 : e + 1])].add(e)
    return ends


@pytest.mark.parametrize("seed", range(6))
def test_automaton(seed):
    rng = np.random.default_rng(seed)
    n = [0, 1, 40, 200, 200, 400][seed]
    ids, pieces = rng.integers(0, 3 if seed < 4 else 40, n), np.cumsum(rng.random(n) < 0.1)
    depth = np.array([min(5, sum(pieces[: e + 1] == pieces[e])) for e in range(n)], np.int64)
    s = C.automaton(ids, depth, 5)
    ends, members = classes_of(ids.tolist(), pieces.tolist(), 5), defaultdict(list)
    for p, e in ends.items():
        members[frozenset(e)].append(p)
    phrase = lambda i, d: tuple(ids[s["end"][i] - d + 1 : s["end"][i] + 1].tolist())
    assert len(s["end"]) == len(members)
    for i in range(len(s["end"])):
        own = members[frozenset(ends[phrase(i, s["longest"][i])])]
        assert sorted(own, key=len) == [phrase(i, d) for d in range(s["shortest"][i], s["longest"][i] + 1)]
        assert s["count"][i] == len(ends[own[0]])
        if s["link"][i] < 0:
            assert s["shortest"][i] == 1
        else:
            assert phrase(s["link"][i], s["longest"][s["link"][i]]) == phrase(i, s["shortest"][i] - 1)
    e, d, c = C.substrings(s)
    assert {tuple(ids[a - b + 1 : a + 1].tolist()): k for a, b, k in zip(e, d, c)} == {p: len(x) for p, x in ends.items()}


@pytest.mark.parametrize("shard,largest,least", [(1, 5, 3), (300, 60, 12), (4_000_000, 1 << 20, 1)])
def test_as_brute_force(spark, monkeypatch, shard, largest, least):
    monkeypatch.setattr(C, "SHARD", shard)
    monkeypatch.setattr(C, "LARGEST", largest)
    rows = random_rows(least)
    assert got(spark, rows, least=least) == brute(rows, least)


@pytest.mark.parametrize("longest", [2, 7])
def test_lengths_ranks_and_full_filters(spark, monkeypatch, longest):
    """Filters whose every bit is set change nothing."""
    monkeypatch.setattr(C, "BITS", 64)
    monkeypatch.setattr(C, "SLOTS", C.CHUNK)
    rows = random_rows(5)
    assert got(spark, rows, least=4, longest=longest, top=7) == brute(rows, 4, longest, 7)


def test_empty_long_and_clashing(spark):
    assert got(spark, []) == got(spark, [("en", "a b c")]) == []
    rows = [("en", "red fox " * 60_000), (None, "word" * 100_000 + " red fox")]
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS phrase", "2 AS n", "3 AS l", "4 AS words", "5 AS f")
    assert sorted(map(tuple, C.collocations(df).collect())) == brute(rows, 100)


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts as they are after 10^13 words."""
    big = 10**13
    counted = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big // 3), ("en", "a b", 2, big // 7)], "lang string, phrase string, words int, f long")
    total = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    monkeypatch.setattr(C, "phrase_counts", lambda *a: (counted, total))
    docs = spark.createDataFrame([], "lang string, text string")
    assert [r["score"] for r in C.collocations(docs).collect()] == [1000 * (big // 7) * 9 * big // (big * (big // 3))]


def test_hashes_are_sparks(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    rows = [("en", "é a b ccccccccccccccccccccccccccccccccccccccccc"), ("d", "x")]
    s = C.Shard(pa.RecordBatch.from_pydict({"text": [t for _, t in rows], "lang": [x for x, _ in rows]}))
    df = spark.createDataFrame([*zip(s.lang.to_pylist(), s.word.to_pylist(), s.hash.view(np.int64).tolist())], "lang string, word string, h long")
    assert df.where(F.xxhash64("lang", "word") != F.col("h")).count() == 0 and df.count() == 5


def test_as_duckdb(spark):
    import duckdb

    from tidecast.llm import queries as Q

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({Q.oracle_sql()['op13_collocations']})").fetchall())
    assert len(want) > 20
    assert sorted(map(tuple, Q.op13_collocations(spark, folder).select(*COLUMNS).collect())) == want


def test_rows_and_workers_of_the_automata(spark, monkeypatch):
    """The automata give rows by different contexts, not by shards that hold them; no task needs two Python workers at once."""
    frame, made = type(spark.range(0)), {}
    real = frame.mapInArrow

    def counted(df, f, schema, *more):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan.split("Exchange")[0], plan
        made[f.__name__] = real(df, f, schema, *more)
        return made[f.__name__]

    monkeypatch.setattr(frame, "mapInArrow", counted)
    rows, found = [("en", "one two three four five six seven. red fox runs far. one two three eight")] * 240, []
    for parts in (2, 8):
        assert got(spark, rows, parts) == brute(rows, 100)
        found.append(made["phrases"].count())
    # Ends of runs of three: 5 in the first piece, 2 in the second, and in the third one new to the first.
    assert max(found) <= 3 * 8, found
