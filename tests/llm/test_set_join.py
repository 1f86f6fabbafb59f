import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tidecast.llm import set_join as S


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, words=4):
    w = re.findall("[^\x20\x09-\x0d]+", lowered(text))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, words=4, per_cent=85, blank_linked=False):
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if (both and 100 * both >= per_cent * len(sets[i] | sets[j])) or (blank_linked and not sets[i] and not sets[j]):
            a, b = root[i], root[j]
            root = [b if r == a else r for r in root]
    low = {}
    for r, (i, _) in zip(root, rows):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return sorted(((i, len(s), low.get(r)) for r, s, (i, _) in zip(root, sets, rows)), key=str)


def got(spark, rows, n=3, **more):
    out = S.similar_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), **more)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, out.collect()), key=str)


def changed(rng, text, n):
    w = text.split(" ")
    for i in rng.choice(len(w), n, replace=False):
        w[i] = f"own{rng.integers(1 << 40)}"
    return " ".join(w)


def some_rows(seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    out = [text(n) for n in (0, 1, 2, 3, 4, 5, 8, 20, 50, 100, 300)]
    for base in (text(40), text(120), text(400)):
        out += [base, base.upper(), base.replace(" ", "\t\n ")] + [changed(rng, base, k) for k in (1, 1, 2, 3, 4, 6, 8, 12, 16) for _ in range(2)]
        out += [base + " " + text(k) for k in (1, 4, 10, 20, 60)]
    out += ["the the the the the", "the the the the", "The THE the  the", "the the the", "a b c", "A b C", "c b a", "", None, " \n\t"]
    rows = list(enumerate(out))
    return rows + rows[3:9] + [(None, out[20]), (None, "nothing like it at all"), (5000, out[30])]


@pytest.mark.parametrize("words,per_cent,blank_linked", [(4, 85, False), (2, 60, True)])
def test_as_brute_force(spark, words, per_cent, blank_linked):
    rows = some_rows(words)
    assert got(spark, rows, words=words, per_cent=per_cent, blank_linked=blank_linked) == brute(rows, words, per_cent, blank_linked)


def test_crowded_sketch_and_small_spans(spark, monkeypatch):
    """Any order of the elements gives the same links."""
    monkeypatch.setattr(S, "SPAN", 100)
    rows = some_rows(7)
    assert got(spark, rows, n=1) == brute(rows)


def test_members_of_a_group_are_told_apart(spark):
    """Texts with the same size and prefix need not be similar: the order is given here, so that the rare part is shared."""
    rng = np.random.default_rng(4)
    common = [" ".join(f"c{j}x{i}" for i in range(90)) for j in range(3)]
    rare = " ".join(f"r{i}" for i in range(30))
    rows = [(i, f"{c} {rare}") for i, c in enumerate(common)] + [(10 + i, changed(rng, c, 20)) for i, c in enumerate(common * 30)] + [(500 + i, c + " " + " ".join(f"t{i}x{j}" for j in range(4))) for i, c in enumerate(common)]
    assert got(spark, rows) == brute(rows)


def test_no_hints_or_any(spark):
    rows = some_rows(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    s = [r[0] for r in df.selectExpr("xxhash64(lower(coalesce(text, '')))").collect()]
    hints = spark.createDataFrame(list(zip(s, reversed(s))), "a long, b long")
    assert sorted(map(tuple, S.similar_texts(df, hints=hints).collect()), key=str) == brute(rows)


def test_empty_long_and_clashing(spark):
    assert got(spark, []) == []
    assert got(spark, [(2, ""), (1, None)]) == [(1, 0, 1), (2, 0, 2)]
    rng = np.random.default_rng(1)
    long = " ".join(f"v{i}" for i in rng.integers(0, 10**6, 150_000))
    rows = [(3, long), (1, changed(rng, long, 2000)), (2, "word" * 200_000), (4, changed(rng, long, 30_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS s", "2 AS size", "3 AS id", "4 AS component_id", "5 AS n_shingles", "6 AS chunk")
    want = [(3, 1), (1, 1), (2, 2), (4, 4)]
    assert sorted((r[0], r[2]) for r in S.similar_texts(df).collect()) == sorted(want)
    text_ids = spark.createDataFrame([("b", "x y z u v"), ("a", "x y z u v"), (None, "q")], "doc_id string, text string")
    assert sorted(map(tuple, S.similar_texts(text_ids).collect()), key=str) == sorted([("b", 2, "a"), ("a", 2, "a"), (None, 1, None)], key=str)


def template(many, own, shared=700):
    """Texts of one template and words of their own."""
    core = " ".join(f"core{i}" for i in range(shared))
    return [(i, core + " " + " ".join(f"own{i}x{j}" for j in range(own))) for i in range(many)]


@pytest.mark.parametrize("own,linked", [(70, False), (50, True)])
def test_pairs_grow_with_the_texts(spark, monkeypatch, own, linked):
    """Groups just under the threshold give no candidates; those above it as many as they have texts, times a constant."""
    made = []
    real = S.cut
    monkeypatch.setattr(S, "cut", lambda df: (made.append((df.columns, out.count())) or out) if (out := real(df)) is not None else None)
    counts = []
    for many in (60, 240):
        made.clear()
        rows = template(many, own)
        assert len({r[2] for r in got(spark, rows)}) == (1 if linked else many)
        counts.append(sum(n for c, n in made if c in (["a", "b"], ["k", "a_root", "b_root"])))
    assert counts[1] <= 6 * max(counts[0], 1)


def test_order_of_prefixes():
    texts = pa.array(["a b c d e f g h", "a b c d e f g x", "y"])
    own, ends = S.shingle_sets(texts, 1)
    table = np.zeros((S.ROWS, S.SLOTS), np.int8)
    some, at = S.prefixes(own, ends, table, 85)
    assert np.diff(at).tolist() == [2, 2, 1]
    assert some[:2].tolist() == sorted(own[:8].tolist())[:2]
    for r, (slot, sign) in enumerate(S.slots(own[:2])):
        table[r][slot] = 5 * sign
    assert S.levels(own[:2], table).tolist() == [5, 5]
    assert not set(S.prefixes(own, ends, table, 85)[0][:2].tolist()) & set(own[:2].tolist())


def test_as_duckdb(spark):
    import duckdb

    from tidecast.llm import queries as Q

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    names = ["doc_id", "n_shingles", "component_id"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({Q.oracle_sql()['op12_set_join']})").fetchall())
    assert len(want) == 200 and any(a != c for a, _, c in want)
    assert sorted(map(tuple, Q.op12_set_join(spark, folder).select(*names).collect())) == want


def test_shuffles_are_removed_on_the_way(spark, monkeypatch):
    """What a step has shuffled does not stay on disk until the last: of very many small files that is more than the input."""
    import time
    from pathlib import Path

    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {p.name.split("_")[1] for top in env.localDirsString() for p in Path(top).rglob("shuffle_*.data")}
    before, counts, real = shuffles(), [], S.free

    def watched(session):
        held, until = len(shuffles() - before), time.time() + 20
        real(session)
        while (left := len(shuffles() - before)) > max(5, held // 2) and time.time() < until:  # Spark's cleaner runs beside
            time.sleep(0.2)
        counts.append((held, left))

    monkeypatch.setattr(S, "free", watched)
    rows = [(i, " ".join(f"w{(i // 4) * 40 + j}" for j in range(40)) + (" more" * (i % 4))) for i in range(80)]
    got = S.similar_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len({r.component_id for r in got}) == 20
    assert len(counts) >= 4 and all(left <= max(5, held // 2) for held, left in counts), counts
