from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from tidecast.llm import near_dup as N
from tidecast.llm import set_join as S


def brute_sets(text, words=5):
    tokens = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))}


def brute(rows):
    """(id, text) rows -> per row the smallest id reached."""
    sets, root = [brute_sets(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    ids = {}
    for r, (i, _) in zip(root, rows, strict=True):
        if i is not None:
            ids[r] = min(ids.get(r, i), i)
    return [ids.get(r) for r in root]


def texts():
    rng = np.random.default_rng(12)
    vocab = [f"w{i}" for i in range(500)]
    base = [list(rng.choice(vocab, n)) for n in (3, 5, 8, 20, 60, 150, 300, 700, 1500)]
    common = list(rng.choice(vocab, 40))
    out = [" ".join(b) for b in base] + [None, "", " \n", "\t", "one", "ONE", "One two"]
    for b in base[2:]:
        for _ in range(12):
            t = list(b)
            for at in rng.integers(0, len(t), int(rng.integers(0, 2 + len(t) // 25))):
                t[at] = str(rng.choice(vocab))
            out.append(" ".join(t[int(rng.integers(0, 2)) :]))
    return out + [" ".join([*rng.choice(vocab, 60), *common]) for _ in range(15)]


def test_against_brute_force(spark):
    rows = [(None if i % 17 == 5 else 900 - i, t) for i, t in enumerate(texts())]
    rows += rows[4:6]
    got = N.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = Counter(zip([r[0] for r in rows], brute(rows), strict=True))
    assert 20 < len({c for _, c in want}) < len(rows) - 20
    assert Counter(map(tuple, got)) == want
    assert N.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline_drops_similar_documents(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts())]
    stage = dict(P.STAGES)["simhash"]
    got = stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted({*brute([(r[0], r[1]) for r in rows])})


@pytest.mark.parametrize(("shared", "own", "linked"), [(700, 110, False), (700, 60, True)])
def test_candidates_grow_with_the_texts(spark, monkeypatch, shared, own, linked):
    """A template just below the threshold, a passage that texts have in common, and a template above it: no pair is formed for nothing."""
    made, counts, real = [], [], S.cut
    monkeypatch.setattr(S, "cut", lambda df: made.append(((out := real(df)).columns, out.count())) or out)
    for many in (60, 240):
        made.clear()
        core = " ".join(f"core{i}" for i in range(shared))
        rows = [(i, core + " " + " ".join(f"own{i}x{j}" for j in range(own))) for i in range(many)]
        got = N.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert len({r.component_id for r in got}) == (1 if linked else many)
        counts.append(sum(n for c, n in made if c == ["a", "b"]))
    assert counts[1] <= 6 * counts[0] + 4 * 240, counts  # fingerprints link by forests; 240 texts have 28,680 pairs


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none, store = context._jvm.java.util.ArrayList(), context._jsc.sc().statusStore()
    stages = store.stageList(none, False, False, context._gateway.new_array(context._jvm.double, 0), none)
    return sum({(s := stages.apply(i)).stageId(): s.shuffleWriteBytes() for i in range(stages.size())}.values())


def test_documents_that_stay_are_not_shuffled(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"{x:x}" for x in rng.integers(0, 1 << 62, 4000)), "en", "s", 1) for i in range(60)]
    rows += [(70, rows[3][1] + " more", "en", "s", 1), (None, rows[5][1] + " x", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(tmp_path / "d"))
    out = dict(P.STAGES)["simhash"](spark, spark.read.parquet(str(tmp_path / "d")), str(tmp_path))
    before = shuffled(spark)
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in out.select("doc_id", "text").collect()) == [-1, *range(60)]
    assert 0 <= shuffled(spark) - before < 400_000  # the texts have some four million bytes


@pytest.mark.parametrize("gathered", [0, 3, 10_000])
def test_components_on_the_driver_or_not(spark, gathered):
    from tidecast.llm.components import connected_components

    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(-40, 40, (45, 2))] + [(100 + i, 101 + i) for i in range(9)] + [(None, 1), (7, 7)]
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), gathered=gathered).collect()
    assert {r.node: r.root for r in got} == root and len(got) == len({r.node for r in got})
    assert connected_components(spark.createDataFrame([], "a long, b long"), gathered=gathered).count() == 0
