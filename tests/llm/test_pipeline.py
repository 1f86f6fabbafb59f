import numpy as np
import pytest

import corpus_pipeline as P
from tests.llm.test_near_dup import brute as brute_groups
from tests.llm.test_packing import check_packing
from tests.llm.test_repeats import brute as brute_repeats
from tidecast.llm.toxicity import THRESHOLD, Scorer, train

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(600)]
    word = lambda n: list(rng.choice(vocab, n))
    passage = word(70)
    texts = [" ".join(word(int(rng.integers(5, 150)))) for _ in range(60)]
    texts += [t.upper() for t in texts[:8]] + [t + " more" for t in texts[5:20]]
    texts += [" ".join(word(9) + passage + word(20)) for _ in range(8)] + ["nasty " + " ".join(word(20)) for _ in range(30)]
    texts += [None, "", "", "\n", "x\ny"]
    order = rng.permutation(len(texts)).tolist()
    rows = [(i, texts[j], "en", "s", len(texts[j] or "")) for i, j in enumerate(order)]
    rows += [rows[3], rows[3], (None, texts[0], None, None, None), (None, " ".join(word(40)), "en", None, 0)]
    folder = str(tmp_path_factory.mktemp("tables"))
    rows += [(len(order) + 5, "v " * 60_000 + " ".join(word(30)), "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "doc_id + 1 AS n_words", "'x' AS toxic", "true AS kept", "1.5 AS did", "'y' AS hash")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, int((r[1] or "").startswith("nasty"))) for r in rows if r[0] is not None and r[0] % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def key(r):
    return tuple((x is None, x or "") if not isinstance(x, int) else (False, str(x)) for x in r)


def test_stages_against_brute_force(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in P.STAGES:
        before = [tuple(r) for r in docs.select(*P.COLUMNS).collect()]
        out = stage(spark, docs, tables)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        got = [tuple(r) for r in out.collect()]
        if name == "packing":
            check_packing([(r[0], r[1]) for r in before], got)
            return
        assert out.columns == P.COLUMNS
        if name == "toxicity":
            scorer = Scorer(train(docs, spark.read.parquet(f"{tables}/labels.parquet")))
            want = [r for r in before if scorer.score(r[1] or "")[-1] < THRESHOLD]
            assert not any((r[1] or "").startswith("nasty") for r in got) and len(got) > 60
        elif name == "exact_dedup":
            best = {}
            for r in before:
                k = lower(r[1])
                if k not in best or (r[0] is not None and (best[k][0] is None or r[0] > best[k][0])):
                    best[k] = r
            want = list(best.values())
        elif name == "simhash":
            component = brute_groups([(r[0], r[1]) for r in before])
            want = [r for r, c in zip(before, component, strict=True) if r[0] is None or r[0] == c]
        else:
            judged = brute_repeats([(r[0], r[1]) for r in before])
            want = []
            for r, j in zip(before, judged, strict=True):
                (g,) = [g for g in got if g[0] == r[0]] if r[0] is not None else [r]
                assert (g[1] == r[1] and g[4] == r[4]) if not j[2] else (len(g[1].split()) == j[1] - j[2] and g[4] == len(g[1]))
                want.append(g)
            assert any(j[2] for j in judged)
        assert sorted(got, key=key) == sorted(want, key=key), name
        docs = out


def test_run_and_empty(spark, tables, tmp_path):
    assert P.run(spark, tables).count() > 50
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_each_stage_begins_with_a_release(spark, tables, monkeypatch):
    """Memory that a stage has grown executors to must not stand beside the next one's Python workers."""
    class Released(Exception):
        pass

    def first(_):
        raise Released

    monkeypatch.setattr(P, "release", first)
    for _, stage in P.STAGES:
        with pytest.raises(Released):
            stage(spark, spark.read.parquet(f"{tables}/documents.parquet"), tables)
